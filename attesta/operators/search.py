"""Search over the evidence store (W5, W6, J1, J2, J4, J5): both searches with each claim's cutoff, their fusion, and the chunks and earlier checks found, ready as sources of an analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.operators import retrieval

CHECKS = 3
#: The origin of sources from the store, as the report names it (a fixed value).
ORIGIN = "base_propria"


def _by_cutoff(pairs: DataFrame, claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """pairs(qid, chunk_id, score) whose chunk was published by the claim's day; undated chunks and claims without a day pass."""
    days = claims.select("qid", "until")
    dated = pairs.join(chunks.select("chunk_id", "published"), "chunk_id").join(days, "qid")
    return dated.where(F.col("until").isNull() | F.col("published").isNull() | (F.col("published") <= F.col("until"))).select("qid", "chunk_id", "score")


def hybrid(claims: DataFrame, chunks: DataFrame, vectors: DataFrame, top: int = retrieval.TOP) -> DataFrame:
    """Qid, chunk_id, score and rank of the `top` chunks of each claim by reciprocal rank fusion; ties by chunk_id.

    claims(qid, text, qvec, until), until a date or null; chunks(chunk_id, text, published); vectors(chunk_id, vec). BM25's statistics are over all chunks, and the cutoff comes before either list is cut to its best. A claim without terms has the vectors' list alone, one without a vector the words'."""
    words = retrieval.bm25(claims.select("qid", "text"), chunks.select("chunk_id", "text"))
    words = retrieval.ranked(_by_cutoff(words.withColumn("score", F.round("score", 9)), claims, chunks), "qid", "score", "chunk_id", top)
    near = retrieval.vector_topk(claims.select("qid", "qvec", F.unix_date("until").cast("long").alias("until")), vectors.join(chunks.select("chunk_id", F.unix_date("published").cast("long").alias("day")), "chunk_id"), top)
    return retrieval.ranked(retrieval.rrf([words, near]).withColumn("score", F.round("score", 9)), "qid", "score", "chunk_id", top)


def hydrated(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """found(qid, chunk_id, rank) with what a source needs: chunks(chunk_id, text, url, title, domain, published, full_text, copy_group, ref_period). source_ord is the rank."""
    some = chunks.join(found.select("chunk_id").distinct(), "chunk_id", "left_semi")  # the texts of hits alone move
    got = found.select("qid", "chunk_id", "rank").join(some, "chunk_id")
    return got.select(
        F.col("qid").alias("claim_id"), F.col("rank").cast("int").alias("source_ord"), "chunk_id", "url", "title", "domain", "text", F.lit(ORIGIN).alias("origin"), "published", "full_text",
        F.concat(F.lit("base:"), F.col("copy_group").cast("string")).alias("copy_of"), "ref_period",
    )


def prior_checks(claims: DataFrame, checks: DataFrame, top: int = CHECKS) -> DataFrame:
    """claim_id, rank and the checks whose claims are most alike by BM25: claims(qid, text), checks(check_id, claim, agency, date, url, verdict_original). Ties by check_id, which the reference leaves open."""
    scored = retrieval.bm25(claims.select("qid", "text"), checks.select(F.col("check_id").alias("chunk_id"), F.col("claim").alias("text")))
    best = retrieval.ranked(scored.withColumn("score", F.round("score", 9)), "qid", "score", "chunk_id", top)
    return best.select(F.col("qid").alias("claim_id"), F.col("chunk_id").alias("check_id"), F.col("rank").cast("int").alias("rank")).join(checks, "check_id")
