"""Evidence retrieval: BM25, exact vector search, and their fusion by reciprocal rank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.text import index_words, query_terms
from attesta.sources.store import written

K1, B, FLOOR, RRF_K, TOP = 1.2, 0.75, 1e-6, 60, 10
QUERY_BLOCK = 4096
#: Query terms that are looked up within a row; more are joined.
LITERAL_TERMS = 20_000
#: Query terms, of all queries together, that are broadcast with their weights.
BROADCAST_ROWS = 500_000


def ranked(scored: DataFrame, by: str, score: str, ident: str, top: int, name: str = "rank") -> DataFrame:
    """The best `top` rows for each `by`, ties by ident; the rank filter reaches the sort as a group limit."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(ident))
    return scored.withColumn(name, F.row_number().over(w)).where(F.col(name) <= top)


def bm25(queries: DataFrame, chunks: DataFrame, asked_of: Callable = query_terms, words_of: Callable = index_words, literal: int = LITERAL_TERMS) -> DataFrame:
    """Qid, chunk_id and score of every chunk with a query term: queries(qid, text), chunks(chunk_id, text).

    Statistics are over all chunks, not over those a filter leaves. Every chunk is cut into words once: its length and its words that some query asks for are written, and all else reads these. The hits of a chunk then meet in one place, so that
    term counts, scores and a rank's first cut need no further shuffle. Terms of queries up to `literal` are a hash set within the row's filter; more are joined. Null texts have no terms."""
    asked = queries.select("qid", F.explode(asked_of(F.col("text"))).alias("term"))
    wanted = asked.select("term").distinct()
    words = chunks.select("chunk_id", words_of(F.coalesce("text", F.lit(""))).alias("w"))
    terms = [r["term"] for r in wanted.limit(literal + 1).collect()]
    if len(terms) <= literal:
        hits = words.select("chunk_id", F.size("w").alias("dl"), F.filter("w", lambda x: x.isin(terms)).alias("hits"))
    else:
        found = words.select("chunk_id", F.explode("w").alias("term")).join(wanted, "term", "left_semi").groupBy("chunk_id").agg(F.collect_list("term").alias("hits"))
        hits = words.select("chunk_id", F.size("w").alias("dl")).join(found, "chunk_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<string>")))
    hits = written(hits, "hits")
    stats = hits.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    postings = hits.where(F.size("hits") > 0).repartition("chunk_id").select("chunk_id", "dl", F.explode("hits").alias("term")).groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = hits.select(F.explode(F.array_distinct("hits")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(FLOOR))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(avgdl))))
    weighted = asked.join(df, "term").select("qid", "term", idf.alias("idf"))
    if asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        weighted = F.broadcast(weighted)  # no more rows than the queries have terms
    return postings.join(weighted, "term").groupBy("qid", "chunk_id").agg(F.sum(part).alias("score"))


def vector_topk(queries: DataFrame, vectors: DataFrame, top: int = TOP, block: int = QUERY_BLOCK) -> DataFrame:
    """qid, chunk_id, score and rank of the exact best dot products: queries(qid, qvec) against every row of vectors(chunk_id, vec); ties by chunk_id.

    With until (of queries) and day (of vectors), long or null, only vectors up to a query's day count. Queries are met in blocks of bounded size. Each task multiplies its vectors with a block and passes on no more than its own best `top` for each query."""
    spark = queries.sparkSession
    timed = "until" in queries.columns
    count = queries.count()
    parts = []
    for k in range(max(1, -(-count // block))):
        some = queries if count <= block else queries.where(F.pmod(F.xxhash64("qid"), F.lit(-(-count // block))) == k)
        known = spark.sparkContext.broadcast([(r["qid"], list(r["qvec"]), r["until"] if timed else None) for r in some.where("qvec is not null").collect()])

        def run(batches, known=known):
            import numpy as np
            import pyarrow as pa

            if not known.value:
                return
            ids = np.array([q for q, _, _ in known.value], np.int64)
            q = np.array([v for _, v, _ in known.value], np.float64)
            until = np.array([np.inf if u is None else u for _, _, u in known.value])[:, None]
            scores, chunks = np.full((len(ids), top), -np.inf), np.zeros((len(ids), top), np.int64)
            for b in batches:
                keep = [x for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True) if x[1] is not None]
                if not keep:
                    continue
                own = np.array([i for i, _, _ in keep], np.int64)
                dots = q @ np.array([v for _, v, _ in keep], np.float64).T
                dots[np.array([-np.inf if d is None else d for _, _, d in keep])[None, :] > until] = -np.inf
                s, c = np.concatenate([scores, dots], 1), np.concatenate([chunks, np.broadcast_to(own, dots.shape)], 1)
                pick = np.argpartition(-s, top - 1, axis=1)[:, :top]
                least = np.take_along_axis(s, pick, 1).min(1)
                for r in np.flatnonzero((s >= least[:, None]).sum(1) > top):  # ties across the cut
                    pick[r] = np.lexsort((c[r], -s[r]))[:top]
                scores, chunks = np.take_along_axis(s, pick, 1), np.take_along_axis(c, pick, 1)
            row, at = np.nonzero(scores > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(chunks[row, at]), pa.array(scores[row, at])], ["qid", "chunk_id", "score"])

        day = F.col("day") if timed else F.lit(None).cast("long")
        parts.append(vectors.select("chunk_id", "vec", day.alias("day")).mapInArrow(run, "qid long, chunk_id long, score double"))
    whole = parts[0]
    for other in parts[1:]:
        whole = whole.unionByName(other)
    return ranked(whole, "qid", "score", "chunk_id", top)


def rrf(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """qid, chunk_id and the sum of 1 / (k + rank) over ranked lists(qid, chunk_id, rank)."""
    whole = lists[0].select("qid", "chunk_id", "rank")
    for other in lists[1:]:
        whole = whole.unionByName(other.select("qid", "chunk_id", "rank"))
    return whole.groupBy("qid", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
