"""Selection of windows, consolidation by source, and the verdict on a claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIM_FLOOR, SIM_STRONG, NLI_STRONG = 0.38, 0.43, 0.72
WINDOWS_PER_SOURCE, SOURCES_PER_CLAIM = 3, 6
VERDICTS = ("SUPPORTED", "REFUTED", "NOT_ENOUGH_EVIDENCE", "CONFLICTING_EVIDENCE")


def select_windows(scored: DataFrame, k: int = WINDOWS_PER_SOURCE, n: int = SOURCES_PER_CLAIM) -> DataFrame:
    """scored(claim_id, source_ord, grp, win_ord, similarity): the best k windows of each source, from at most n sources; the best source of each group comes before repeats of a group."""
    scored = scored.where(F.col("similarity") >= SIM_FLOOR)
    top = scored.withColumn("win_rank", F.row_number().over(Window.partitionBy("claim_id", "source_ord").orderBy(F.desc("similarity"), "win_ord"))).where(F.col("win_rank") <= k)
    sources = top.where("win_rank = 1").select("claim_id", "source_ord", "grp", F.col("similarity").alias("best"))
    inside = F.row_number().over(Window.partitionBy("claim_id", "grp").orderBy(F.desc("best"), "source_ord"))
    picked = sources.withColumn("again", (inside > 1).cast("int"))
    picked = picked.withColumn("source_rank", F.row_number().over(Window.partitionBy("claim_id").orderBy("again", F.desc("best"), "source_ord"))).where(F.col("source_rank") <= n)
    return top.join(picked.select("claim_id", "source_ord", "source_rank"), ["claim_id", "source_ord"])


def strong(similarity: Column, nli: Column) -> Column:
    return (similarity >= SIM_STRONG) & (nli >= NLI_STRONG)


def verdicts(claims: DataFrame, items: DataFrame) -> DataFrame:
    """claim_id, verdict and independent_sources for every row of claims, from items(claim_id, grp, relation, similarity, nli). Claims without evidence stay."""
    good = items.where(strong(F.col("similarity"), F.col("nli"))).groupBy("claim_id", "grp").agg(F.max((F.col("relation") == "entailment").cast("int")).alias("s"), F.max((F.col("relation") == "contradiction").cast("int")).alias("r"))
    sums = good.groupBy("claim_id").agg(F.sum("s").alias("s"), F.sum("r").alias("r"), F.sum(F.greatest("s", "r")).alias("independent_sources"))
    s, r = F.coalesce("s", F.lit(0)), F.coalesce("r", F.lit(0))
    verdict = F.when((s > 0) & (r > 0), VERDICTS[3]).when(r > 0, VERDICTS[1]).when(s > 0, VERDICTS[0]).otherwise(VERDICTS[2])
    return claims.join(sums, "claim_id", "left").select("claim_id", verdict.alias("verdict"), F.coalesce("independent_sources", F.lit(0)).alias("independent_sources"))


def consolidate(scored: DataFrame) -> DataFrame:
    """Of each (claim_id, source_ord), the windows with the greatest entailment and contradiction probability (the first of equals), once if they are the same; relation: the likeliest label."""
    key = ["claim_id", "source_ord"]
    best = lambda c: F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(c), "win_ord"))
    both = scored.withColumns({"_e": best("p_ent"), "_c": best("p_con")}).where("_e = 1 or _c = 1").drop("_e", "_c")
    relation = F.when((F.col("p_ent") >= F.col("p_neu")) & (F.col("p_ent") >= F.col("p_con")), "entailment").when(F.col("p_neu") >= F.col("p_con"), "neutral").otherwise("contradiction")
    return both.withColumn("relation", relation)


def shift(p_ent: Column, p_neu: Column, p_con: Column, block_ent: Column, block_con: Column) -> Column:
    """Moves the mass of blocked relations to neutral; it never raises the other two."""
    return F.struct(F.when(block_ent, 0.0).otherwise(p_ent).alias("p_ent"), (p_neu + F.when(block_ent, p_ent).otherwise(0.0) + F.when(block_con, p_con).otherwise(0.0)).alias("p_neu"), F.when(block_con, 0.0).otherwise(p_con).alias("p_con"))
