"""Contiguous sharding with the smallest possible largest shard (DataFrame functions only).

Rows are ordered by (hash of the text, doc_id); rows of equal text are one atomic group, so equal texts share a shard. The smallest capacity
for which a greedy walk over the groups needs at most `shards` shards is found by binary search, and the walk with that capacity gives the cuts.
Walking with the same capacity from the other end gives the least cuts that still suffice; each cut then goes as near to its equal share as the two walks allow, so that the
least shard is raised and the largest stays as it is.
A walk needs only 'the last group end at or below x'. The driver holds a summary of at most BINS bins of group ends (their least and greatest
end); it yields bounds for each walk, and only bins that a bound leaves open are summed up again, more finely, until the walk is exact. So what
is collected is bounded at any size of the input."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.base import Scratch

BINS = 1 << 13


class _Ends:
    """Bins of sorted group ends: (least, greatest, number)."""

    def __init__(self, bins: list[tuple[int, int, int]]):
        self.bins = sorted(bins)
        self.least = [b[0] for b in self.bins]

    def below(self, x: int) -> tuple[int, int]:
        """Bounds of the last end <= x (0 if none)."""
        k = bisect_right(self.least, x) - 1
        if k < 0:
            return 0, 0
        a, b, n = self.bins[k]
        return (b, b) if b <= x else (a, a if n <= 2 else x)

    def walk(self, capacity: int, shards: int) -> list[tuple[int, int]]:
        out, lo, hi = [], 0, 0
        for _ in range(shards):
            lo, hi = self.below(lo + capacity)[0], self.below(hi + capacity)[1]
            out.append((lo, hi))
        return out


def _search(ends: _Ends, total: int, shards: int) -> tuple[int, int]:
    """The least capacity that surely suffices and the least that may suffice."""
    found = []
    for side in (0, 1):
        lo, hi = max(0, -(-total // shards) - 1), total
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if ends.walk(mid, shards)[-1][side] >= total else (mid, hi)
        found.append(hi)
    return found[0], found[1]


def minimax_cuts(groups: DataFrame, total: int, shards: int, bins: int = BINS, capacity: int | None = None) -> tuple[list[int], int]:
    """The greatest end in each shard but the last of a walk with the least capacity (or that given), for groups(end) whose ends are distinct and at most `total`; and the capacity."""
    summed = lambda df, low, width: df.groupBy(F.floor((F.col("end") - low) / width).alias("b")).agg(F.min("end"), F.max("end"), F.count("*"))
    have = [tuple(r)[1:] for r in summed(groups, 0, max(1, -(-total // bins))).collect()]
    while True:
        ends = _Ends(have)
        sure, maybe = (capacity, capacity) if capacity else _search(ends, total, shards)
        low, high = ends.walk(maybe, shards), ends.walk(sure, shards)
        if sure == maybe and all(a == b for a, b in high):
            return [a for a, _ in high[:-1]], sure
        spans = [(a + 0, max(b, a)) for (a, _), (_, b) in zip(low, high, strict=True)]
        ranges: list[list[int]] = []  # at most one for each cut
        for a, b in sorted(spans):
            hit = [x for x in have if x[0] <= b and x[1] >= a]
            if all(x[2] <= 2 for x in hit):
                continue
            low_end, high_end = min(x[0] for x in hit), max(x[1] for x in hit)
            if ranges and low_end <= ranges[-1][1]:
                ranges[-1][1] = max(ranges[-1][1], high_end)
            else:
                ranges.append([low_end, high_end])
        inside = lambda x: any(a <= x[0] and x[1] <= b for a, b in ranges)
        pick = F.lit(None).cast("struct<k:int,b:bigint>")
        fine = []
        for k, (a, b) in enumerate(ranges):
            parts = max(2 * sum(a <= x[0] <= b for x in have), bins // len(ranges))  # or a bin would never close
            fine.append((k, a, b, max(1, -(-(b - a + 1) // parts))))
        for k, a, b, width in reversed(fine):
            pick = F.when(F.col("end").between(a, b), F.struct(F.lit(k).alias("k"), F.floor((F.col("end") - a) / width).alias("b"))).otherwise(pick)
        where = F.lit(False)
        for _, a, b, _ in fine:
            where = where | F.col("end").between(a, b)
        got = [tuple(r)[1:] for r in groups.where(where).groupBy(pick.alias("p")).agg(F.min("end"), F.max("end"), F.count("*")).collect()]
        have = [x for x in have if not inside(x)] + got


def even_cuts(groups: DataFrame, total: int, shards: int, bins: int = BINS) -> list[int]:
    """Cuts for groups(first, end) with the least possible largest shard, each as near below its equal share as that allows."""
    _, capacity = minimax_cuts(groups.select("end"), total, shards, bins)
    mirrored, _ = minimax_cuts(groups.select((total - F.col("first")).alias("end")), total, shards, bins, capacity)
    least = [total - c for c in reversed(mirrored)]  # cut k may not be less, or the rest does not fit
    near = groups.agg(*[F.max(F.when(F.col("end") <= k * total // shards, F.col("end"))) for k in range(1, shards)]).first() if shards > 1 else ()
    out, last = [], 0
    for low, wish in zip(least, near, strict=True):
        last = max(last, wish) if wish is not None and low <= wish <= last + capacity else max(last, low)
        out.append(last)
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 24, bins: int = BINS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row of docs(doc_id, text).

    size: UTF-8 bytes of the text plus 8. Null and empty texts are one group of size-8 rows. Ties in doc_id keep any order but get slots of their own; repeated rows are all returned. With fewer groups than shards the last shards stay empty. No rows in, no rows out."""
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce("text", F.lit(""))
    rows = scratch.cut(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("h")), "rows")
    at = F.monotonically_increasing_id()
    rows = scratch.cut(rows.repartitionByRange("h", "doc_id").sortWithinPartitions("h", "doc_id").withColumn("_at", at).select("*", F.shiftright("_at", 33).alias("_p"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_i")).drop("_at"), "sorted")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    parts = rows.groupBy("_p").agg(F.sum("size").alias("s"), F.count("*").alias("n")).select("_p", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("_s0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n0"))
    inside = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    rows = scratch.cut(rows.join(F.broadcast(parts), "_p").select("doc_id", "size", "text_crc32", "h", (F.col("_s0") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("start"), (F.col("_n0") + F.col("_i")).alias("row")), "placed")
    groups = scratch.cut(rows.groupBy("h").agg(F.min("start").alias("first"), F.max(F.col("start") + F.col("size")).alias("end"), (F.max("row") + 1).alias("rows")).drop("h"), "groups")
    total = groups.agg(F.max("end")).first()[0] or 0
    cuts = even_cuts(groups, total, shards, bins) if total else []
    upto = {r["end"]: r["rows"] for r in groups.where(F.col("end").isin(cuts)).collect()} if cuts else {}
    edges = [(0, 0)] + [(c, upto.get(c, 0)) for c in cuts]
    shard, first = F.lit(0), F.lit(0).cast("long")
    for k, (cut, n) in enumerate(edges):
        if k and cut < total:
            shard, first = F.when(F.col("start") >= cut, F.lit(k)).otherwise(shard), F.when(F.col("start") >= cut, F.lit(n).cast("long")).otherwise(first)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), shard.cast("int").alias("shard"), (F.col("row") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
