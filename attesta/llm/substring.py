"""Substring deduplication with fixed-block anchors.

A window of `width` words holds one whole block of `block` words at a multiple of `block`, if width = 2 * block - 1. So every repeat of a window is
anchored: the reference document's aligned blocks are the index, and every rolling window of `block` words of a document probes it.

1. Index and probes meet by hash range as packed arrays (32 bits an entry beside the range). A hash is live if several documents have it, one of them as
   an aligned block; each document gets its live hashes back.
2. A document's live anchors extend to the windows around them; only these get a 128-bit digest of their words, and the least document of each digest is found.
3. A window whose digest has a smaller first document is removed; the union of such windows is the union of the maximal repeats.

Entries travel packed, so a shuffle moves 4 bytes for a probe and 20 for a candidate window, and a task of either meeting holds one hash range: its size is set by BUCKET_BYTES,
not by the input. What the documents of one flush share is settled there first, and one of them stands for it in the range: a passage that a third of all
documents have adds one entry for each flush (FLUSH entries, about 25 MB of text), not for each document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from attesta.llm.base import Scratch, map_arrow, small_batches, texts_of
from attesta.llm.words import ENTRIES, U64, WordHash, pack_entries, rolling, runs

WIDTH, BLOCK = 13, 7
BUCKET_BYTES, FLUSH = 32 << 20, 1_500_000


def _places(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 31-bit key of each hash."""
    return (hashes >> U64(33)) % U64(buckets), hashes & U64(0x7FFFFFFF)


def _entries(width: int, block: int, buckets: int, flush: int) -> object:
    """Packed index and probe entries by hash range: the key, then 0 for an aligned block.

    Of a key that several documents of one flush have, one entry goes to the range (aligned if any of them is) and the live keys of these documents go past it, in rows of a
    group of their own (`meet` below 0). So a range gets one entry of a key for each flush, however many documents share it."""
    bits = max(1, (buckets - 1).bit_length())
    most_docs = 1 << (31 - bits)
    low = U64(32 - bits)

    def split(docs: list[int], parts: list[np.ndarray], place: int) -> Iterator[pa.RecordBatch]:
        flat = np.concatenate(parts)  # range, key, document, probe
        flat.sort()
        starts, ends = runs(flat >> low)
        doc = (flat >> U64(1)) & U64(most_docs - 1)
        many = np.repeat(doc[starts] != doc[ends - 1], ends - starts)
        probe = np.minimum.reduceat(flat & U64(1), starts)
        rest = np.append(flat[~many], (flat[starts] >> U64(1) << U64(1) | probe)[many[starts]])

        def spread(x: np.ndarray) -> np.ndarray:
            """range, document, key, probe"""
            return (x >> U64(63 - bits) << U64(63 - bits)) | ((x >> U64(1) & U64(most_docs - 1)) << U64(32)) | (x >> low & U64(0x7FFFFFFF)) << U64(1) | x & U64(1)

        for x, meet in ((spread(rest), None), (spread(flat[many]) & ~U64(1), place)):
            if len(x):
                b = pack_entries(docs, [x], bits)
                yield b.append_column("meet", b.column(0) if meet is None else pa.array([meet] * b.num_rows, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, place = WordHash(), -1 - (TaskContext.get().partitionId() << 24)
        docs, parts, held = [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                words = text.split()
                if doc_id is None or len(words) < width:
                    continue
                bucket, key = _places(rolling(hasher.of(words), block), buckets)
                probe = np.ones(len(key), U64)
                probe[::block] = 0
                parts.append((bucket << U64(63 - bits)) | (key << low) | (U64(len(docs)) << U64(1)) | probe)
                docs.append(doc_id)
                held += len(key)
                if held >= flush or len(docs) >= most_docs:
                    yield from split(docs, parts, place)
                    docs, parts, held, place = [], [], 0, place - 1
        if docs:
            yield from split(docs, parts, place)

    return run


def _live(rows: pa.Table) -> pa.Table:
    """The live keys of each document in one hash range, or those that a flush found by itself."""
    if rows["meet"][0].as_py() < 0:
        out: list[tuple[int, int, bytes]] = []
        for bucket, keys, docs, lens in zip(*(rows[x].to_pylist() for x in ("bucket", "keys", "docs", "lens")), strict=True):
            keys, ends = np.frombuffer(keys, np.uint32) >> 1, np.cumsum(np.frombuffer(lens, np.uint32))
            out += [(d, bucket, keys[b - n : b].tobytes()) for d, b, n in zip(np.frombuffer(docs, np.int64).tolist(), ends.tolist(), np.frombuffer(lens, np.uint32).tolist(), strict=True)]
        return pa.table({"doc_id": pa.array([x[0] for x in out], pa.int64()), "bucket": pa.array([x[1] for x in out], pa.int64()), "live": pa.array([x[2] for x in out], pa.binary())})
    keys = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["keys"].to_pylist()])
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in rows["docs"].to_pylist()])
    lens = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["lens"].to_pylist()])
    names, rank = np.unique(ids, return_inverse=True)
    flat = ((keys >> 1).astype(U64) << U64(33)) | (np.repeat(rank.astype(U64), lens) << U64(1)) | (keys & 1).astype(U64)
    del keys, ids, lens, rank
    flat.sort()
    starts, ends = runs(flat >> U64(33))
    doc = (flat >> U64(1)) & U64(0xFFFFFFFF)
    live = (doc[starts] != doc[ends - 1]) & (np.minimum.reduceat(flat & U64(1), starts) == 0)  # several documents, one of them with an aligned block
    keep = np.repeat(live, ends - starts)
    doc, key = doc[keep], (flat[keep] >> U64(33)).astype(np.uint32)
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    starts, ends = runs(doc)
    return pa.table({
        "doc_id": pa.array(names[doc[starts].astype(np.int64)], pa.int64()), "bucket": pa.array([rows["bucket"][0].as_py()] * len(starts), pa.int64()),
        "live": pa.array([key[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
    })


def _windows(width: int, block: int, buckets: int, flush: int) -> object:
    """Windows around live anchors, packed by bucket: 128-bit digests of their words, their starts, and the rows (doc_id, tag) with the number of windows of each.

    Of the documents of one flush with the same window, the one with the least id asks the hash range; for the others the answer is known, and they go past it in rows of a group of their own (`bucket` below 0)."""

    def pack(rows: list[tuple[int, int]], begins: list[np.ndarray], digests: list[bytes], place: int) -> pa.RecordBatch:
        keys = np.frombuffer(b"".join(digests), U64).reshape(-1, 2)
        starts = np.concatenate(begins).astype(np.int32)
        row = np.repeat(np.arange(len(rows)), [len(x) for x in begins])
        ids, tags = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int32)
        gone = np.zeros(len(keys), bool)
        gone[_not_first(keys, ids[row])] = True
        bucket = np.where(gone, place, ((keys[:, 0] >> U64(20)) % U64(buckets)).astype(np.int64))
        order = np.argsort(bucket, kind="stable")  # by row within a bucket
        bucket, row, keys, starts = bucket[order], row[order], keys[order], starts[order]
        out = []
        for a, b in zip(*runs(bucket), strict=True):
            first, _ = runs(row[a:b])
            lens = np.diff(np.append(first, b - a)).astype(np.uint32)
            which = row[a:b][first]
            out.append((int(bucket[a]), keys[a:b].tobytes() if bucket[a] >= 0 else b"", starts[a:b].tobytes(), ids[which].tobytes(), tags[which].tobytes(), lens.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.binary()) for k, c in enumerate(zip(*out, strict=True))], ["bucket", "keys", "starts", "docs", "tags", "lens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, place = WordHash(), -1 - (TaskContext.get().partitionId() << 24)
        rows, begins, digests, seen = [], [], [], set()
        for b in batches:
            for doc_id, tag, live, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), texts_of(b.column(3)), strict=True):
                words = text.split()
                if len(words) < width or (doc_id, tag) in seen:  # a repeated row gets the answer of the first
                    continue
                bucket, key = _places(rolling(hasher.of(words), block), buckets)
                want = np.concatenate([np.frombuffer(x["live"], np.uint32).astype(U64) | (U64(x["bucket"]) << U64(32)) for x in live])
                anchors = np.flatnonzero(np.isin((bucket << U64(32)) | key, want))
                mark = np.zeros(len(words) + 2, np.int32)
                np.add.at(mark, np.maximum(anchors - (width - block), 0), 1)
                np.add.at(mark, anchors + 1, -1)
                at = np.flatnonzero(np.cumsum(mark)[: len(words) - width + 1] > 0)
                if len(at):
                    seen.add((doc_id, tag))
                    rows.append((doc_id, tag))
                    begins.append(at)
                    digests += [xxhash.xxh3_128_digest(b" ".join(words[k : k + width])) for k in at.tolist()]
                if len(digests) >= flush // 8:
                    yield pack(rows, begins, digests, place)
                    rows, begins, digests, seen, place = [], [], [], set(), place - 1
        if rows:
            yield pack(rows, begins, digests, place)

    return run


def _not_first(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Positions, in order, of the windows whose digest a smaller document has."""
    order = np.lexsort((docs, keys[:, 1], keys[:, 0]))
    keys = keys[order]
    begin = np.append(True, (keys[1:] != keys[:-1]).any(axis=1))
    first = docs[order][np.maximum.accumulate(np.where(begin, np.arange(len(order)), 0))]
    return np.sort(order[docs[order] > first])


def _later(rows: pa.Table) -> pa.Table:
    """Starts of the windows whose digest a smaller document has, by (doc_id, tag)."""
    read = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in rows[name].to_pylist()])
    keys, lens = read("keys", U64).reshape(-1, 2), read("lens", np.uint32)
    run = np.repeat(np.arange(len(lens)), lens)
    ids, tags, starts = read("docs", np.int64), read("tags", np.int32), read("starts", np.int32)
    gone = _not_first(keys, ids[run]) if rows["bucket"][0].as_py() >= 0 else np.arange(len(run))
    run, starts = run[gone], starts[gone]
    at, ends = runs(run)
    return pa.table({"doc_id": pa.array(ids[run[at]], pa.int64()), "tag": pa.array(tags[run[at]], pa.int32()), "starts": pa.array([starts[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary())})


def _cut(width: int) -> object:
    """Adds n_words, n_removed and kept to rows whose first two columns are the text and the starts of removed windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, kept = [], [], []
            for text, starts in zip(texts_of(b.column(0)), b.column(1), strict=True):
                words = text.split()
                n.append(len(words))
                if starts.is_valid:
                    mark = np.zeros(len(words) + 1, np.int32)
                    at = np.unique(np.concatenate([np.frombuffer(x, np.int32) for x in starts.as_py()]))
                    np.add.at(mark, at, 1)
                    np.add.at(mark, at + width, -1)
                    stay = np.flatnonzero(np.cumsum(mark)[:-1] == 0)
                    gone.append(len(words) - len(stay))
                    words = [words[k] for k in stay.tolist()]
                else:
                    gone.append(0)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [*b.schema.names[2:], "n_words", "n_removed", "kept"])

    return run


def _removed(docs: DataFrame, scratch: Scratch, width: int, block: int, flush: int) -> DataFrame:
    """doc_id, tag and starts (of windows to remove). tag: a hash of the text, so that rows with one doc_id and different texts don't mix."""
    if width != 2 * block - 1:
        raise ValueError("a window must hold exactly one aligned block: width = 2 * block - 1")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(12, -(-size // BUCKET_BYTES))
    entries = map_arrow(docs.select("doc_id", "text"), _entries(width, block, buckets, flush), f"{ENTRIES}, meet long")
    live = scratch.cut(entries.groupBy("meet").applyInArrow(_live, "doc_id long, bucket long, live binary"), "live")
    mine = live.groupBy("doc_id").agg(F.collect_list(F.struct("bucket", "live")).alias("live"))  # at most the document's own anchors
    candidates = docs.select("doc_id", F.hash("text").alias("tag"), "text").join(mine, "doc_id").select("doc_id", "tag", "live", "text")
    windows = map_arrow(candidates, _windows(width, block, buckets, flush), "bucket long, keys binary, starts binary, docs binary, tags binary, lens binary")
    removed = scratch.cut(windows.groupBy("bucket").applyInArrow(_later, "doc_id long, tag int, starts binary"), "removed")
    scratch.drop("live")
    return removed.groupBy("doc_id", "tag").agg(F.collect_list("starts").alias("starts"))  # at most the document's own words


def remove_repeats(docs: DataFrame, width: int = WIDTH, block: int = BLOCK, flush: int = FLUSH) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words joined by one space) for every row of docs(doc_id, text): words covered by a window that also starts in a document with a smaller doc_id are removed.

    Null texts have no words. A null doc_id is neither smaller nor larger: its row stays whole. Rows that share a doc_id are one document to the order, so they don't remove each other. Texts under `width` words stay whole. Other columns are ignored; no rows in, no rows out."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "repeats")
    removed = _removed(docs, scratch, width, block, flush)
    rows = docs.select("doc_id", F.hash("text").alias("tag"), "text").join(removed, ["doc_id", "tag"], "left").select("text", "starts", "doc_id")
    return map_arrow(rows, _cut(width), "doc_id long, n_words long, n_removed long, kept string")


def with_repeats_removed(docs: DataFrame, width: int = WIDTH, block: int = BLOCK, flush: int = FLUSH) -> DataFrame:
    """docs with all columns; a text that loses words becomes its kept words joined by one space, and n_chars (if there) its length. Other texts stay as they are."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "repeats")
    removed = _removed(docs, scratch, width, block, flush).withColumnRenamed("doc_id", "_doc_id").withColumnRenamed("tag", "_tag")
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.hash("text").alias("tag"), F.col("text").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.join(removed, (F.col("doc_id") == F.col("_doc_id")) & (F.col("tag") == F.col("_tag")), "left")
    lost = map_arrow(rows.select("text", "starts", "row"), _cut(width), StructType([StructField("row", docs.schema)]).add("n_words", "long").add("n_removed", "long").add("kept", "string"))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    new = {"text": text.alias("text"), "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept")).otherwise(F.col("row.n_chars")).cast("long").alias("n_chars")} if "n_chars" in docs.columns else {"text": text.alias("text")}
    return lost.select(*[new.get(c, F.col(f"row.`{c}`").alias(c)) for c in docs.columns])
