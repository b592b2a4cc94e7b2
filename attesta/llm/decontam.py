"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the number of their shingles into classes (m/2, m], the first of which is all up to SMALLEST. For a class, a document is covered by
windows of 2m shingles at every m, so that a passage of m shingles lies whole in one of them and its Jaccard similarity with the window is far from zero however long
the document is. Windows of a class are unions of windows of the class below, so signatures are made once for the smallest blocks and doubled up by
minima. A window whose signature agrees with an item's in one of HASHES places makes the pair a candidate; with similarity s a pair whose shared shingles lie in one window is
missed with probability (1 - s) ** HASHES: at the least similarity that 0.8 containment allows (about 0.19) below 2e-6.

That bound needs more than EXACT_MOST shingles, all different. Other items are looked up exactly by shingle hash: a document with 0.8 of an item's shingles
has one of any that are one more than it may lack. Candidates are verified by exact containment of the item's distinct shingles in the whole document.

Documents are not shuffled. Items are the query set: they are collected in blocks of at most ITEM_BLOCK, one pass for each block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.base import map_arrow, texts_of
from attesta.llm.words import U64, WordHash, lower_ascii, rolling

SHINGLE, MIN_CONTAINMENT = 5, (8, 10)
HASHES, SMALLEST = 64, 16
#: Items of up to so many distinct shingles are looked up exactly.
EXACT_MOST = 8
#: Items, and bytes of their texts, in a block; a longer item is a block of its own size.
ITEM_BLOCK, ITEM_BYTES = 20_000, 64 << 20
DOCS_AT_ONCE = 128
SCHEMA = "doc_id long, item_id long, item_shingles long, shared_shingles long"
#: Shingle hashes are mixed already; an odd factor permutes them, and each factor orders them anew.
_MULT = (np.random.default_rng(12).integers(1, 1 << 62, HASHES, dtype=np.uint64) << U64(1)) | U64(1)
_TABLE_BITS, _EXACT_BITS = 16, 20


def _shingles(words: list[bytes], width: int) -> list[bytes]:
    return [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


def _values(shingles: np.ndarray) -> np.ndarray:
    """HASHES x shingles."""
    return shingles[None, :] * _MULT[:, None]


class Items:
    """The signatures of a block of items by size class, for lookup of windows."""

    def __init__(self, rows: list[tuple[int, bytes]], width: int):
        self.width = width
        self.sets: list[tuple[int, frozenset[bytes], int]] = []
        classes: dict[int, list[int]] = {}
        self.short: dict[int, dict[bytes, list[int]]] = {}
        signs, hasher, exact = {}, WordHash(100_000), []
        for item_id, text in rows:
            words = lower_ascii(text).split()
            w, k = min(width, len(words)), len(self.sets)
            if not w:
                continue
            shingles = frozenset(_shingles(words, w))
            self.sets.append((item_id, shingles, w))
            if w < width:  # one shingle of all the words: found by equality
                self.short.setdefault(w, {}).setdefault(next(iter(shingles)), []).append(k)
                continue
            hashes = rolling(hasher.of(words), width)
            own = np.unique(hashes)
            if len(own) <= EXACT_MOST or len(own) < len(hashes):
                num, den = MIN_CONTAINMENT
                exact.append((own[: len(own) + 1 + -len(own) * num // den], k))  # -(-n * num // den) are needed
            else:
                signs[k] = _values(hashes).min(axis=1)
                classes.setdefault((-(-(len(words) - w + 1) // SMALLEST) - 1).bit_length(), []).append(k)
        keys = np.concatenate([x for x, _ in exact] or [np.empty(0, U64)])
        order = np.argsort(keys, kind="stable")
        self.exact, self.exact_items = keys[order], np.repeat([k for _, k in exact], [len(x) for x, _ in exact]).astype(np.int64)[order]
        self.exact_table = np.zeros(1 << _EXACT_BITS, bool)
        self.exact_table[(keys >> U64(64 - _EXACT_BITS)).astype(np.int64)] = True
        self.levels: dict[int, tuple[list[np.ndarray], list[np.ndarray], np.ndarray]] = {}
        for level, members in classes.items():
            sign = np.stack([signs[k] for k in members])
            order = np.argsort(sign, axis=0)
            table = np.zeros((HASHES, 1 << _TABLE_BITS), bool)
            for h in range(HASHES):
                table[h, (sign[:, h] >> U64(64 - _TABLE_BITS)).astype(np.int64)] = True
            self.levels[level] = ([sign[order[:, h], h] for h in range(HASHES)], [np.array(members)[order[:, h]] for h in range(HASHES)], table)

    def candidates(self, cut: list[list[bytes]], hasher: WordHash) -> list[set[int]]:
        """For each document's words, numbers of items that share a signature value with a window of it, or a looked-up shingle with it.

        Documents stand one after another, each from a block's start; a window that reaches into the next document proposes for both."""
        found: list[set[int]] = [set() for _ in cut]
        picked = [k for k, words in enumerate(cut) if len(words) >= self.width]
        if not picked or not (self.levels or len(self.exact)):
            return found
        sizes = np.array([len(cut[k]) for k in picked])
        ends = np.cumsum(sizes)
        whole = rolling(np.concatenate([hasher.of(cut[k]) for k in picked]), self.width)
        if len(self.exact):
            at = np.flatnonzero(self.exact_table[(whole >> U64(64 - _EXACT_BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(self.exact, whole[at], "left"), np.searchsorted(self.exact, whole[at], "right")
            for p, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                found[picked[int(np.searchsorted(ends, p, "right"))]].update(self.exact_items[a:b].tolist())
        if not self.levels:
            return found
        starts = [np.arange(a, a + n - self.width + 1, SMALLEST) for a, n in zip((ends - sizes).tolist(), sizes.tolist(), strict=True)]
        counts = [len(s) for s in starts]
        owner, starts = np.repeat(np.array(picked), counts), np.concatenate(starts)
        stops = np.minimum(starts + SMALLEST, np.repeat(ends - self.width + 1, counts))
        lens = stops - starts
        take = np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
        shingles, begins = whole[take], np.cumsum(lens) - lens
        sign = np.empty((HASHES, len(starts)), U64)
        for a in range(0, len(starts), 32):  # 32 blocks at a time stay in the cache
            b = min(len(starts), a + 32)
            stop = begins[b] if b < len(starts) else len(shingles)
            sign[:, a:b] = np.minimum.reduceat(_values(shingles[begins[a] : stop]), begins[a:b] - begins[a], axis=1)
        for level in range(max(self.levels) + 1):
            if level in self.levels:
                values, members, table = self.levels[level]
                window = np.minimum(sign[:, :-1], sign[:, 1:]) if sign.shape[1] > 1 else sign
                hit_h, hit_w = np.nonzero(table[np.arange(HASHES)[:, None], (window >> U64(64 - _TABLE_BITS)).astype(np.int64)])
                for h in np.unique(hit_h):
                    at = hit_w[hit_h == h]
                    lo, hi = np.searchsorted(values[h], window[h, at], "left"), np.searchsorted(values[h], window[h, at], "right")
                    for w, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                        items = members[h][a:b].tolist()
                        for doc in np.unique(owner[w << level : (w + 2) << level]).tolist():
                            found[doc].update(items)
            if sign.shape[1] > 1:
                if sign.shape[1] % 2:
                    sign = np.concatenate([sign, sign[:, -1:]], axis=1)
                sign = np.minimum(sign[:, ::2], sign[:, 1::2])
        return found

    def matches(self, texts: list[bytes], hasher: WordHash) -> Iterator[list[tuple[int, int, int]]]:
        """For each text, (item_id, distinct shingles of the item, how many of them are in the text) of each verified item."""
        for k in range(0, len(texts), DOCS_AT_ONCE):
            cut = [lower_ascii(t).split() for t in texts[k : k + DOCS_AT_ONCE]]
            for words, picked in zip(cut, self.candidates(cut, hasher), strict=True):
                yield self._verified(words, picked)

    def _verified(self, words: list[bytes], picked: set[int]) -> list[tuple[int, int, int]]:
        for w, table in self.short.items():
            for s in set(_shingles(words, w)) & table.keys():
                picked.update(table[s])
        own = {w: set(_shingles(words, w)) for w in {self.sets[k][2] for k in picked}}
        num, den = MIN_CONTAINMENT
        out = []
        for k in sorted(picked):
            item_id, shingles, w = self.sets[k]
            shared = len(shingles & own[w])
            if shared * den >= num * len(shingles):
                out.append((item_id, len(shingles), shared))
        return out


def contained_items(docs: DataFrame, items: DataFrame, width: int = SHINGLE, block: int = ITEM_BLOCK) -> DataFrame:
    """doc_id, item_id, item_shingles and shared_shingles of every pair in which at least 0.8 of the item's distinct word shingles are in the document.

    A-Z is lower-cased; an item with fewer than `width` words is one shingle of them all; one without words or with null text matches nothing. Null and empty documents match nothing. Repeated rows give repeated pairs. Empty tables give no pairs. Other columns are ignored."""
    out = None
    for known in _blocks(items, block):

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            own, hasher = Items(known.value, width), WordHash()
            for b in batches:
                got = [(doc_id, *m) for doc_id, found in zip(b.column(0).to_pylist(), own.matches(texts_of(b.column(1)), hasher), strict=True) for m in found]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], ["doc_id", "item_id", "item_shingles", "shared_shingles"])

        found = map_arrow(docs.select("doc_id", "text"), run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def _blocks(items: DataFrame, block: int) -> list[Broadcast]:
    """The items in blocks of bounded number and size, sorted, one at least."""
    rows = items.select("item_id", "text").where("text is not null")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // block), -(-size // ITEM_BYTES))
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    parts = (rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) for k in range(blocks))
    return [items.sparkSession.sparkContext.broadcast([(i, t.encode()) for i, t in sorted(map(tuple, part.collect()), key=order)]) for part in parts]


def without_items(docs: DataFrame, items: DataFrame, width: int = SHINGLE, block: int = ITEM_BLOCK) -> DataFrame:
    """The rows of docs, with all their columns, that contain no item. One pass for each block of items: each task drops the rows for which the search finds an item.

    Rows with null or empty text hold no item and stay; repeated rows stay or go together; without items all stay."""
    rows = docs.select(F.col("text").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    for known in _blocks(items, block):

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            own, hasher = Items(known.value, width), WordHash()
            for b in batches:
                keep = [not found for found in own.matches(texts_of(b.column(0)), hasher)]
                yield b.filter(pa.array(keep, pa.bool_()))

        rows = map_arrow(rows, run, rows.schema)
    return rows.select("row.*")
