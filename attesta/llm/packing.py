"""Hierarchical multi-length packing of tokenised documents.

Documents are routed to context tiers (2048, 1024, 512 and 256 tokens). Whole windows of the longest tier are cut off first; the remainder
goes to the least tier that holds it. Each tier is packed from its longest document on; gaps of longer windows are filled from shorter
tiers, whole documents first and then by one cut. So windows end full; what a task has left at its end leaves in power-of-two pieces. The windows of a
tier are dealt into step groups of equal tokens with near-equal attention cost (sum of squared piece lengths).

Tasks pack what they read: there is no shuffle. A task holds at most BUFFER_TOKENS and one batch of documents."""

from __future__ import annotations

import sys
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from attesta.llm.base import map_arrow, texts_of

TIERS = (2048, 1024, 512, 256)
END_ID = 1
BUFFER_TOKENS = 1 << 20
STEP_TOKENS = 16_384
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
_WORDS = 700_000
_STOPS = frozenset((b".", b",", b";", b":", b"!", b"?"))
_tokenizers: dict[str, WordIds] = {}


class WordIds(dict):
    """A word's ids as little-endian uint32 bytes; white space never joins two words in these vocabularies. Bounded: when full, the words become the older half, from which those that come again return."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        out = self.older.get(word)
        if out is None and word.isascii() and b"<|" not in word:  # the vocabulary's own lower-casing and splitting, done before the lookup
            low = word.lower()
            if low != word:
                out = self[low]
            elif len(word) > 1 and word[-1:] in _STOPS and word[-2:-1].isalnum():
                out = self[word[:-1]] + self[word[-1:]]
        if out is None:
            ids = array("I", self.encode(word.decode(), add_special_tokens=False).ids)
            if sys.byteorder == "big":
                ids.byteswap()
            out = ids.tobytes()
        if len(word) < 64:
            if len(self) >= _WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = out
        return out

    def text(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def word_ids(path: str) -> WordIds:
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


class Packer:
    """Pieces are (length, number, start): `number` finds doc_id, ids and doc_tokens. `base` is added to sequence and step ids."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, base: int = 0, step_tokens: int = STEP_TOKENS):
        self.tiers, self.base, self.step_tokens = tuple(sorted(tiers, reverse=True)), base, step_tokens
        self.docs: dict[int, tuple[int, bytes, int]] = {}
        self.number = self.sequences = self.steps = self.held = 0
        self.waiting: list[tuple[int, int, int]] = []
        self.windows: list[tuple[int, list[tuple[int, int, int]]]] = []

    def add(self, doc_id: int, ids: bytes) -> None:
        n, top = len(ids) // 4, self.tiers[0]
        self.number += 1
        self.docs[self.number] = (doc_id, ids, n)
        start = 0
        while n - start >= top:
            self.windows.append((top, [(top, self.number, start)]))
            start += top
        if start < n:
            self.waiting.append((n - start, self.number, start))
        self.held += n

    def _pack(self, last: bool) -> None:
        tiers = self.tiers
        at = lambda n: next(t for t in reversed(tiers) if t >= n)
        pools: dict[int, list] = {t: [] for t in tiers}
        for x in sorted(self.waiting):
            pools[at(x[0])].append(x)
        self.waiting = []
        for t in tiers:
            while pools[t]:
                window = [pools[t].pop()]
                gap = t - window[0][0]
                while gap:
                    fit = next(((p, k) for p in (pools[s] for s in tiers) if (k := bisect_right(p, (gap, 1 << 62, 0)) - 1) >= 0), None)
                    if fit:
                        window.append(fit[0].pop(fit[1]))
                        gap -= window[-1][0]
                        continue
                    longer = next((p for p in (pools[s] for s in reversed(tiers)) if p and p[-1][0] > gap), None)
                    if longer is None:
                        break
                    n, number, start = longer.pop(bisect_left(longer, (gap + 1, 0, 0)))
                    window.append((gap, number, start))
                    insort(pools[at(n - gap)], (n - gap, number, start + gap))
                    gap = 0
                if not gap:
                    self.windows.append((t, window))
                elif last:
                    self._powers(window)
                else:
                    self.waiting += window

    def _powers(self, window: list[tuple[int, int, int]]) -> None:
        """The rest of a task, as sequences whose lengths are powers of two: no padding."""
        left = sum(x[0] for x in window)
        while left:
            size = 1 << (left.bit_length() - 1)
            left, need, out = left - size, size, []
            while need:
                n, number, start = window.pop(0)
                out.append((min(n, need), number, start))
                if n > need:
                    window.insert(0, (n - need, number, start + need))
                need -= out[-1][0]
            self.windows.append((size, out))

    def rows(self, last: bool) -> Iterator[tuple]:
        self._pack(last)
        by_tier: dict[int, list] = {}
        for size, window in self.windows:
            by_tier.setdefault(size, []).append((sum(x[0] * x[0] for x in window), window))
        self.windows = []
        for size, group in sorted(by_tier.items(), reverse=True):
            group.sort(key=lambda g: -g[0])
            steps = -(-len(group) * size // self.step_tokens)
            for k, (_, window) in enumerate(group):
                turn, place = divmod(k, steps)
                step = self.steps + (place if turn % 2 == 0 else steps - 1 - place)  # forth and back: each step gets dear and cheap windows
                offset = 0
                for n, number, start in window:
                    doc_id, ids, total = self.docs[number]
                    yield doc_id, start, n, ids[4 * start : 4 * (start + n)], total, self.base + self.sequences, offset, size, self.base + step
                    offset += n
                self.sequences += 1
            self.steps += steps
        kept = {x[1] for x in self.waiting}
        self.docs = {k: v for k, v in self.docs.items() if k in kept}
        self.held = sum(x[0] for x in self.waiting)


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, buffer_tokens: int = BUFFER_TOKENS) -> DataFrame:
    """Packs every row of docs(doc_id, text); one row for each piece, with its ids as little-endian uint32 bytes.

    Null and empty texts are the end id alone. Repeated rows are packed each. Other columns are ignored; no rows in, no rows out. A document may be cut anywhere; each of its ids is in exactly one piece."""
    end = end_id.to_bytes(4, "little")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = word_ids(tokenizer), Packer(tiers, TaskContext.get().partitionId() << 36)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                packer.add(doc_id, words.text(text) + end)
                if packer.held >= buffer_tokens and (rows := list(packer.rows(False))):
                    yield batch(rows)
        if rows := list(packer.rows(True)):
            yield batch(rows)

    return map_arrow(docs.select("doc_id", "text"), run, SCHEMA)
