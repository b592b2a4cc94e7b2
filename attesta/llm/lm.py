"""Brown-style class bigram model: exchange clustering, class transitions and word emissions.

Every word of the training documents is counted and gets a class of its own choice. The driver clusters a core: the FREQUENT most frequent words and, for all
other words, groups by their last letters; exchange moves one unit at a time to the class that most raises the likelihood of the class bigrams. Then all
other training words, however many there are, leave their groups: each word's counts of neighbouring classes are made in Spark, and it goes to the class that
makes them likeliest (ROUNDS times, by the class bigrams of the round before). Only words that training never saw go by their last letters. A word's probability in its class comes from its own count, less what Good and Turing
leave to unseen words.

Counts and classes of all words don't fit one machine, so they are not collected. Documents are dealt into buckets by id; a bucket asks for its distinct words,
requests meet by hash range, sums and moves are made there, and the answers return to the bucket. A bucket's texts are kept as numbers of its words."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.base import Scratch, map_arrow, shuffles_end_with_the_query, small_batches, texts_of
from attesta.llm.words import U64, lower_ascii, runs

FREQUENT, SUFFIX_BITS, SUFFIX_BYTES = 2048, 10, 3
SUFFIXES = 1 << SUFFIX_BITS
CLASSES, SWEEPS = 64, 6
#: Rounds of exchange over all words outside the core.
ROUNDS = 1
KINDS = CLASSES + 1
#: Text in a bucket of documents, and in one part of its texts.
BUCKET_BYTES, PART_BYTES = 12 << 20, 2 << 20
#: Tables of so many tasks are added up in one, level by level.
TREE = 64
_MASK = U64(SUFFIXES - 1)
_S, _N = U64(32), U64((1 << 32) - 1)
END_ID = (xxhash.xxh3_64_intdigest(b"\n") >> SUFFIX_BITS << SUFFIX_BITS) | (SUFFIXES - 1)  # no word holds a line end, and no word has the last suffix


class _Ids(dict):
    """Word -> id: 54 bits of xxh3 above the hash of its last bytes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 250_000:
            self.clear()
        out = (xxhash.xxh3_64_intdigest(word) >> SUFFIX_BITS << SUFFIX_BITS) | xxhash.xxh3_64_intdigest(word[-SUFFIX_BYTES:], 7) % (SUFFIXES - 1)
        if len(word) < 64:
            self[word] = out
        return out

    def stream(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with its end, and where each text starts."""
        cut = [lower_ascii(t).split() for t in texts]
        sizes = np.fromiter((len(c) + 1 for c in cut), np.int64, len(cut))
        starts = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), U64)
        for words, a in zip(cut, starts.tolist(), strict=True):
            out[a : a + len(words)] = np.fromiter(map(self.__getitem__, words), U64, len(words))
            out[a + len(words)] = END_ID
        return out, starts


_ids = _Ids()


def _parts(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of the first text, ids and starts of some texts at a time."""
    k = 0
    while k < len(texts):
        end, held = k, 0
        while end < len(texts) and (held == 0 or held + len(texts[end]) <= PART_BYTES):
            held += len(texts[end]) + 1
            end += 1
        yield k, *_ids.stream(texts[k:end])
        k = end


@dataclass
class ClassModel:
    """suffixes: the class of unseen words by suffix. known[k], unseen[k]: log10 factors of a class's words; trans: log10 of class k after class j."""

    suffixes: np.ndarray
    known: np.ndarray
    unseen: np.ndarray
    trans: np.ndarray
    n: int
    v: int


@dataclass
class Core:
    """frequent: sorted ids; classes: by unit (frequent words, suffixes, end); table: the class bigrams."""

    frequent: np.ndarray
    classes: np.ndarray
    table: np.ndarray
    n: int
    v: int

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.classes[units(ids, self.frequent)]

    def fixed(self, ids: np.ndarray) -> np.ndarray:
        return (units(ids, self.frequent) < len(self.frequent)) | (ids == U64(END_ID))


def units(ids: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    out = (ids & _MASK).astype(np.int64) + len(frequent)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, ids), len(frequent) - 1)
        out = np.where(frequent[at] == ids, at, out)
    return out


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of the units by exchange over the bigram counts pairs[left, right]. The last unit (the end of a text) keeps a class of its own, the last one.

    Starts with the most frequent units in classes of their own and all others in one: classes that start as equal mixtures would give no unit a reason to move."""
    n = len(pairs)
    pairs = pairs.astype(np.float64)
    weight = pairs.sum(0) + pairs.sum(1)
    at = np.empty(n, np.int64)
    at[np.argsort(-weight[:-1], kind="stable")] = np.minimum(np.arange(n - 1), classes - 1)
    at[-1] = classes
    k = classes + 1
    one = np.eye(k)[at]
    right, left = pairs @ one, pairs.T @ one  # unit x class: what follows it, what comes before it
    table = one.T @ right
    order = np.flatnonzero(weight[:-1] > 0)
    order = order[np.argsort(-weight[order], kind="stable")]
    diag = np.arange(k)
    for _ in range(sweeps):
        moved = 0
        for u in order:
            a, own = at[u], pairs[u, u]
            table[a] -= right[u]
            table[:, a] -= left[u]
            table[a, a] += own
            r, c = right[u].copy(), left[u].copy()
            r[a] -= own
            c[a] -= own
            rows, cols = table.sum(1) + c, table.sum(0) + r  # tokens of the classes without the unit, wherever it goes
            new_r, new_c = table + r[None, :], table + c[:, None]
            gain = (_f(new_r) - _f(table)).sum(1) + (_f(new_c) - _f(table)).sum(0)
            d = table[diag, diag]
            gain += _f(d + r + c + own) - _f(d) - (_f(d + r) - _f(d)) - (_f(d + c) - _f(d))
            gain -= _f(rows + r.sum() + own) - _f(rows) + _f(cols + c.sum() + own) - _f(cols)
            gain[-1] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            if b != a:
                moved += 1
                at[u] = b
                right[:, a] -= pairs[:, u]
                right[:, b] += pairs[:, u]
                left[:, a] -= pairs[u]
                left[:, b] += pairs[u]
            r[b] += own
            c[b] += own
            table[b] += r
            table[:, b] += c
            table[b, b] -= own
        if not moved:
            break
    return at


ASKED = "part int, bucket int, ids binary, counts binary, docs array<bigint>, train array<boolean>, starts binary, stream binary"
COUNTS = "part int, bucket int, ids binary, counts binary, stat array<bigint>, top array<struct<id:bigint,n:bigint>>"
CONTEXTS = "part int, bucket int, ids binary, counts binary, classes binary, lens binary, codes binary, ns binary"
MOVED = "part int, bucket int, ids binary, counts binary, classes binary, stat array<bigint>, once array<struct<suffix:int,class:int,n:bigint>>"


def _requests(bucket_count: int) -> object:
    """Two kinds of rows: a bucket's words for each hash range, and (part null) texts as positions in the bucket's sorted words."""

    def run(key: tuple, docs: pa.Table) -> pa.Table:
        texts, train = texts_of(docs["text"].combine_chunks()), np.array(docs["train"].to_pylist(), bool)
        ids, counts, kept = [], [], []
        for k, stream, starts in _parts(texts):
            is_train = np.repeat(train[k : k + len(starts)], np.diff(np.append(starts, len(stream))))
            uniq, inverse = np.unique(stream, return_inverse=True)
            ids.append(uniq)
            counts.append(np.bincount(inverse[is_train], minlength=len(uniq)))
            kept.append((k, starts, inverse.astype(np.uint32)))
        uniq, inverse = np.unique(np.concatenate(ids), return_inverse=True)
        total = np.bincount(inverse, np.concatenate(counts), len(uniq)).astype(np.uint32)
        part = ((uniq >> U64(40)) % U64(bucket_count)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(bucket_count + 1))
        rows = [(h, order[a:b]) for h, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        me, no, docs_of, train_of = key[0].as_py(), [None] * len(rows), docs["doc_id"].to_pylist(), train.tolist()
        none = [None] * len(kept)
        streams = [np.searchsorted(uniq, own).astype(np.uint32)[local].tobytes() for own, (_, _, local) in zip(ids, kept, strict=True)]
        return pa.table({
            "part": pa.array([h for h, _ in rows] + none, pa.int32()), "bucket": pa.array([me] * (len(rows) + len(kept)), pa.int32()),
            "ids": pa.array([uniq[o].tobytes() for _, o in rows] + none, pa.binary()), "counts": pa.array([total[o].tobytes() for _, o in rows] + none, pa.binary()),
            "docs": pa.array(no + [docs_of[k : k + len(s)] for k, s, _ in kept], pa.list_(pa.int64())), "train": pa.array(no + [train_of[k : k + len(s)] for k, s, _ in kept], pa.list_(pa.bool_())),
            "starts": pa.array(no + [s.astype(np.int64).tobytes() for _, s, _ in kept], pa.binary()), "stream": pa.array(no + streams, pa.binary()),
        })

    return run


def _level(counts: np.ndarray) -> np.ndarray:
    """An eighth of an octave."""
    return (8 * np.log2(counts)).astype(np.int64)


def _sums(requests: pa.Table) -> pa.Table:
    """Answers for each bucket; in the first row also the sums of this hash range."""
    ids = [np.frombuffer(x, U64) for x in requests["ids"].to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in requests["counts"].to_pylist()])
    uniq, inverse = np.unique(np.concatenate(ids), return_inverse=True)
    total = np.bincount(inverse, counts, len(uniq)).astype(np.int64)
    answers, at = [], 0
    for x in ids:
        answers.append(total[inverse[at : at + len(x)]].tobytes())
        at += len(x)
    seen, suffix = total > 0, (uniq & _MASK).astype(np.int64)
    stat = np.stack([np.bincount(suffix, total, SUFFIXES), np.bincount(suffix, seen, SUFFIXES), np.bincount(suffix, total == 1, SUFFIXES), np.bincount(_level(total[seen]), minlength=SUFFIXES)]).astype(np.int64)
    top = np.flatnonzero(seen)
    top = top[np.lexsort((uniq[top], -total[top]))[: FREQUENT + 1]]  # all of the whole's that are here
    rest = len(ids) - 1
    return pa.table({
        "part": requests["part"], "bucket": requests["bucket"], "ids": requests["ids"], "counts": pa.array(answers, pa.binary()),
        "stat": pa.array([stat.ravel().tolist()] + [None] * rest, pa.list_(pa.int64())),
        "top": pa.array([[{"id": int(i), "n": int(t)} for i, t in zip(uniq[top].view(np.int64), total[top], strict=True)]] + [None] * rest, pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))),
    })


def _pack(table: np.ndarray) -> bytes:
    """The cells that are not 0, as gaps and counts, compressed; nothing if all are."""
    at = np.flatnonzero(table)
    return zlib.compress(np.diff(at, prepend=0).astype(np.uint32).tobytes() + table[at].tobytes(), 1) if len(at) else b""


def _unpack(cells: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(cells)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, np.uint32, n).astype(np.int64)), np.frombuffer(raw, np.int64, n, 4 * n)


def _pairs(frequent: np.ndarray, block: int = 64) -> object:
    size = len(frequent) + SUFFIXES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size * size, np.int64)
        for b in batches:
            for _, stream, _ in _parts(texts_of(b.column(0))):
                u = units(stream, frequent)
                u[stream == U64(END_ID)] = size - 1
                before = np.concatenate([[size - 1], u[:-1]])
                cells, n = np.unique(before * size + u, return_counts=True)
                table[cells] += n
        task = TaskContext.get().partitionId()
        for row in range(0, size, block):
            if cells := _pack(table[row * size : (row + block) * size]):
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([task], pa.int32()), pa.array([cells], pa.binary())], ["row", "task", "cells"])

    def add(rows: pa.Table) -> pa.Table:
        out = np.zeros(block * size, np.int64)
        for cells in rows["cells"].to_pylist():
            at, n = _unpack(cells)
            out[at] += n
        return pa.table({"row": pa.array([rows["row"][0].as_py()], pa.int32()), "task": pa.array([rows["task"][0].as_py() // TREE], pa.int32()), "cells": pa.array([_pack(out)], pa.binary())})

    return run, add, size


def fit_core(counts: DataFrame, docs: DataFrame, train: str) -> Core:
    """counts: what _sums gave; docs(text), of which `train` is a condition. Collects statistics of the core's units only: their number is bounded by FREQUENT and SUFFIXES."""
    stats = counts.where("stat is not null")
    sums = np.array([r[0] for r in stats.select(F.posexplode("stat").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").select("x").collect()] or [0] * 4 * SUFFIXES, np.int64).reshape(4, SUFFIXES)
    n, v = int(sums[0].sum()), int(sums[1].sum())
    enough = np.flatnonzero(np.cumsum(sums[3][::-1]) > FREQUENT)
    floor = 2 ** ((SUFFIXES - 1 - int(enough[0])) / 8) * 0.999 if len(enough) else 0.0  # so few come to the driver, however many hash ranges there are
    top = stats.select(F.inline("top")).where(F.col("n") >= floor).where(F.col("id") != int(np.uint64(END_ID).view(np.int64))).orderBy(F.desc("n"), "id").limit(FREQUENT).collect()
    frequent = np.sort(np.array([r["id"] for r in top], np.int64).view(U64))
    run, add, size = _pairs(frequent)
    schema, texts = "row int, task int, cells binary", docs.where(train).select("text")
    blocks, tasks = map_arrow(texts, run, schema), texts.rdd.getNumPartitions()
    while True:
        blocks, tasks = blocks.groupBy("row", F.floor(F.col("task") / TREE)).applyInArrow(add, schema), -(-tasks // TREE)
        if tasks <= 1:
            break
    pairs = np.zeros(size * size, np.int64)
    for row, cells in blocks.select("row", "cells").collect():  # the core's units only
        at, x = _unpack(cells)
        pairs[row * size + at] = x
    at = exchange(pairs.reshape(size, size))
    classes = at.copy()
    classes[len(frequent) + SUFFIXES - 1] = CLASSES  # by its id, the end is in the last suffix
    one = np.eye(KINDS)[at]
    return Core(frequent, classes, one.T @ pairs.reshape(size, size) @ one, n, v)


def _words(state: pa.Table, core: Core) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's sorted word ids with their training counts and classes."""
    ids = np.concatenate([np.frombuffer(x, U64) for x in state["ids"].to_pylist()] or [np.empty(0, U64)])
    counts = np.concatenate([np.frombuffer(x, np.int64) for x in state["counts"].to_pylist()] or [np.empty(0, np.int64)])
    order = np.argsort(ids)
    ids, counts = ids[order], counts[order]
    if "classes" not in state.column_names:
        return ids, counts, core.of(ids).astype(np.uint8)
    return ids, counts, np.concatenate([np.frombuffer(x, np.uint8) for x in state["classes"].to_pylist()] or [np.empty(0, np.uint8)])[order]


def _texts(streams: pa.Table) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    for docs, train, starts, stream in zip(*(streams[x].to_pylist() for x in ("docs", "train", "starts", "stream")), strict=True):
        if docs is not None:
            yield docs, np.array(train, bool), np.frombuffer(starts, np.int64), np.frombuffer(stream, np.uint32)


def _spans(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions of the runs of `lens` from `starts`."""
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))


def _transitions(core: object) -> object:
    """A bucket's class bigrams over training tokens."""

    def run(streams: pa.Table, state: pa.Table) -> pa.Table:
        _, _, classes = _words(state, core.value)
        table = np.zeros(KINDS * KINDS, np.int64)
        for _, train, starts, stream in _texts(streams):
            k = classes[stream].astype(np.int64)
            before = np.concatenate([[CLASSES], k[:-1]])
            table += np.bincount((before * KINDS + k)[np.repeat(train, np.diff(np.append(starts, len(stream))))], minlength=KINDS * KINDS)
        return pa.table({"table": pa.array([table.tolist()], pa.list_(pa.int64()))})

    return run


def _contexts(core: object) -> object:
    """For each word of a bucket outside the core, how often each class stands before it (code: the class) and after it (KINDS + the class) in training documents."""

    def run(streams: pa.Table, state: pa.Table) -> pa.Table:
        ids, _, classes = _words(state, core.value)
        kind = np.uint32 if len(ids) * 2 * KINDS < 1 << 32 else np.int64
        free, keys = ~core.value.fixed(ids), [np.empty(0, kind)]
        for _, train, starts, stream in _texts(streams):
            word, k = stream.astype(kind) * kind(2 * KINDS), classes[stream]
            is_train = np.repeat(train, np.diff(np.append(starts, len(stream)))) & free[stream]
            keys.append((word + np.concatenate([[CLASSES], k[:-1]]).astype(kind))[is_train])  # texts end in an end
            keys.append((word[:-1] + k[1:].astype(kind) + kind(KINDS))[is_train[:-1]])  # an end is not free
        keys = np.concatenate(keys)
        keys.sort()
        begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        n, keys = np.diff(np.append(begins, len(keys))), keys[begins]
        lens = np.bincount(keys // kind(2 * KINDS), minlength=len(ids))
        starts, codes, n = np.cumsum(lens) - lens, (keys % kind(2 * KINDS)).astype(np.uint8), n.astype(np.uint32)
        out = {x: [] for x in ("classes", "lens", "codes", "ns")}
        for x in state["ids"].to_pylist():
            at = np.searchsorted(ids, np.frombuffer(x, U64))
            take = _spans(starts[at], lens[at])
            for name, y in (("classes", classes[at]), ("lens", lens[at].astype(np.uint32)), ("codes", codes[take]), ("ns", n[take])):
                out[name].append(y.tobytes())
        return pa.table({x: state[x] for x in ("part", "bucket", "ids", "counts")} | {x: pa.array(y, pa.binary()) for x, y in out.items()})

    return run


def assign(classes: np.ndarray, word: np.ndarray, code: np.ndarray, n: np.ndarray, table: np.ndarray, at_once: int = 1 << 18) -> np.ndarray:
    """The class that makes a word's own neighbours likeliest, for each word with entries (word, code, n; sorted by word); the others keep theirs.

    The log-likelihood of class k is the sum of n log(P(k | class before) / P(k)) and n log P(class after | k), all from `table` with a half added to each cell, so a word's class depends on its own counts and the table alone: not on the other words of its hash range,
    nor on their order. The least of equal classes wins."""
    t = table[:, :CLASSES].astype(np.float64) + 0.5
    before = np.log(t / t.sum(1, keepdims=True)) - np.log(t.sum(0) / t.sum())
    t = table[:CLASSES].astype(np.float64) + 0.5
    weights = np.concatenate([before, np.log(t / t.sum(1, keepdims=True)).T])
    out = classes.copy()
    begins, ends = runs(word)
    k = 0
    while k < len(begins):
        stop = max(k + 1, int(np.searchsorted(begins, begins[k] + at_once)))
        a, b = begins[k], ends[stop - 1]
        score = np.add.reduceat(weights[code[a:b]] * n[a:b, None], begins[k:stop] - a)
        out[word[begins[k:stop]]] = np.argmax(score, axis=1)
        k = stop
    return out


def _moved(table: np.ndarray) -> object:
    """The rows of a hash range with the new classes; in the first row also tokens and words seen once by class, and words seen once by suffix and class."""

    def run(rows: pa.Table) -> pa.Table:
        ids = [np.frombuffer(x, U64) for x in rows["ids"].to_pylist()]
        get = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in rows[name].to_pylist()])
        uniq, first, inverse = np.unique(np.concatenate(ids), return_index=True, return_inverse=True)
        counts, classes = get("counts", np.int64)[first], get("classes", np.uint8)[first]
        packed = np.repeat(inverse.astype(U64) * U64(2 * KINDS) << _S, get("lens", np.uint32))
        packed += get("codes", np.uint8).astype(U64) << _S
        packed += get("ns", np.uint32)
        packed.sort()
        key = (packed >> _S).astype(np.uint32)
        packed &= _N
        begins = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        n, key = np.add.reduceat(packed, begins).astype(np.int64) if len(key) else np.empty(0, np.int64), key[begins]
        del packed
        classes = assign(classes, key // np.uint32(2 * KINDS), (key % np.uint32(2 * KINDS)).astype(np.uint8), n, table)
        stat = np.stack([np.bincount(classes, counts, KINDS), np.bincount(classes, counts == 1, KINDS)]).astype(np.int64)
        once, many = np.unique((uniq & _MASK).astype(np.int64)[counts == 1] * KINDS + classes[counts == 1], return_counts=True)
        cuts, rest = np.cumsum([0] + [len(x) for x in ids]), len(ids) - 1
        return pa.table({
            "part": rows["part"], "bucket": rows["bucket"], "ids": rows["ids"], "counts": rows["counts"],
            "classes": pa.array([classes[inverse[a:b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
            "stat": pa.array([stat.ravel().tolist()] + [None] * rest, pa.list_(pa.int64())),
            "once": pa.array([[{"suffix": k // KINDS, "class": k % KINDS, "n": x} for k, x in zip(once.tolist(), many.tolist(), strict=True)]] + [None] * rest, pa.list_(pa.struct([("suffix", pa.int32()), ("class", pa.int32()), ("n", pa.int64())]))),
        })

    return run


def _total(df: DataFrame, column: str, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for k, x in df.select(F.posexplode(column).alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect():
        out[k] = x
    return out


def _model(core: Core, state: DataFrame, table: np.ndarray) -> ClassModel:
    tokens, once = _total(state, "stat", 2 * KINDS).reshape(2, KINDS)
    unseen = (once + 0.5) / (tokens + 1)
    unseen[-1] = 0.5 / (tokens[-1] + 1)
    trans = np.log10((table + 0.5) / (table.sum(1, keepdims=True) + 0.5 * KINDS))
    suffixes, votes = core.classes[len(core.frequent) : -1].copy(), np.zeros((SUFFIXES, KINDS), np.int64)
    for s, k, x in state.select(F.inline("once")).groupBy("suffix", "class").agg(F.sum("n")).collect():
        votes[s, k] = x
    voted = votes.sum(1) > 0
    suffixes[voted] = votes[voted].argmax(1)
    suffixes[SUFFIXES - 1] = CLASSES
    return ClassModel(suffixes, np.log10((1 - unseen) / np.maximum(tokens, 1)), np.log10(unseen), trans, core.n, core.v)


def _scores(core: object, model: object) -> object:
    def run(streams: pa.Table, state: pa.Table) -> pa.Table:
        m: ClassModel = model.value
        ids, counts, classes = _words(state, core.value)
        classes = np.where(counts > 0, classes, m.suffixes[(ids & _MASK).astype(np.int64)]).astype(np.int64)
        word = np.where(counts > 0, np.log10(np.maximum(counts, 1)) + m.known[classes], m.unseen[classes])
        base = np.log10((counts + 0.5) / (m.n + 0.5 * (m.v + 1)))
        names, held = [], []
        out = {x: [] for x in ("n_tokens", "n_known", "base_score", "score")}
        for docs, train, starts, stream in _texts(streams):
            names += docs
            held += (~train).tolist()
            k = classes[stream]
            before = np.concatenate([[CLASSES], k[:-1]])
            for name, x in (("n_tokens", np.ones(len(k), np.int64)), ("n_known", (counts[stream] > 0).astype(np.int64)), ("base_score", base[stream]), ("score", m.trans[before, k] + word[stream])):
                out[name].append(np.add.reduceat(x, starts))
        got = {x: np.concatenate(y or [np.empty(0)]) for x, y in out.items()}
        return pa.table({
            "doc_id": pa.array(names, pa.int64()), "held_out": pa.array(held, pa.bool_()),
            "n_tokens": pa.array(got["n_tokens"].astype(np.int64)), "n_known": pa.array(got["n_known"].astype(np.int64)), "train_tokens": pa.array([m.n] * len(names), pa.int64()),
            "base_score": pa.array(got["base_score"].astype(np.float64)), "score": pa.array(got["score"].astype(np.float64)),
        })

    return run


def score_documents(docs: DataFrame, train: str, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs(doc_id, text).

    train: the SQL condition of rows that are learned from. Null and empty texts are one end token. Repeated rows count and are scored each. Other columns are ignored. Without training rows every count is 0 and scores are the smoothing's. No rows in, no rows out."""
    return fit(docs, train, rounds).scores()


@dataclass
class Fitted:
    """streams: the texts of each bucket as numbers of its words; state: the words' counts and classes, as each bucket has asked for them."""

    streams: DataFrame
    state: DataFrame
    core: object
    model: ClassModel

    def scores(self) -> DataFrame:
        model = self.state.sparkSession.sparkContext.broadcast(self.model)
        return _beside(self.streams, self.state, _scores(self.core, model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _beside(streams: DataFrame, state: DataFrame, f: object, schema: str) -> DataFrame:
    answers = state.select(*(x for x in ("part", "bucket", "ids", "counts", "classes") if x in state.columns))
    return streams.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(f, schema)


def fit(docs: DataFrame, train: str, rounds: int = ROUNDS) -> Fitted:
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "lm")
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(12, -(-size // BUCKET_BYTES))
    dealt = docs.select("doc_id", "text", F.coalesce(F.expr(train), F.lit(False)).alias("train"), F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(buckets)).cast("int").alias("bucket"))
    asked = scratch.cut(dealt.groupBy("bucket").applyInArrow(_requests(buckets), ASKED).withColumn("kind", F.col("part").isNull().cast("int")), "asked", "kind")
    state = scratch.cut(asked.where("kind = 0").select("part", "bucket", "ids", "counts").groupBy("part").applyInArrow(_sums, COUNTS), "counts")
    scratch.drop("asked/kind=0")
    streams = asked.where("kind = 1").select("bucket", "docs", "train", "starts", "stream")
    with shuffles_end_with_the_query(spark):
        fitted = fit_core(state, docs, train)
    core, table = spark.sparkContext.broadcast(fitted), fitted.table
    for k in range(rounds):
        state = scratch.cut(_beside(streams, state, _contexts(core), CONTEXTS).groupBy("part").applyInArrow(_moved(table), MOVED), f"state{k}")
        scratch.drop("counts" if not k else f"state{k - 1}")
        with shuffles_end_with_the_query(spark):
            table = _total(_beside(streams, state, _transitions(core), "table array<bigint>"), "table", KINDS * KINDS).reshape(KINDS, KINDS)
    return Fitted(streams, state, core, _model(fitted, state, table))
