"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Features are the words, word pairs, and runs of one to three word shapes (letters collapsed to case, digits to 0, other signs kept, a word equal to the one
before it marked), hashed to BITS bits. A document's vector holds relative frequencies, so a score is a sparse dot product. It is trained on at most
SAMPLE_ROWS labelled rows, those with the least hashes of their ids."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.base import map_arrow, texts_of
from attesta.llm.words import U64, mix

BITS, EPOCHS = 18, 4
#: What the model is fitted on at most: labelled rows, and bytes of their texts (rows are taken in the order of their ids' hashes until a text doesn't fit).
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 96 << 20
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-3
SCALE = 20.0
THRESHOLD = 0.7
_SHAPE = bytes(65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 97 if 97 <= b <= 122 or b >= 128 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)
_REPEAT = xxhash.xxh3_64_intdigest(b"\0again")


class _Words(dict):
    """Word -> number of its row in two arrays, of hashes and shape hashes; bounded: when full it starts anew."""

    def __init__(self, most: int = 600_000):
        self.most = most
        self.hashes, self.shapes = np.zeros(most, U64), np.zeros(most, U64)

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        short = _RUN.sub(rb"\1", word.translate(_SHAPE))
        self.hashes[k], self.shapes[k] = xxhash.xxh3_64_intdigest(word), xxhash.xxh3_64_intdigest(short, 3)
        return k

    def features(self, text: bytes) -> np.ndarray:
        """Hashed features in no order; repeats are counts."""
        words = text.split()
        if len(self) + len(words) >= self.most:
            self.clear()
            if len(words) >= self.most:
                return np.concatenate([self.features(b" ".join(words[k : k + self.most // 2])) for k in range(0, len(words), self.most // 2)])
        if not words:
            return np.empty(0, np.int64)
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        h, s = self.hashes[at], self.shapes[at]
        if len(at) > 1:
            s = np.concatenate([s[:1], np.where(at[1:] == at[:-1], U64(_REPEAT), s[1:])])
        pairs = mix(s[:-1] * U64(5) + s[1:])
        out = np.concatenate([mix(h), mix(h[:-1] * U64(3) + h[1:]), mix(s), pairs, mix(pairs[:-1] * U64(7) + s[2:])])
        return (out >> U64(64 - BITS)).astype(np.int64)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias from rows of (indices, values, label), by FTRL-proximal updates in the order given, again for each epoch."""
    size = 1 << BITS
    z, n, w = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for _ in range(epochs):
        for index, value, label in rows:
            i, x = np.append(index, size), np.append(value, 1.0)
            zi, ni = z[i], n[i]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(wi @ x, -30, 30)))
            g = (p - label) * x
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * wi
            n[i] = ni + g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w[:-1], float(w[-1])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for b in batches:
        rows = []
        for text in texts_of(b.column(1)):
            index, count = np.unique(words.features(text), return_counts=True)
            rows.append((index.astype(np.int32).tobytes(), (count * (SCALE / max(1, count.sum()))).astype(np.float32).tobytes()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), b.column(2)], ["doc_id", "index", "value", "label"])


def train(docs: DataFrame, labels: DataFrame, condition: str, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, float]:
    """Fits labels(doc_id, quality) of rows that meet `condition`. With none, all scores are 0.5. Of several labels of a document the greatest counts, of several texts the one with the least hash."""
    sample = labels.where(condition).where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    mark = F.xxhash64("text")
    sized = docs.select("doc_id", mark.alias("mark"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).join(F.broadcast(sample), "doc_id")  # at most sample_rows
    chosen, left = [], sample_bytes
    for r in sized.groupBy("doc_id", "label").agg(F.min(F.struct("mark", "size")).alias("m")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        left -= r["m"]["size"]
        if left < 0:
            break
        chosen.append((r["doc_id"], r["m"]["mark"], r["label"]))
    if not chosen:
        return ftrl([])
    picked = docs.select("doc_id", "text", mark.alias("mark")).join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long, mark long, label int")), ["doc_id", "mark"]).select("doc_id", "text", "label")
    got = {r["doc_id"]: r for r in map_arrow(picked, _sparse, "doc_id long, index binary, value binary, label int").dropDuplicates(["doc_id"]).collect()}
    order = sorted(got.values(), key=lambda r: xxhash.xxh3_64_intdigest(str(r["doc_id"])))
    return ftrl([(np.frombuffer(r["index"], np.int32), np.frombuffer(r["value"], np.float32).astype(float), r["label"]) for r in order])


def score_quality(docs: DataFrame, labels: DataFrame, condition: str, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id and score (0 to 1) for every row of docs(doc_id, text), learned from labels that meet `condition`.

    Null and empty texts have no features and get the bias's score. Repeated rows score alike. Other columns are ignored; no rows in, no rows out."""
    weights, bias = train(docs, labels, condition, sample_rows)
    model = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b0 = model.value
        words = _Words()
        for b in batches:
            dots = []
            for text in texts_of(b.column(1)):
                f = words.features(text)
                dots.append(b0 + (SCALE * float(w[f].sum(dtype=np.float64)) / len(f) if len(f) else 0.0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(np.array(dots), -30, 30))))], ["doc_id", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double")
