"""The pipeline's stages and the whole against brute force, on rows with nulls, repeats, ties and odd column names."""

import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("attesta.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, row string, id string, name string, size long"


def _rows():
    r = random.Random(12)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "klmnp"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, item = text(60), text(25)
    rows = [(k, text(r.randint(12, 90)), f"s{k % 4}") for k in range(60)]
    rows += [(k, f"{text(20)}\n{passage}\t{text(15)}", "s1") for k in range(60, 70)]
    for k in range(70, 80):  # near copies of one text
        w = rows[5][1].split()
        if k % 2:
            w[k % len(w)] = "edited"
        rows.append((k, " ".join(w), "s2"))
    rows += [(80 + k, f"{text(10)} {item} {text(5)}", "s3") for k in range(3)]
    rows += [(90, None, "s0"), (91, "", None), (92, "too short", "s0"), (93, "again and " * 40, "s0"), (None, text(30), "s1"), (3, rows[3][1], "s3"), (4, text(40), "s0")]
    rows += [(200 + k, "bad host" if k % 5 else text(30), "bad") for k in range(60)]
    return [(i, t, "en", s, len(t or ""), f"x{i}", "r", "i", "n", 7) for i, t, s in rows], item


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, item = _rows()
    where = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def _fails(text):
    w = (text or "").split()
    count = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    again = {k + j for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1 for j in range(5)}
    return len(w) < 10 or 100 * len(again) > 20 * len(w)


def _good(rows):
    return [r for r in rows if not _fails(r[1]) and r[3] != "bad"]


def _one_of_each(rows):
    docs = sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda d: (d[0], d[1] or ""))
    sets = []
    for _, t in docs:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for d, g in zip(docs, group, strict=True):
        least.setdefault(g, d)
    kept, out = set(least.values()), [r for r in rows if r[0] is None]
    for r in rows:
        if (r[0], r[1]) in kept and r[0] is not None:
            out.append(r)
            kept.discard((r[0], r[1]))
    return out


def _cut(rows):
    first = {}
    for r in rows:
        w = (r[1] or "").split()
        for k in range(len(w) - 12):
            if r[0] is not None:
                first[tuple(w[k : k + 13])] = min(first.get(tuple(w[k : k + 13]), r[0]), r[0])
    out = []
    for r in rows:
        w, gone = (r[1] or "").split(), set()
        for k in range(len(w) - 12):
            if r[0] is not None and first[tuple(w[k : k + 13])] < r[0]:
                gone |= set(range(k, k + 13))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        if left:
            out.append((r[0], left, *r[2:4], len(left), *r[5:]) if gone else r)
    return out


def _clean(rows, item):
    v = item.split()
    s = {tuple(v[k : k + 5]) for k in range(len(v) - 4)}
    out = []
    for r in rows:
        w = (r[1] or "").split()
        if 10 * len(s & {tuple(w[k : k + 5]) for k in range(len(w) - 4)}) < 8 * len(s):
            out.append(r)
    return out


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_stages(spark, folder):
    from tokenizers import Tokenizer

    rows, item = _rows()
    want = [_good(rows)]
    want.append(_one_of_each(want[0]))
    want.append(_cut(want[1]))
    want.append(_clean(want[2], item))
    lens = [len(rows), *map(len, want)]
    assert all(a >= b for a, b in zip(lens, lens[1:])) and lens[0] > lens[1] > lens[2] and lens[3] > lens[4]
    assert any(a[1] != b[1] for a, b in zip(_sorted(want[1]), _sorted(want[2]), strict=False))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        whole = stage(spark, docs, folder)
        assert whole.schema.names == docs.schema.names, name
        assert _sorted(whole.collect()) == _sorted(expected), name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        docs = spark.createDataFrame(expected, SCHEMA).repartition(2)
    from attesta.llm.queries import tokenizer_path

    encode = Tokenizer.from_file(tokenizer_path()).encode
    ends = Counter(len(encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in want[-1])
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert Counter({(p["doc_id"], p["doc_tokens"]): 0 for p in pieces}).keys() == {(r[0], len(encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in want[-1]}
    assert sum(p["length"] for p in pieces) == sum(n * c for n, c in ends.items())
    at = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == at.get(p["sequence_id"], 0)
        at[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(at.values()) <= 2048 and np.mean([n in (256, 512, 1024, 2048) or n & (n - 1) == 0 for n in at.values()]) == 1
