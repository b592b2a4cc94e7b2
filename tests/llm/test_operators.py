"""Operators against brute force on rows with nulls, empty and long texts, ties, repeats and clashing extra columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("attesta.llm")
from attesta.llm import decontam, jaccard, lm, packing, quality, rules, sharding, substring, urls  # noqa: E402
from attesta.llm.queries import tokenizer_path  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start long, keys string, label string"


def _rows():
    r = random.Random(3)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    rows = []
    for k in range(60):
        rows.append([k, " ".join(r.choice(words) for _ in range(r.randint(1, 90))) + "."])
    passage = " ".join(r.choice(words) for _ in range(40))
    for k in range(60, 80):
        rows.append([k, f"{' '.join(r.choice(words) for _ in range(20))}\n{passage}\t{' '.join(r.choice(words) for _ in range(r.randint(0, 9)))}"])
    for k in range(80, 100):
        w = rows[k % 7 + 20][1].split()
        w[len(w) // 2] = "edit" + str(k % 3)
        rows.append([k, " ".join(w)])
    rows += [[100, rows[5][1]], [101, rows[5][1]], [102, None], [103, ""], [104, " \n\t "], [105, "one"], [106, "ab " * 3000], [107, "Ünïcode <|endoftext|> İ ﬁ é"], [108, rows[70][1]]]
    rows.append(list(rows[3]))  # a repeated row
    return [(*x, None if x[0] % 9 == 0 else "en", None if x[0] % 11 == 0 else f"s{x[0] % 3}", None, 1, "x", "y") for x in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r[1] or "" for r in _rows()}


def test_jaccard(spark, docs, texts):
    for width, num, den in ((3, 90, 100), (5, 8, 10)):
        sets = {}
        for i, t in texts.items():
            w = t.encode().lower().split()
            sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
        parent = {i: i for i in sets}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
        got = jaccard.near_duplicates(docs, width, num, den).collect()
        assert len(got) == len(_rows())
        assert all((r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), find(r["doc_id"])) for r in got)


def test_substring(docs, texts):
    first = {}
    cut = {i: t.encode().split() for i, t in texts.items()}
    for i in sorted(cut):
        for k in range(len(cut[i]) - 12):
            first.setdefault(tuple(cut[i][k : k + 13]), i)
    for r in substring.remove_repeats(docs).collect():
        w, gone = cut[r["doc_id"]], set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < r["doc_id"]:
                gone |= set(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        assert (r["n_words"], r["n_removed"], r["kept"]) == (len(w), len(gone), kept)
    assert substring.with_repeats_removed(docs).schema.names == docs.schema.names


def test_decontamination(spark, docs, texts):
    items = [(0, " ".join(texts[70].split()[20:45])), (1, "Ab ak"), (2, None), (3, ""), (4, " ".join(texts[10].split()[:12])), (5, "no such words here at all")]
    found = {(r["doc_id"], r["item_id"], r["item_shingles"], r["shared_shingles"]) for r in decontam.contained_items(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for i, t in texts.items():
        w = t.encode().lower().split()
        for j, x in items:
            v = (x or "").encode().lower().split()
            n = min(5, len(v))
            if n:
                s, d = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
                if 10 * len(s & d) >= 8 * len(s):
                    want.add((i, j, len(s), len(s & d)))
    assert found == want and want


def test_short_and_repetitive_items_are_found():
    r = random.Random(6)
    texts = [[f"w{r.randrange(10**9)}" for _ in range(400)] for _ in range(400)]
    for w in texts[:100]:
        w[200:300] = (w[200:209] * 12)[:100]  # nine different shingles
    rows = [(k, " ".join(w[200:300] if k < 100 else w[150 : 155 + k % 4]).encode()) for k, w in enumerate(texts)]
    found = list(decontam.Items(rows, 5).matches([" ".join(w).encode() for w in texts], decontam.WordHash()))
    assert [[i for i, _, _ in x] for x in found] == [[k] for k in range(len(texts))]
    less = b" ".join(x.encode() for x in [*texts[200][150:158], "other"])  # four of five shingles
    assert [m for x in decontam.Items([(7, less)], 5).matches([" ".join(texts[200]).encode()], decontam.WordHash()) for m in x] == [(7, 5, 4)]


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(docs, tokenizer_path()).collect()
    ids, at, room = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
        room[r["sequence_id"]] = r["tier"]
        ids.setdefault(r["doc_id"], {})[r["start"]] = np.frombuffer(r["ids"], np.uint32).tolist()
    assert at == room and max(at.values()) <= 2048  # every sequence is full
    for i, text in texts.items():
        want = t.encode(text, add_special_tokens=False).ids + [1]
        if i != 3:  # the repeated row overwrites nothing but its own pieces
            assert sum((x for _, x in sorted(ids[i].items())), []) == want


def test_sharding(docs, texts):
    rows = sharding.shard_by_bytes(docs, shards=5).collect()
    assert len(rows) == len(_rows())
    size = {i: len(t.encode()) + 8 for i, t in texts.items()}
    groups, slots, load = {}, {}, Counter()
    for r in rows:
        assert (r["size"], r["text_crc32"]) == (size[r["doc_id"]], zlib.crc32(texts[r["doc_id"]].encode()))
        groups.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(len(x) == 1 for x in groups.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    order = Counter()
    for r in _rows():
        order[r[1] or ""] += len((r[1] or "").encode()) + 8
    sizes = [n for _, n in sorted(order.items(), key=lambda x: hashlib.sha256(x[0].encode()).digest())]

    def parts(capacity):
        n, left = 1, capacity
        for s in sizes:
            if s > capacity:
                return 99
            n, left = (n, left - s) if s <= left else (n + 1, capacity - s)
        return n

    assert max(load.values()) <= next(c for c in range(max(sizes), sum(sizes) + 1) if parts(c) <= 5)


def test_rules(docs, texts):
    rows = {r["doc_id"]: r for r in rules.quality_rules(docs).collect()}
    for i, t in texts.items():
        w = t.encode().split()
        assert rows[i]["n_words"] == len(w)
        count = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {k + j for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1 for j in range(5)}
        assert rows[i]["n_repeat_words"] == len(again)
        assert rows[i]["base_failed"] == (len(w) < 10 or 100 * len(again) > 20 * len(w))
    assert rules.keep_good(docs).schema.names == docs.schema.names


def test_model_scores(spark, docs, texts):
    rows = lm.score_documents(docs, "doc_id % 4 != 1").collect()
    c = Counter(x for r in _rows() if r[0] % 4 != 1 for x in [*(r[1] or "").encode().lower().split(), b"\n"])
    n, v = sum(c.values()), len(c)
    for r in rows:
        w = [*texts[r["doc_id"]].encode().lower().split(), b"\n"]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in c for x in w), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert r["score"] < 0
    empty = lm.score_documents(docs.limit(0), "doc_id % 4 != 1")
    assert empty.count() == 0


def test_rare_words_are_clustered_by_themselves(spark):
    r = random.Random(4)
    pairs = {"p": "red {} blue", "r": "cold {} warm"}
    rows = [f.format(f"{x}{k}qzz") for x, f in pairs.items() for k in range(1500) for _ in range(2)]  # more words than the core has, and all end alike
    r.shuffle(rows)
    docs = [(8 * k, t) for k, t in enumerate(rows)] + [(8 * k + x, f.format(f"{w}{k}qzz")) for k in range(50) for x, (f, w) in enumerate(((pairs["p"], "p"), (pairs["p"], "r"), (pairs["r"], "r"), (pairs["r"], "p")), 1)]
    score = {r["doc_id"]: r["score"] for r in lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id % 8 = 0").collect()}
    assert all(score[8 * k + 1] > score[8 * k + 2] + 0.5 and score[8 * k + 3] > score[8 * k + 4] + 0.5 for k in range(50))


def test_quality_learns(spark):
    r = random.Random(1)
    good = [" ".join(r.choice(("the", "cat", "sat", "on", "mat")) + r.choice(("", ",")) for _ in range(40)) for _ in range(80)]
    rows = [(k, t if k % 4 else t.upper().replace(" ", "!! ")) for k, t in enumerate(good)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(60)], "doc_id long, quality int")
    score = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, labels, "true").collect()}
    assert len(score) == len(rows) and score[500] == score[501]
    assert min(score[k] for k in range(60, 80) if k % 4) > max(score[k] for k in range(60, 80) if k % 4 == 0)


def test_urls(spark):
    rows = [(1, "http://A.example.com/en/1"), (2, "https://www.example.com/en/2"), (3, "http://x.net/es/"), (4, None), (5, "nothing"), (6, "http://b.com"), (7, "http://b.com/?q"), (8, "http://c.org/p/1?x=1#f")]
    got = {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [got[k]["rule"] for k in range(1, 9)] == ["example.com/en/", "www.example.com/en/", "net/es/", None, None, None, "com/", None]
    assert (got[8]["host"], got[8]["path"], got[4]["host"], got[6]["path"]) == ("c.org", "/p/1", "", "")
    assert all(r["verdict"] in ("allow", "block") for r in got.values())


def test_url_rates_are_of_all_rows(spark):
    from attesta.llm.base import Scratch

    rows = [("http://a.org/x/0", "a.org", "/x/0", 1.0)] * 60 + [(f"http://{h}.org/{h}/{k}", f"{h}.org", f"/{h}/{k}", float(h in "bd")) for h in "bcde" for k in range(10)]
    labelled = spark.createDataFrame(rows, "url string, host string, path string, blocked double")
    model = urls.UrlModel(Scratch(spark, "t"), labelled, sample_rows=20)
    assert model.trees is not None
    rate = {r["_domain"]: r["domain_rate"] for r in model.rates["domain"].collect()}
    assert model.mean == 0.8 and rate == {"a.org": pytest.approx(63.2 / 64), **{f"{h}.org": pytest.approx((10 * (h in "bd") + 3.2) / 14) for h in "bcde"}}


def test_texts_of_one_id_are_kept_apart(spark):
    one, two, three = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(3, one), (7, one), (7, two), (7, two), (8, two), (9, three), (None, one)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(3, one), (7, two), (9, three), (0, one)])
