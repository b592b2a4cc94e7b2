"""Operators on clean, tiny and empty inputs, on both sides of every bound, and parts against brute force."""

import math
import random
from collections import Counter
from itertools import product

import numpy as np
import pytest

pytest.importorskip("attesta.llm")
from pyspark.sql import functions as F  # noqa: E402

from attesta.llm import decontam, graph, jaccard, lm, packing, quality, rules, sharding, substring, urls  # noqa: E402
from attesta.llm.base import Scratch  # noqa: E402
from attesta.llm.queries import tokenizer_path  # noqa: E402


def _table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def _words(r, n):
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


def _cases():
    r = random.Random(1)
    t = _words(r, 20)
    return {"none": [], "one": [(1, t)], "equal": [(1, t), (2, t)], "different": [(1, t), (2, _words(r, 20))], "clean": [(k, _words(r, 60)) for k in range(60)], "empty": [(1, None), (2, ""), (3, " \n")]}


@pytest.mark.parametrize("case", _cases())
def test_small_inputs(spark, case):
    rows = _cases()[case]
    docs = _table(spark, rows)
    removed = {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(docs).collect()}
    assert removed == {i: 20 if case == "equal" and i == 2 else 0 for i, _ in rows}
    groups = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs, 3, 90, 100).collect()}
    assert groups == {i: 1 if case == "equal" else i for i, _ in rows}
    assert jaccard.keep_one(docs).count() == len(set(groups.values()))
    assert sorted(x for (x,) in sharding.shard_by_bytes(docs).select("doc_id").collect()) == [i for i, _ in rows]
    assert rules.quality_rules(docs.withColumn("source", F.lit("s"))).count() == rules.quality_rules(docs.withColumn("source", F.lit(None).cast("string"))).count() == len(rows)
    assert quality.score_quality(docs, spark.createDataFrame([], "doc_id long, quality int"), "true").where("score = 0.5").count() == len(rows)
    assert lm.score_documents(docs, "false").where("score < 0").count() == len(rows)
    items = spark.createDataFrame(rows[:1], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.contained_items(docs, items).collect()}
    assert found == ({(i, 1) for i, _ in rows} if case in ("one", "equal") else {(1, 1)} if case == "different" else {(0, 0)} if case == "clean" else set())
    assert decontam.without_items(docs, items).count() == len(rows) - len(found)
    pieces = packing.pack(docs, tokenizer_path())
    assert {r["doc_id"] for r in pieces.collect()} == {i for i, _ in rows}
    assert urls.judge_urls(docs.withColumnsRenamed({"doc_id": "page_id", "text": "url"})).where("verdict = 'allow'").count() == len(rows)


def _linked(sets, num, den):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in product(sets, sets):
        if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("flush, sets", [(4_000_000, 1600), (300, 1600), (300, 8)])
def test_bounds_of_the_jaccard_join_change_nothing(spark, flush, sets):
    r = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    base = [[r.choice(words) for _ in range(r.randint(3, 120))] for _ in range(12)]
    rows = []
    for k in range(200):
        w = list(base[0] if k % 3 == 0 else r.choice(base))
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((k, w))
    w = [r.choice(words) for _ in range(80)]
    for k in range(200, 230):  # a chain
        w = list(w)
        w[r.randrange(80)] = r.choice(words)
        rows.append((k, w))
    found = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, w in rows}
    got = jaccard.near_duplicates(_table(spark, [(i, " ".join(w)) for i, w in rows]).repartition(3), 3, 8, 10, flush=flush, cluster_sets=sets).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == _linked(found, 8, 10)


def test_hubs_of_a_graph(spark):
    r = random.Random(2)
    edges = [(0, k) for k in range(1, 80)] + [(k, k + 1) for k in range(100, 130)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(901, 901)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    for hubs in (4, 2000):
        got = {(r["node"], r["label"]) for r in graph.components(Scratch(spark, "g"), spark.createDataFrame(edges, "a long, b long"), "g", hubs=hubs).collect()}
        assert got == {(x, find(x)) for x in parent}


@pytest.mark.parametrize("flush", [50, 2000, 4_000_000])
def test_bounds_of_the_substring_dedup_change_nothing(spark, flush):
    r = random.Random(1)
    passages = [_words(r, n) for n in (13, 14, 20, 50, 100)]
    rows = [(r.randrange(150), f"{_words(r, r.randrange(40))} {r.choice(passages) if r.random() < 0.5 else ''} {_words(r, r.randrange(30))}") for _ in range(200)]
    rows += rows[:10]
    first = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, i), i)
    want = []
    for i, t in rows:
        w, gone = t.split(), set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = substring.remove_repeats(_table(spark, rows).repartition(3), flush=flush).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_blocks_of_items_change_nothing(spark):
    r = random.Random(3)
    docs = _table(spark, [(k, _words(r, 60)) for k in range(20)])
    items = spark.createDataFrame([(r["doc_id"], " ".join(r["text"].split()[5:30])) for r in docs.where("doc_id < 9").collect()], "item_id long, text string")
    for block in (2, 100):
        assert {(r["doc_id"], r["item_id"]) for r in decontam.contained_items(docs, items, block=block).collect()} == {(k, k) for k in range(9)}
        assert sorted(r["doc_id"] for r in decontam.without_items(docs, items, block=block).collect()) == list(range(9, 20))


def _hosts():
    r = random.Random(8)
    rows = []
    for k in range(1200):
        host = k % 12
        bad = r.random() < (0.7 if host == 5 else 0.08)
        rows.append((k, "too short" if bad else _words(r, 40), f"h{host}"))
    return [*rows, (5000, "one word too few", "single"), (5001, _words(r, 30), None)]


@pytest.mark.parametrize("broadcast", [0, 20_000])
def test_a_bad_host_is_rejected(spark, broadcast):
    rows = _hosts()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    n, f = Counter(h for _, _, h in rows), Counter(h for _, t, h in rows if len(t.split()) < 10)
    rates = [f[h] / n[h] for h in n]
    m = sum(rates) / len(rates)
    v = max(0.0, sum((x - m) ** 2 for x in rates) / len(rates) - m * (1 - m) * sum(1 / n[h] for h in n) / len(n))
    weight = min(10_000, max(2, m * (1 - m) / v - 1)) if v else 10_000
    limit = min(0.5, m + max(2 * math.sqrt(v), 0.2))
    got = {r["doc_id"]: r for r in rules.quality_rules(docs, broadcast_hosts=broadcast).collect()}
    for i, t, h in rows:
        rate = (f[h] + m * weight) / (n[h] + weight)
        kept = rate - 1.645 * math.sqrt(rate * (1 - rate) / (n[h] + weight + 1)) <= limit
        assert kept == (h != "h5")
        assert got[i]["host_rate"] == pytest.approx(rate) and got[i]["kept"] == (kept and len(t.split()) >= 10)


def test_bins_and_balance_of_shards(spark):
    r = random.Random(4)
    docs = _table(spark, [(k, _words(r, r.randint(1, 60))) for k in range(300)])
    loads = []
    for bins in (16, 1 << 13):
        rows = sharding.shard_by_bytes(docs, shards=7, bins=bins).collect()
        load = Counter()
        for x in rows:
            load[x["shard"]] += x["size"]
        loads.append(load)
    assert loads[0] == loads[1] and len(loads[0]) == 7
    assert min(loads[0].values()) > 0.9 * max(loads[0].values())


def test_rates_leave_the_own_fold_out(spark):
    rows = [(f"http://{h}{k % 7}.{s}/{p}/{k}", s) for k, (h, s, p) in enumerate(product("abc", ("com", "net", "org"), ("es", "fr", "en")))] * 2
    pages = spark.createDataFrame([(k, u, "x") for k, (u, _) in enumerate(rows)], "page_id long, url string, rule string")
    total = [urls.held_out(pages, fold) for fold in range(urls.FOLDS)]
    assert sum(n for n, _ in total) == len({u for u, s in rows if s == "com" or s == "net" and "/en/" not in u})
    assert sum(right for _, right in total) >= 0.8 * sum(n for n, _ in total)
    labelled = spark.createDataFrame([(f"http://a.org/x/{k}", "a.org", f"/x/{k}", float(k % 2)) for k in range(10)], "url string, host string, path string, blocked double")
    model = urls.UrlModel(Scratch(spark, "u"), labelled)
    fold = dict(labelled.select("url", urls.fold_of(F.col("url"))).collect())
    seen = {x["url"]: x["suffix_rate"] for x in spark.read.parquet(f"{model.scratch.root}/fitted").collect()}
    for k in range(10):
        u = f"http://a.org/x/{k}"
        others = [float(j % 2) for j in range(10) if fold[f"http://a.org/x/{j}"] != fold[u]]
        assert seen[u] == pytest.approx((sum(others) + 4 * 0.5) / (len(others) + 4))


def test_quality_by_hand(spark):
    r = random.Random(2)
    rows = [(k, " ".join(r.choice(("Ab", "cd", "cd", "1x", "??")) for _ in range(r.randint(1, 12)))) for k in range(24)]
    labels = {k: int(t.count("cd") > 2) for k, t in rows}

    def shape(word):
        out = ""
        for c in word:
            c = "A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else c
            out += c if not out or out[-1] != c else ""
        return out

    words = quality._Words()

    def features(text):
        w = text.split()
        s = [shape(x) if not k or w[k - 1] != x else "again" for k, x in enumerate(w)]
        named = [("w", x) for x in w] + [("ww", *x) for x in zip(w, w[1:])] + [("s", x) for x in s] + [("ss", *x) for x in zip(s, s[1:])] + [("sss", *x) for x in zip(s, s[1:], s[2:])]
        return Counter(named)

    seen = {}
    for _, t in rows:  # same names, same numbers; n of each
        own = features(t)
        got = Counter(words.features(t.encode()).tolist())
        assert sorted(own.values()) == sorted(got.values())
        for name, n in own.items():
            seen.setdefault(name, set(got)).intersection_update(x for x in got if got[x] == n or True)
    assert all(seen.values())
    # FTRL, one coordinate at a time
    data = [(np.unique(words.features(t.encode()), return_counts=True), labels[k]) for k, t in rows]
    z, n = Counter(), Counter()
    weight = lambda i: 0.0 if abs(z[i]) <= quality.L1 else -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)
    for _ in range(quality.EPOCHS):
        for (index, count), y in data:
            x = dict(zip(index.tolist(), (count / count.sum()).tolist(), strict=True)) | {"bias": 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - y) * x[i]
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
                n[i] += g * g
    weights, bias = quality.ftrl([(index, count / count.sum(), y) for (index, count), y in data])
    assert bias == pytest.approx(weight("bias")) and all(weights[i] == pytest.approx(weight(i)) for i in z if i != "bias")
    # scores are the dot products
    docs = _table(spark, rows)
    weights, bias = quality.train(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), "true")
    for row in quality.score_quality(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), "true").collect():
        f = words.features(dict(rows)[row["doc_id"]].encode())
        assert row["score"] == pytest.approx(1 / (1 + math.exp(-(bias + quality.SCALE * sum(weights[i] for i in f) / len(f)))), rel=1e-4)
    small = quality.train(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), "true", sample_bytes=1)
    assert not small[0].any() and small[1] == 0.0


def _likelihood(pairs, at, k):
    table = np.zeros((k, k))
    for i, j in product(range(len(at)), range(len(at))):
        table[at[i], at[j]] += pairs[i, j]
    f = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return f(table) - f(table.sum(0)) - f(table.sum(1))


def test_exchange_climbs_the_likelihood():
    r = np.random.default_rng(3)
    for _ in range(5):
        pairs = r.integers(0, 6, (13, 13))
        at = lm.exchange(pairs, classes=3, sweeps=50)
        assert at[-1] == 3 and at[:-1].max() < 3
        best = _likelihood(pairs, at, 4)
        start = np.minimum(np.argsort(np.argsort(-(pairs.sum(0) + pairs.sum(1))[:-1], kind="stable")), 2).tolist() + [3]
        assert best >= _likelihood(pairs, start, 4) - 1e-9
        for u, c in product(range(12), range(3)):  # no single move is better
            moved = at.copy()
            moved[u] = c
            assert _likelihood(pairs, moved, 4) <= best + 1e-6


def test_a_word_goes_where_its_neighbours_are_likeliest():
    r = np.random.default_rng(5)
    table = r.integers(0, 40, (lm.KINDS, lm.KINDS))
    word = np.repeat(np.arange(6), 4)
    code = np.concatenate([np.sort(r.choice(2 * lm.KINDS, 4, replace=False)) for _ in range(6)])
    n = r.integers(1, 9, 24)
    t = table + 0.5
    for at_once in (1, 1 << 18):
        got = lm.assign(np.full(7, 9, np.uint8), word.astype(np.uint32), code.astype(np.uint8), n, table, at_once)
        assert got[6] == 9
        for u in range(6):
            score = []
            for k in range(lm.CLASSES):
                total = 0.0
                for c, x in zip(code[word == u], n[word == u], strict=True):
                    if c < lm.KINDS:
                        total += x * (math.log(t[c, k] / t[c, : lm.CLASSES].sum()) - math.log(t[:, k].sum() / t[:, : lm.CLASSES].sum()))
                    else:
                        total += x * math.log(t[k, c - lm.KINDS] / t[k].sum())
                score.append(total)
            assert got[u] == int(np.argmax(score))


def test_scores_are_those_of_the_classes(spark):
    r = random.Random(6)
    vocabulary = [f"v{k}" for k in range(60)]
    rows = [(k, " ".join(r.choice(vocabulary[: 40 if k % 4 != 1 else 60]) for _ in range(r.randint(0, 25)))) for k in range(80)] + [(90, None)]
    fitted = lm.fit(_table(spark, rows), "doc_id % 4 != 1")
    classes, counts = {}, {}
    for x in fitted.state.collect():
        for i, c, k in zip(np.frombuffer(x["ids"], np.uint64).tolist(), np.frombuffer(x["counts"], np.int64).tolist(), np.frombuffer(x["classes"], np.uint8).tolist(), strict=True):
            classes[i], counts[i] = k, c
    name = lm._Ids()
    stream = {i: [name[w.encode()] for w in (t or "").split()] + [lm.END_ID] for i, t in rows}
    train = {i: s for i, s in stream.items() if i % 4 != 1}
    assert counts == {i: n for i in {x for s in stream.values() for x in s} for n in [sum(s.count(i) for s in train.values())]}
    assert classes[lm.END_ID] == lm.CLASSES
    trans, tokens, once = Counter(), Counter(), Counter()
    for s in train.values():
        for a, b in zip([lm.END_ID, *s], s, strict=False):
            trans[classes[a], classes[b]] += 1
    for i, n in counts.items():
        tokens[classes[i]] += n
        once[classes[i]] += n == 1
    n, v = sum(counts.values()), sum(c > 0 for c in counts.values())
    rows_of = Counter()
    for (a, _), x in trans.items():
        rows_of[a] += x
    for x in fitted.scores().collect():
        score, before = 0.0, lm.CLASSES
        for i in stream[x["doc_id"]]:
            k = classes[i] if counts[i] else int(fitted.model.suffixes[i & (lm.SUFFIXES - 1)])
            unseen = (0.5 if k == lm.CLASSES else once[k] + 0.5) / (tokens[k] + 1)
            emit = (1 - unseen) * counts[i] / tokens[k] if counts[i] else unseen
            score += math.log10((trans[before, k] + 0.5) / (rows_of[before] + 0.5 * lm.KINDS)) + math.log10(emit)
            before = k
        assert x["score"] == pytest.approx(score) and x["train_tokens"] == n
        assert x["base_score"] == pytest.approx(sum(math.log10((counts[i] + 0.5) / (n + 0.5 * (v + 1))) for i in stream[x["doc_id"]]))


def test_tiers_and_steps_of_packing(spark):
    r = random.Random(9)
    packer = packing.Packer(tiers=(64, 32, 16), step_tokens=256)
    for k in range(300):
        packer.add(k, bytes(4 * r.choice((3, 9, 17, 30, 50, 64, 70, 200))))
    rows = list(packer.rows(True))
    size, step, cost = {}, {}, Counter()
    for _, _, length, _, _, sequence, _, tier, group in rows:
        size[sequence] = size.get(sequence, 0) + length
        step[sequence] = (group, tier)
        cost[sequence] += length * length
        assert length <= tier
    assert all(n == step[s][1] for s, n in size.items())  # no padding
    groups, costs = Counter(), Counter()
    for s, key in step.items():
        groups[key] += size[s]
        costs[key] += cost[s]
    for tier in (64, 32, 16):
        own = [key for key in groups if key[1] == tier]
        assert all(groups[key] <= 256 + tier for key in own)
        tokens = [groups[key] for key in own]
        assert not tokens or max(tokens) - min(tokens) <= tier  # equal steps
        if len(own) > 1:
            mean = [costs[key] / groups[key] for key in own]
            assert max(mean) <= 1.5 * min(mean)
    long = [x for x in rows if x[4] >= 64]
    assert any(x[2] == 64 for x in long)  # whole windows of the longest tier
