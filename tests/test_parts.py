"""File sources and sinks, requests, training, the store's later changes and search, the command line and the request folder."""

import json

import pytest
from pyspark.sql import functions as F

from attesta.__main__ import main
from attesta.operators import report, requests, retrieval, training
from attesta.plans import claim_queries, engine_queries  # noqa: F401
from attesta.sources import feeds, files, pages
from attesta.sources.evidence import SCHEMAS, EvidenceStore
from attesta.streaming import bridge

SCHEMA = "ord long, url string, reference string, domain string, title string, origin_type string, published string, text string"


def models():
    """Closures, so that they reach workers by value."""

    def embed(texts):
        return [[1.0, 0.0] if "mar" in t else [0.6, 0.8] for t in texts]

    def nli(pairs):
        return [(0.9, 0.05, 0.05) if "mar" in p else (0.1, 0.1, 0.8) for p, _ in pairs]

    return embed, nli


def test_text_files_and_lists(spark, tmp_path):
    (tmp_path / "a b.txt").write_text("  um texto \n", encoding="utf-8")
    (tmp_path / "c.txt").write_text(" \n", encoding="utf-8")
    good, errors = files.text_files(spark, str(tmp_path), "2024-05-06")
    row = good.first()
    assert (row["title"], row["text"], row["domain"], row["published"]) == ("a b", "um texto", f"documento:{tmp_path}/a b.txt", "2024-05-06")
    assert [r["error"] for r in errors.collect()] == ["arquivo vazio"] and good.count() == 1
    with pytest.raises(ValueError):
        files.text_files(spark, str(tmp_path), "06/05/2024")
    urls = tmp_path / "urls"
    urls.write_text("http://b\n# no\n\n http://a \r\nhttp://b\n", encoding="utf-8")
    assert [r["url"] for r in files.url_list(spark, str(urls)).collect()] == ["http://b", "http://a"]
    with pytest.raises(ValueError, match="2 URLs"):
        files.url_list(spark, str(urls), most=1)


def test_tables_of_labels(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes('﻿id,classe\nx,SUPPORTED\n"y, z",\nw,NADA\n'.encode())
    assert [tuple(r) for r in files.class_csv(spark, str(tmp_path / "c.csv"), "classe").collect()] == [(2, "x", "SUPPORTED"), (3, "y, z", None), (4, "w", "NADA")]
    (tmp_path / "p.csv").write_text('post,normalized claim\n"um texto que se repete um texto que se repete e acaba None",ref\n', encoding="utf-8")
    assert [tuple(r) for r in files.posts_csv(spark, str(tmp_path / "p.csv")).collect()] == [("um texto que se repete e acaba", "ref")]
    item = {"id": "1", "pair": "p", "claim": "c", "evidence": [{"text": "t", "source": "S", "date": None, "url": "http://H.com/x"}, {"text": "u", "source": "S", "date": None, "url": ""}], "label": "REFUTED", "event": "e", "date": "d", "source": "s", "rationale": "r"}
    (tmp_path / "l.jsonl").write_text("\n".join(json.dumps(x) for x in (item, item | {"label": "?"}, item | {"claim": None})), encoding="utf-8")
    good, bad = files.labelled_jsonl(spark, str(tmp_path / "l.jsonl"))
    assert (good.count(), bad.count()) == (1, 2)
    assert [(r["source_ord"], r["domain"], r["text"]) for r in files.evidence_sources(good).orderBy("source_ord").collect()] == [(0, "h.com", "t"), (1, "s", "u")]
    spark.createDataFrame([(f"p{k}", f"c{k}", k % 3 == 0) for k in range(90)], "premise string, hypothesis string, entailment_judgment boolean").write.parquet(str(tmp_path / "pairs"))
    pairs = files.labelled_pairs(spark, str(tmp_path / "pairs"))
    some = files.stratified(pairs, "label", 20, ["passage", "claim"])
    assert {r["label"]: r["count"] for r in some.groupBy("label").count().collect()} == {0: 10, 1: 10}
    assert sorted(some.collect()) == sorted(files.stratified(pairs.repartition(5), "label", 20, ["passage", "claim"]).collect())


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.12345678, [{"v": [1.00000049]}], None)], "id long, x double, a array<struct<v:array<double>>>, n string")
    assert json.loads(files.rounded_json(rows).first()["json"]) == {"id": 1, "x": 0.123457, "a": [{"v": [1.0]}]}
    files.write_predictions(rows.select("id", "n"), str(tmp_path / "k8"))
    assert spark.read.text(str(tmp_path / "k8")).first()[0] == '{"id":1,"n":null}'
    points = spark.createDataFrame([(2, "b\t c", [1.0, 2.0]), (1, "a", [0.5, 0.25])], "id long, title string, vec array<float>")
    files.write_projection(points, str(tmp_path / "k10"))
    import numpy as np

    got = spark.read.parquet(str(tmp_path / "k10/vectors")).orderBy("id").collect()
    assert [np.frombuffer(r["f32"], "<f4").tolist() for r in got] == [[0.5, 0.25], [1.0, 2.0]]
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "k10/metadata")).collect()) == sorted(["id\ttitle", "1\ta", "2\tb c"]) or spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "k10/metadata")).count() == 2


def test_urls_and_requests(spark):
    urls = {"": True, "http://a.com": True, "HTTPS://a.com:80/x?y": True, "http://são.com.br/x": True, "http://[::1]/": True, "http://1.2.3.4": True, "http://a.com.": True, "ftp://a.com": False, "http://": False, "http://a b.com": False, "http://-a.com": False, "http://a..com": False, "http://" + "a" * 64 + ".com": False, "http://" + "é" * 64 + ".com": False, "nothing": False, "http://a_b.com": False}
    got = {r["url"]: r["valid_url"] for r in requests.with_url_validity(spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    assert got == urls
    e = {"title": "t", "text": "x", "url": "", "origin": "anexo", "published": None}
    rows = [(1, "t", None, None, [" dez letras aqui "], [e], 0), (2, "t", "x" * 30001, None, ["curta"], [e | {"url": "ftp://x", "origin": "?"}], 21), (3, None, None, None, None, None, None), (4, "t", None, None, ["dez letras aqui"] * 11, [e | {"text": ""}] * 21, 0)]
    good, bad = requests.checked(spark.createDataFrame(rows, bridge.REQUEST.replace("request_id string", "request_id long")))
    assert [(r["request_id"], r["claims"]) for r in good.collect()] == [(1, ["dez letras aqui"])]
    assert {r["request_id"]: r["errors"] for r in bad.collect()} == {2: ["article", "claim", "attachments", "evidence_origin", "evidence_url"], 3: ["title", "claims"], 4: ["claims", "evidences", "evidence_text"]}
    articles = spark.createDataFrame([(1, "O preço subiu 5% em Recife em maio de 2024.", "", "ontem"), (2, "", None, "2024-05-06")], "article_id long, title string, text string, date string")
    got = {r["article_id"]: r for r in requests.proposals(articles, "c1").collect()}
    assert got[1]["notes"] == [requests.UNCHECKED, requests.NO_DATE, requests.NO_TEXT] and got[2]["claims"] == [] and got[2]["notes"] == [requests.UNCHECKED, requests.NO_TEXT]
    assert got[1]["versions"]["config"] == "c1"
    with pytest.raises(ValueError):
        requests.proposals(articles, "c1", 11)


def test_training(spark):
    rows = [(k, f"g{k // 2}", f"o mar {k}" if k % 3 else f"a serra {k}", "c", int(k % 3 > 0)) for k in range(60)]
    pairs = spark.createDataFrame(rows, "id long, grp string, passage string, claim string, label int")
    wide = training.model_features(pairs, {"a": models()}, {"a": ("query: ", "passage: ")})
    names = ["a_similarity", "a_support", "a_neutral", "a_against"]
    model, grid = training.fit_logistic(wide, names, "grp", grid=(0.1, 1.0), folds=3)
    assert {r["macro_f1"] for r in grid.collect()} == {1.0}
    p = {r["id"]: r["p"] for r in training.probabilities(model, wide).collect()}
    assert all((p[k] > 0.5) == (k % 3 > 0) for k in p)
    items = spark.createDataFrame([(1, "o mar subiu", "SUPPORTED"), (2, "nada", "REFUTED")], "claim_id long, claim string, label string")
    text = "o mar subiu muito na costa em todos os pontos medidos ali. " * 2
    sources = spark.createDataFrame([(1, 0, "d", "t", text, "anexo", None, None, None)], "claim_id long, source_ord int, domain string, title string, text string, origin string, published string, ref_period string, copy_of string")
    got = {r["claim_id"]: (r["real"], r["predicted"], r["max_similarity"]) for r in training.predict_set(items, sources, *models(), verify=False).collect()}
    assert got == {1: ("SUPPORTED", "SUPPORTED", 1.0), 2: ("REFUTED", "NOT_ENOUGH_EVIDENCE", None)}
    counts = training.candidate_counts(spark.createDataFrame([(1,), (1,), (2,)], "post_id long"), spark.createDataFrame([(1,), (2,), (3,)], "post_id long")).first()
    assert tuple(counts) == (3, 1, 1.0, 2)


def test_store_changes_and_search(spark, tmp_path):
    store = EvidenceStore(spark, str(tmp_path / "s"))
    rows = [(1, "http://a/1", "a", "a", "Alta do mar em maio", "url", "2024-06-01", "o mar subiu na costa e o porto parou"), (2, "", "b", "b", "Outro", "url", None, "a serra ficou seca"), (3, "http://c/1", "c", "c", "Depois", "url", "2025-01-01", "o mar desceu São Tomé")]
    store.ingest(spark.createDataFrame(rows, SCHEMA))
    embed, _ = models()
    claims = spark.createDataFrame([(7, "quanto o mar subiu em Sao Tome", [1.0, 0.0], "2024-12-31"), (8, "", [0.6, 0.8], None)], "qid long, text string, qvec array<double>, day string").withColumn("until", F.col("day").cast("date"))
    with pytest.raises(RuntimeError, match="no vector"):
        store.search(claims, "m")
    store.index("m", embed)
    got = store.search(claims, "m", top=2).orderBy("claim_id", "source_ord").collect()
    assert [(r["claim_id"], r["source_ord"], r["text"].split()[1], r["origin"], r["copy_of"]) for r in got][:2] == [(7, 1, "mar", "base_propria", "base:1"), (7, 2, "serra", "base_propria", "base:2")]
    assert {r["title"] for r in got if r["claim_id"] == 7} == {"Alta do mar em maio", "Outro (base própria, documento 2)"} and got[0]["ref_period"] == "2024-05"
    assert sum(r["claim_id"] == 8 for r in got) == 2  # no words, but a vector
    checks = spark.createDataFrame([("o mar subiu", "Falso", "x", "2024-01-01", "u1"), ("a serra queimou", "Certo", "y", None, "u2")], "claim string, verdict_original string, agency string, date string, url string")
    store.import_checks(checks)
    assert [r["url"] for r in store.prior_checks(claims).collect()] == ["u1"]
    ids = {r["url"]: r["id"] for r in store.checks().collect()}
    n, errors = store.set_classes(spark.createDataFrame([(2, ids["u1"], "REFUTED"), (3, "?", "REFUTED"), (4, ids["u2"], "?"), (5, ids["u2"], "")], "line long, id string, class string"), "manual")
    assert n == 1 and sorted(r["line"] for r in errors.collect()) == [3, 4]
    store.set_classes(spark.createDataFrame([(2, ids["u1"], "SUPPORTED")], "line long, id string, class string"), "again")
    assert {r["url"]: (r["class"], r["class_origin"]) for r in store.checks().collect()} == {"u1": ("SUPPORTED", "again"), "u2": (None, None)}


def test_migration(spark, tmp_path):
    store = EvidenceStore(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        store.migrate()
    load = store.ingest(spark.createDataFrame([(1, "u", "a", "a", "Alta em maio de 2024", "url", "2024-06-01", "x")], SCHEMA))
    docs = store.read("documents").withColumn("ref_period", F.lit(None).cast("string"))
    old = EvidenceStore(spark, str(tmp_path / "old"))
    old._write("documents", docs, load)
    spark.createDataFrame([(1, load, None, "x", 1)], SCHEMAS["loads"]).write.parquet(f"{old.root}/loads")
    with pytest.raises(RuntimeError, match="migrate"):
        old.read("documents")
    assert old.migrate() == [1, 2] and old.migrate() == []
    assert [r["ref_period"] for r in old.documents().collect()] == ["2024-05"] and old.backfill_periods() == 0
    again = old.ingest(spark.createDataFrame([(1, "v", "b", "b", "T", "url", None, "x"), (2, "w", "c", "c", "T", "url", None, "y")], SCHEMA))
    assert {r["reference"]: r["copy_group"] for r in old.read("documents", (again,)).collect()} == {"b": 1, "c": 3}


def test_loads_by_probing_give_the_groups_of_all(spark, tmp_path):
    import random

    from attesta.operators import copies

    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefghijklmnop") * 2 + str(r.randint(0, 9)) for _ in range(r.randint(0, 40))) for _ in range(12)]
    for k in range(40):
        w = r.choice(texts).split()
        for _ in range(r.randint(0, 2)):
            if w:
                w[r.randrange(len(w))] = "new" + str(k)
        texts.append(" ".join(w))
    store = EvidenceStore(spark, str(tmp_path))
    for k in range(0, len(texts), 18):
        store.ingest(spark.createDataFrame([(j, "", f"r{j}", "d", "t", "url", None, texts[j]) for j in range(k, min(k + 18, len(texts)))], SCHEMA))
    docs = store.read("documents").select("doc_id", "text", "copy_group")
    want = {x["doc_id"]: x["copy_group"] for x in copies.copy_groups(docs.select("doc_id", "text"), greedy=True).collect()}
    assert {x["doc_id"]: x["copy_group"] for x in docs.collect()} == want and len(set(want.values())) < len(want)
    (tmp_path / "_lock").write_text("")
    with pytest.raises(RuntimeError, match="another load"):
        store.ingest(docs.limit(0).selectExpr(*[f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in SCHEMA.split(", ")]))


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("um texto", encoding="utf-8")
    where = str(tmp_path / "store")
    assert main([where, "import-texts", str(tmp_path / "in")], spark) == 0
    (tmp_path / "in" / "b.txt").write_text("", encoding="utf-8")
    assert main([where, "import-texts", str(tmp_path / "in")], spark) == 1  # nothing new, and an error
    (tmp_path / "in" / "c.txt").write_text("outro", encoding="utf-8")
    assert main([where, "import-texts", str(tmp_path / "in")], spark) == 2
    (tmp_path / "u").write_text("http://a/\nhttp://b/\n", encoding="utf-8")
    page = f"<html><title>T</title><article>{'palavras do texto. ' * 60}</article></html>"

    def get(url):
        if "b" in url:
            raise ValueError("no")
        return page

    assert main([where, "import-urls", str(tmp_path / "u")], spark, get) == 2
    assert main([where, "fill-periods"], spark) == 0 and main([where, "migrate"], spark) == 0 and main([where, "statistics"], spark) == 0
    assert "ValueError: no" in capsys.readouterr().err


def test_fan_out(spark):
    page = f"<html><title>T</title><article>{'palavras do texto. ' * 60}</article></html>"

    def get(url):
        if "bad" in url:
            raise ValueError("no")
        return page

    links = spark.createDataFrame([(1, 1, "http://a/"), (1, 2, "http://bad/"), (2, 1, "http://a/")], "answer_id long, source_ord int, url string")
    good, warnings = pages.fan_out(links, spark.createDataFrame([(2, "GDELT", "Timeout")], "answer_id long, engine string, error string"), get)
    assert sorted((r["answer_id"], r["url"]) for r in good.collect()) == [(1, "http://a/"), (2, "http://a/")]
    assert sorted((r["answer_id"], r["warning"]) for r in warnings.collect()) == [(1, "1 página(s) não puderam ser lidas"), (2, "GDELT: Timeout")]
    assert feeds.MOST_URLS == 10


def test_requests_in_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, claim in enumerate(("uma frase de teste", "curta")):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"request_id": str(k), "title": "t", "claims": [claim]}), encoding="utf-8")

    def answer(batch):
        good, bad = requests.checked(batch)
        return good.select("request_id"), bad

    for _ in range(2):  # the second run finds nothing new
        bridge.answer_requests(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), answer).awaitTermination(120)
    assert [r["request_id"] for r in spark.read.json(str(tmp_path / "out/results")).collect()] == ["0"] or [r["request_id"] for r in spark.read.json(str(tmp_path / "out/results")).collect()] == [0]
    assert spark.read.json(str(tmp_path / "out/errors")).select("errors").first()[0] == ["claim"]


def test_both_paths_of_bm25(spark):
    queries = spark.createDataFrame([(1, "o navio azul e São_Luís"), (2, "nada igual"), (3, None)], "qid long, text string")
    chunks = spark.createDataFrame([(1, "navio azul navio"), (2, "sao luis"), (3, "azul"), (4, None)], "chunk_id long, text string")
    a, b = (sorted((r["qid"], r["chunk_id"], round(r["score"], 9)) for r in retrieval.bm25(queries, chunks, literal=n).collect()) for n in (0, 100))
    assert a == b and [(q, c) for q, c, _ in a] == [(1, 1), (1, 2), (1, 3)]


def test_versions_and_groups(spark):
    row = spark.range(1).select(report.versions("m", "n", "e", "c", None).alias("v"), report.group_of(F.lit(""), F.lit("d")).alias("g"), report.rounded(F.lit(0.12345)).alias("r")).first()
    assert row["v"]["evidence"] == "busca_web_tempo_real" and (row["g"], row["r"]) == ("d", 0.1235)


def test_reports_end_to_end(spark):
    text = "o mar subiu muito na costa em todos os pontos medidos ali. " * 2
    kind = "claim_id long, source_ord int, url string, domain string, title string, text string, origin string, published string, ref_period string, copy_of string"
    sources = spark.createDataFrame([(1, 0, "http://d/1", "d", "T", text, "anexo", "2024-01-01", None, None), (1, 1, "http://e/1", "e", "U", text + "mais", "anexo", "2025-01-01", None, None), (2, 0, "http://f/1", "f", "V", "curto", "url", None, None, None)], kind)
    claims = spark.createDataFrame([(1, "o mar subiu", "2024-06-01", 0, True, True), (2, "nada", "junho", 1, False, False), (3, "sem fontes", None, 1, False, True)], "claim_id long, claim string, article_date string, attachments int, searched boolean, used_store boolean")
    checks = spark.createDataFrame([(1, 1, "a", None, "u", "c", "Falso")], "claim_id long, rank int, agency string, date date, url string, claim string, verdict_original string")
    from attesta.operators import analysis

    got = {r["claim_id"]: r for r in analysis.analyze_reports(claims, sources, checks, *models(), "X").collect()}
    assert (got[1]["verdict"], got[1]["independent_sources"], got[1]["reason"], len(got[1]["prior_checks"])) == ("SUPPORTED", 1, "modelo_nao_calibrado", 1)
    assert got[1]["public_text"] == "Resultado da verificação X: as evidências encontradas apoiam esta afirmação." and got[1]["percentage"] is None and not got[1]["evaluable"]
    assert {(e["source"], e["relation"], e["similarity"]) for e in got[1]["evidence"]} == {("T", "apoia", 1.0)}
    assert any("desconsideradas" in x for x in got[1]["limitations"]) and report.NO_FILTER in got[2]["limitations"] and report.NO_STORE in got[2]["limitations"]
    assert (got[2]["verdict"], got[2]["evidence"], got[3]["reason"], got[2]["reason"]) == ("NOT_ENOUGH_EVIDENCE", None, "so_anexo_sem_texto", "evidencia_insuficiente")


def test_first_partners_are_exact_within_and_beyond_the_bounds(spark):
    import random

    from attesta.operators.jaccard import first_partners

    r = random.Random(5)
    base = [f"b{k}" for k in range(60)]
    texts = [None, "", "one two"]
    for k in range(90):  # one large component: some texts are near its first ones, others only near later ones
        w = list(base)
        at = r.choice([0, 20, 40]) + r.randint(0, 12)
        for j in range(at, at + r.randint(0, 7)):
            w[j] = f"n{k % 60}" if r.random() < 0.5 else "n"
        texts.append(" ".join(w))
    texts += [" ".join(f"p{k % 7}-{j}" for j in range(30 + k % 2)) for k in range(30)]
    sets = {k: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for k, t in enumerate(texts)}
    rep = {k: min(j for j in sets if sets[j] == s) if s else k for k, s in sets.items()}
    up = {k: min((j for j in sets if rep[j] == j and j < rep[k] and sets[j] and 5 * len(s & sets[j]) >= 4 * len(s | sets[j])), default=None) if s else None for k, s in sets.items()}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for bound in ({}, {"cluster_sets": 12}, {"cluster_shingles": 700, "flush": 500}):
        got = {x["doc_id"]: (x["rep"], x["up"]) for x in first_partners(docs, 5, 4, 5, **bound).collect()}
        assert got == {k: (rep[k], up[k]) for k in sets}
    assert len({u for u in up.values() if u is not None}) > 10


def test_greedy_groups_shuffle_less_than_a_row_for_each_shingle(spark):
    from attesta.operators import copies

    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    docs = spark.range(300).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(0, 999), k -> concat('w', hash(id div 2, k)))) as text")
    before = written()
    groups = {x["doc_id"]: x["copy_group"] for x in copies.copy_groups(docs, greedy=True).collect()}
    assert groups == {k: k - k % 2 for k in range(300)}
    assert written() - before < 12 * 150 * 996
