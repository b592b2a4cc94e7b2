"""The store's snapshots and the plan from claims to verdicts, with models that stand in."""

import pytest

from attesta.operators import analysis
from attesta.sources.evidence import EvidenceStore

SCHEMA = "ord long, url string, reference string, domain string, title string, origin_type string, published string, text string"


def test_store(spark, tmp_path):
    store = EvidenceStore(spark, str(tmp_path))
    assert store.snapshot() == () and store.read("documents").count() == 0
    text = "Uma frase de teste com nove palavras aqui dentro. " * 40
    rows = [(3, "http://b", "http://b", "b", "Vendas sobem em maio", "url", "2024-06-01T10", text), (1, "http://a", "http://a", "a", None, "url", "ontem", text), (2, "http://a", "http://a", "a", "Outro", "url", None, text), (4, None, None, None, None, None, None, None)]
    first = store.ingest(spark.createDataFrame(rows, SCHEMA))
    assert store.snapshot() == (first,) and store.ingest(spark.createDataFrame(rows, SCHEMA)) is None and store.snapshot() == (first,)
    got = {r["reference"]: r for r in store.read("documents").collect()}
    assert {k: (r["doc_id"], r["copy_group"], r["ref_period"], str(r["published"])) for k, r in got.items()} == {"http://a": (1, 1, None, "None"), "http://b": (2, 1, "2024-05", "2024-06-01"), "": (3, 3, None, "None")}
    chunks = store.read("chunks").count()
    with pytest.raises(RuntimeError, match=f"{chunks} chunks"):
        store.check_index("m")
    second = store.index("m", lambda texts: [[1.0, 0.0]] * len(texts))
    store.check_index("m")
    assert store.index("m", None) is None and store.snapshot() == (first, second) and store.read("vectors", (first,)).count() == 0
    third = store.ingest(spark.createDataFrame([(1, "http://c", "http://c", "c", "T", "url", "2024-07-01", "Texto novo.")], SCHEMA))
    assert store.read("documents", (first,)).count() == 3 and store.read("documents").where("doc_id = 4").count() == 1
    from pyspark.sql import functions as F

    assert {r["doc_id"] for r in store.searchable(F.lit("2024-06-01").cast("date")).select("doc_id").distinct().collect()} == {1, 2}
    assert store.document(2).first()["chunks"] > 1 and store.statistics().first()["snapshot"] == third
    checks = spark.createDataFrame([("c", "Falso", "x", "2024-01-01", "u"), ("c", "Outro", "y", None, "u")], "claim string, verdict_original string, agency string, date string, url string")
    assert store.import_checks(checks) and store.import_checks(checks) is None and store.read("checks").count() == 1


def models():
    """Closures, so that they reach workers by value."""

    def embed(texts):
        return [[1.0, 0.0] for _ in texts]

    def nli(pairs):
        return [(0.96, 0.02, 0.02) if "cresceu" in p else (0.02, 0.02, 0.96) if "caiu" in p else (0.1, 0.8, 0.1) for p, _ in pairs]

    return embed, nli


def test_analysis(spark):
    embed, nli = models()
    claims = spark.createDataFrame([(1, "A conta da Bahia cresceu 6,5% em 2025."), (2, "A conta da Bahia cresceu 6,5% em 2025."), (3, "Nada se sabe disso."), (4, "A conta da Bahia cresceu 6,5% em 2025.")], "claim_id long, claim string")
    good, other = "A conta da Bahia cresceu 6,5% em 2025, disse o governo local ontem.", "A conta de Goiás cresceu 6,5% em 2025, disse o governo local ontem."
    rows = [
        (1, 1, "a.org", "T", good, "busca_web", None, None, None), (1, 2, "b.org", "T", good, "busca_web", None, None, None), (1, 3, "c.org", "T", "Bahia cresceu 6,5% em 2025.", "anexo", None, None, None),
        (2, 1, "a.org", "T", other, "busca_web", None, None, None), (4, 1, "a.org", "T", good, "busca_web", None, None, None), (4, 2, "d.org", "T", "A conta da Bahia caiu em 2025, segundo o jornal da cidade vizinha.", "busca_web", None, None, None), (4, 3, None, None, None, None, None, None, None),
    ]
    sources = spark.createDataFrame(rows, "claim_id long, source_ord long, domain string, title string, text string, origin string, published string, ref_period string, copy_of long")
    got = {r["claim_id"]: (r["verdict"], r["independent_sources"]) for r in analysis.analyze(claims, sources, embed, nli).collect()}
    assert got == {1: ("SUPPORTED", 2), 2: ("NOT_ENOUGH_EVIDENCE", 0), 3: ("NOT_ENOUGH_EVIDENCE", 0), 4: ("CONFLICTING_EVIDENCE", 2)}
    loose = {r["claim_id"]: r["verdict"] for r in analysis.analyze(claims, sources, embed, nli, verify=False).collect()}
    assert loose[2] == "SUPPORTED"


def test_trace_has_every_window(spark):
    embed, nli = models()
    claims = spark.createDataFrame([(1, "A conta da Bahia cresceu 6,5% em 2025.")], "claim_id long, claim string")
    texts = " ".join(f"A conta número {k} da Bahia cresceu 6,5% em 2025, disse o governo." for k in range(5))
    rows = [(1, k, f"{'abcdefgh'[k]}.org", "T", texts if k == 0 else texts[:60] + f" {k}.", "busca_web", None, None, f"g{k}") for k in range(8)]
    sources = spark.createDataFrame(rows, "claim_id long, source_ord long, domain string, title string, text string, origin string, published string, ref_period string, grp string")
    got = analysis.trace(claims, sources, embed, nli).collect()
    assert len(got) == analysis.candidate_windows(sources).count() == 9 + 7  # score alone has 3 of a source and 6 sources
    assert sum(r["to_nli"] for r in got) == analysis.score(claims, sources, embed, nli).count() == 3 + 5
    assert all((r["p_ent"] is not None) == r["to_nli"] and r["similarity"] == 1.0 and (r["to_nli"] or not r["in_report"]) for r in got)
    assert [r["parts"] for r in sorted(got, key=lambda r: r["win_ord"]) if r["source_ord"] == 0] == [1] * 5 + [2] * 4
    assert {r["source_ord"] for r in got if r["in_report"]} == set(range(6))
