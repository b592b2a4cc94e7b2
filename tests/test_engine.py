"""Verdict, selection and evaluation on hand-made rows."""

import pytest

from attesta.operators import copies, evaluate, retrieval, verdict

CASES = [
    ([], "NOT_ENOUGH_EVIDENCE", 0),
    ([("a", "entailment", 0.8, 0.9), ("b", "entailment", 0.7, 0.85)], "SUPPORTED", 2),
    ([("a", "entailment", 0.4, 0.95)], "NOT_ENOUGH_EVIDENCE", 0),
    ([("a", "contradiction", 0.8, 0.5)], "NOT_ENOUGH_EVIDENCE", 0),
    ([("a", "contradiction", 0.8, 0.9)], "REFUTED", 1),
    ([("a", "contradiction", 0.8, 0.9), ("b", "entailment", 0.8, 0.9)], "CONFLICTING_EVIDENCE", 2),
    ([("a", "entailment", 0.8, 0.9), ("a", "entailment", 0.8, 0.9)], "SUPPORTED", 1),
    ([("a", "entailment", 0.43, 0.72)], "SUPPORTED", 1),
]


def test_verdicts(spark):
    claims = spark.createDataFrame([(k,) for k in range(len(CASES))], "claim_id long")
    items = spark.createDataFrame([(k, *x) for k, (rows, _, _) in enumerate(CASES) for x in rows], "claim_id long, grp string, relation string, similarity double, nli double")
    got = {r["claim_id"]: (r["verdict"], r["independent_sources"]) for r in verdict.verdicts(claims, items).collect()}
    assert got == {k: (v, n) for k, (_, v, n) in enumerate(CASES)}


def test_metrics(spark):
    pairs = spark.createDataFrame([("S", "S"), ("S", "R"), ("R", "S"), ("R", "R"), ("N", "N")], "real string, predicted string")
    classes = ["S", "R", "N", "C"]
    assert {r["class"]: r["f1"] for r in evaluate.f1(pairs, classes).collect()} == {"S": 0.5, "R": 0.5, "N": 1.0, "C": None}
    assert evaluate.macro_f1(pairs, classes).first()[0] == pytest.approx(2 / 3)
    assert evaluate.false_approval_rate(pairs, "S").first()[0] == pytest.approx(1 / 3)


def test_rrf(spark):
    lists = [spark.createDataFrame([(1, c, r) for r, c in enumerate(x, 1)], "qid long, chunk_id long, rank long") for x in ([1, 2, 3], [3, 1])]
    rows = retrieval.rrf(lists).orderBy("score", ascending=False).collect()
    assert [r["chunk_id"] for r in rows] == [1, 3, 2]


def test_bridge_separates_closure_from_greedy(spark):
    base = [f"w{k}" for k in range(60)]
    a, b, c = list(base), list(base), list(base)
    a[0] = "x"
    c[-1], c[-2], c[-3], c[-4] = "p", "q", "r", "s"
    a[1], a[2], a[3] = "t", "u", "v"
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(c)), (3, " ".join(b)), (4, None), (5, "")], "doc_id long, text string")
    closure = {r["doc_id"]: r["copy_group"] for r in copies.copy_groups(docs).collect()}
    greedy = {r["doc_id"]: r["copy_group"] for r in copies.copy_groups(docs, greedy=True).collect()}
    assert closure == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert greedy == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
