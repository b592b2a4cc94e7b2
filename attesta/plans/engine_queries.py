"""Queries of the store's search, the report, requests and evaluation over the driver's tables, added to the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import report, requests, search, training, verdict
from attesta.plans.registry import _BM25, _REL, _SCORED, _scored, query
from attesta.sources import files
from attesta.sources.store import table

_DAY = "CASE WHEN doc_id % 7 <> 0 THEN make_date((2020 + doc_id % 6)::INT, (1 + doc_id % 12)::INT, (1 + doc_id % 28)::INT) END"
_UNTIL = "CASE WHEN item_id % 5 <> 0 THEN make_date((2020 + item_id % 6)::INT, 6, 15) END"
_LATE = "until IS NULL OR published IS NULL OR published <= until"


def _store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Claims from the benchmark, chunks from the documents and vectors of both from the embeddings; dates are made from ids."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    i, d = F.col("item_id"), F.col("doc_id")
    until = F.when(i % 5 != 0, F.make_date((2020 + i % 6).cast("int"), F.lit(6), F.lit(15)))
    claims = table(spark, sf_dir, "benchmark").select(i.alias("qid"), "text", until.alias("until")).join(e.select(F.col("vec_id").alias("qid"), F.col("vec").alias("qvec")), "qid", "left")
    published = F.when(d % 7 != 0, F.make_date((2020 + d % 6).cast("int"), (1 + d % 12).cast("int"), (1 + d % 28).cast("int")))
    chunks = table(spark, sf_dir, "documents").select(
        d.alias("chunk_id"), "text", published.alias("published"), F.lit("").alias("url"), F.concat(F.lit("d"), d).alias("title"), F.col("source").alias("domain"), F.col("text").alias("full_text"), (d % 100).alias("copy_group"), F.lit(None).cast("string").alias("ref_period"),
    )
    return claims, chunks, e.select(F.col("vec_id").alias("chunk_id"), "vec")


@query(f"""WITH {_BM25.rsplit("r AS (", 1)[0].rstrip().rstrip(",")}, p1 AS (SELECT doc_id AS chunk_id, {_DAY} AS published, source, text FROM documents), u AS (SELECT item_id AS qid, {_UNTIL} AS until FROM benchmark),
r AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM b JOIN p1 USING (chunk_id) JOIN u USING (qid) WHERE {_LATE} QUALIFY rank <= 10),
v AS (SELECT a.vec_id AS qid, e.vec_id AS chunk_id, list_dot_product(a.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings a JOIN u ON u.qid = a.vec_id, embeddings e JOIN p1 ON p1.chunk_id = e.vec_id WHERE {_LATE}),
w AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM v QUALIFY rank <= 10),
s AS (SELECT qid, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM r UNION ALL SELECT * FROM w) GROUP BY qid, chunk_id),
g AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s QUALIFY rank <= 10)
SELECT qid AS claim_id, rank::INT AS source_ord, chunk_id, 'd' || chunk_id AS title, source AS domain, published, 'base:' || (chunk_id % 100) AS copy_of, md5(text) AS text_md5 FROM g JOIN p1 USING (chunk_id)""")
def store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks of each claim by both searches, published by its day, as sources."""
    claims, chunks, vectors = _store(spark, sf_dir)
    got = search.hydrated(search.hybrid(claims, chunks.select("chunk_id", "text", "published"), vectors), chunks)
    return got.select("claim_id", "source_ord", "chunk_id", "title", "domain", "published", "copy_of", F.md5("text").alias("text_md5"))


@query(("WITH " + _BM25).replace("item_id AS qid", "conv_id * 100 + turn AS qid").replace("FROM benchmark", "FROM conversations WHERE turn = 0").replace("doc_id AS chunk_id", "item_id AS chunk_id").replace("FROM documents", "FROM benchmark").replace("rank <= 10", "rank <= 3") + " SELECT qid AS claim_id, rank::INT AS rank, chunk_id AS check_id, md5(text) AS claim_md5 FROM r JOIN benchmark ON item_id = chunk_id")
def prior_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three items most like the first turn of each conversation."""
    claims = table(spark, sf_dir, "conversations").where("turn = 0").select((F.col("conv_id") * 100 + F.col("turn")).alias("qid"), "text")
    none = F.lit(None).cast("string")
    checks = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("check_id"), F.col("text").alias("claim"), none.alias("agency"), none.alias("date"), none.alias("url"), none.alias("verdict_original"))
    return search.prior_checks(claims, checks).select("claim_id", "rank", "check_id", F.md5("claim").alias("claim_md5"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consolidated windows with all that a report lists; every third group is empty, so that the domain stands for it."""
    kept = verdict.consolidate(_scored(spark, sf_dir)).withColumn("nli", F.greatest("p_ent", "p_neu", "p_con"))
    s = F.col("source_ord")
    return kept.withColumns({"grp": F.when(s % 3 == 0, "").otherwise(F.col("grp")), "domain": F.concat(F.lit("d"), s % 4), "title": F.concat(F.lit("t"), s), "url": F.concat(F.lit("http://x/"), s), "published": F.lit(None).cast("date"), "window": F.concat(F.lit("w"), "win_ord"), "origin": F.lit("url")})


_KEPT = f"""k AS (SELECT claim_id, source_ord, win_ord, CASE WHEN source_ord % 3 = 0 THEN 'd' || (source_ord % 4) ELSE grp END AS g, similarity, greatest(p_ent, p_neu, p_con) AS nli, {_REL} AS relation
FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, source_ord ORDER BY p_ent DESC, win_ord) AS a, row_number() OVER (PARTITION BY claim_id, source_ord ORDER BY p_con DESC, win_ord) AS c FROM i) WHERE a = 1 OR c = 1),
l AS (SELECT claim_id, list_sort(list_distinct(list(g) FILTER (relation = 'entailment' AND similarity >= 0.43 AND nli >= 0.72))) AS f, list_sort(list_distinct(list(g) FILTER (relation = 'contradiction' AND similarity >= 0.43 AND nli >= 0.72))) AS o, count(*) AS n FROM k GROUP BY claim_id),
y AS (SELECT item_id AS claim_id, coalesce(f, []) AS f, coalesce(o, []) AS o, coalesce(n, 0) AS n, text FROM benchmark LEFT JOIN l ON l.claim_id = item_id),
z AS (SELECT *, CASE WHEN len(f) > 0 AND len(o) > 0 THEN 'CONFLICTING_EVIDENCE' WHEN len(o) > 0 THEN 'REFUTED' WHEN len(f) > 0 THEN 'SUPPORTED' ELSE 'NOT_ENOUGH_EVIDENCE' END AS verdict FROM y)"""


def _in(texts: dict[str, str]) -> str:
    return "CASE verdict " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in texts.items()) + " END"


@query(f"WITH {_SCORED}, {_KEPT} SELECT claim_id, verdict, len(list_distinct(list_concat(f, o)))::BIGINT AS independent_sources, array_to_string(f, ' ') AS groups_for, array_to_string(o, ' ') AS groups_against, {_in(report.RULES)} AS rule FROM z")
def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups on each side of every claim, and the rule that decided."""
    claims = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"))
    out = report.explanations(claims, _items(spark, sf_dir))
    return out.select("claim_id", "verdict", F.col("independent_sources").cast("long").alias("independent_sources"), F.array_join("groups_for", " ").alias("groups_for"), F.array_join("groups_against", " ").alias("groups_against"), "rule")


@query(f"""WITH {_SCORED}, {_KEPT}, e AS (SELECT claim_id, string_agg('t' || source_ord || ' w' || win_ord || ' ' || CASE relation WHEN 'entailment' THEN 'apoia' WHEN 'contradiction' THEN 'contradiz' ELSE 'neutro' END, '; ' ORDER BY source_ord, win_ord) AS evidence FROM k GROUP BY claim_id)
SELECT z.claim_id, verdict, 'Resultado da verificação X: ' || {_in(report.PUBLIC)} AS public_text, false AS evaluable, CASE WHEN verdict <> 'NOT_ENOUGH_EVIDENCE' THEN 'modelo_nao_calibrado' WHEN z.claim_id % 4 = 1 THEN 'so_anexo_sem_texto' ELSE 'evidencia_insuficiente' END AS reason, e.evidence,
CASE verdict WHEN 'SUPPORTED' THEN len(f) || ' fonte(s) independente(s) trazem trechos que apoiam a afirmação, e nenhuma fonte com relação forte a contradiz.' WHEN 'REFUTED' THEN len(o) || ' fonte(s) independente(s) trazem trechos que contradizem a afirmação, e nenhuma fonte com relação forte a apoia.'
WHEN 'CONFLICTING_EVIDENCE' THEN len(f) || ' fonte(s) apoiam e ' || len(o) || ' fonte(s) contradizem a afirmação.' ELSE CASE WHEN n > 0 THEN 'Os trechos encontrados não têm relação forte o bastante com a afirmação para sustentar um resultado.' ELSE 'Nenhum trecho relacionado à afirmação foi encontrado nas fontes consultadas.' END END AS rationale,
(2 + (z.claim_id % 3 = 0)::INT + (z.claim_id % 2 <> 0)::INT + (z.claim_id % 4 = 1)::INT)::BIGINT AS limitations, (z.claim_id % 5 = 0)::INT::BIGINT AS checks
FROM z LEFT JOIN e USING (claim_id)""")
def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report row of every claim."""
    k = F.col("item_id")
    claims = table(spark, sf_dir, "benchmark").select(k.alias("claim_id"), F.col("text").alias("claim"), F.when(k % 4 == 1, 1).otherwise(0).alias("attachments"), F.lit(False).alias("had_text"), (k % 3 == 0).alias("searched"), ((k % 2 == 0)).alias("used_store"), F.lit(None).cast("array<string>").alias("notes"))
    none = F.lit(None).cast("string")
    checks = claims.where("claim_id % 5 = 0").select("claim_id", F.lit(1).alias("rank"), none.alias("agency"), none.alias("date"), none.alias("url"), none.alias("claim"), none.alias("verdict_original"))
    out = report.reports(claims, _items(spark, sf_dir), checks, "X")
    listed = F.array_join(F.transform("evidence", lambda x: F.concat_ws(" ", x["source"], x["passage"], x["relation"])), "; ")
    had = F.coalesce(F.size("prior_checks"), F.lit(0))
    store_note = F.when((had > 0) & (F.col("claim_id") % 2 != 0), 1).otherwise(0)  # an earlier check says that the store was asked
    return out.select("claim_id", "verdict", "public_text", "evaluable", "reason", listed.alias("evidence"), "rationale", (F.size("limitations") + store_note).cast("long").alias("limitations"), had.cast("long").alias("checks"))


@query(r"""WITH u AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN replace(url, 'http', 'ftp') WHEN page_id % 9 = 1 THEN replace(url, '.', '..') WHEN page_id % 9 = 2 THEN replace(url, '/', ' ') WHEN page_id % 9 = 3 THEN '' ELSE url END AS u FROM pages)
SELECT page_id, u = '' OR (length(u) <= 2048 AND NOT regexp_matches(u, '\s') AND regexp_matches(u, '^https?://([a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)(\.[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*\.?(:[0-9]*)?([/?#]|$)')) AS valid_url FROM u""")
def url_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which URLs a request may name; some are spoilt in turn."""
    k, u = F.col("page_id") % 9, F.col("url")
    spoilt = F.when(k == 0, F.replace(u, F.lit("http"), F.lit("ftp"))).when(k == 1, F.replace(u, F.lit("."), F.lit(".."))).when(k == 2, F.replace(u, F.lit("/"), F.lit(" "))).when(k == 3, "").otherwise(u)
    return requests.with_url_validity(table(spark, sf_dir, "pages").select("page_id", spoilt.alias("url"))).select("page_id", "valid_url")


@query(r"""WITH c AS (SELECT conv_id, list(trim(coalesce(text, ''), ' ') ORDER BY turn) AS claims, count(*) AS n FROM conversations GROUP BY conv_id),
e AS (SELECT conv_id, CASE WHEN n NOT BETWEEN 1 AND 10 THEN ['claims'] ELSE [] END AS a, CASE WHEN len(list_filter(claims, lambda x: length(x) NOT BETWEEN 10 AND 500)) > 0 THEN ['claim'] ELSE [] END AS b, CASE WHEN conv_id % 3 = 0 THEN ['attachments'] ELSE [] END AS d, CASE WHEN conv_id % 2 = 0 THEN ['title'] ELSE [] END AS t FROM c)
SELECT conv_id AS request_id, array_to_string(list_concat(t, a, b, d), ' ') AS errors FROM e WHERE len(list_concat(t, a, b, d)) > 0""")
def request_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with requests made of conversations."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("x")))), lambda x: x["x"]).alias("claims"))
    evidence = "array<struct<title:string,text:string,url:string,origin:string,published:string>>"
    k = F.col("conv_id")
    made = turns.select(k.alias("request_id"), F.when(k % 2 == 0, "").otherwise("t").alias("title"), F.lit("").alias("text"), F.lit(None).cast("string").alias("date"), "claims", F.lit(None).cast(evidence).alias("evidence"), F.when(k % 3 == 0, 21).otherwise(0).alias("attachments"))
    return requests.checked(made)[1].select("request_id", F.array_join("errors", " ").alias("errors"))


@query("""WITH d AS (SELECT md5(coalesce(text, '')) AS t, doc_id % 3 AS k FROM documents), s AS (SELECT DISTINCT t, k FROM d)
SELECT 'p' || a.k AS a, 'p' || b.k AS b, count(*) FILTER (b.t = a.t) AS shared FROM s a JOIN s b ON a.k < b.k AND a.t = b.t GROUP BY ALL""")
def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that thirds of the documents share."""
    d = table(spark, sf_dir, "documents").select(F.md5(F.coalesce("text", F.lit(""))).alias("t"), (F.col("doc_id") % 3).alias("k"))
    return training.leakage({f"p{k}": d.where(F.col("k") == k) for k in range(3)}, ["t"])


_KEY = r"trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))"


@query(f"WITH t AS (SELECT DISTINCT {_KEY} AS k FROM documents WHERE doc_id % 4 <> 0) SELECT doc_id, {_KEY} IN (SELECT k FROM t) AS seen FROM documents WHERE doc_id % 4 = 0")
def seen_in_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a quarter of the documents the rest has, but for case and white space."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return training.seen_in(d.where("doc_id % 4 = 0"), d.where("doc_id % 4 != 0"), "text").select("doc_id", "seen")


_MEASURED = "m AS (SELECT doc_id, quality AS label, (doc_id * 37 % 101) / 100.0::DOUBLE AS p FROM labels)"


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), ((F.col("doc_id") * 37 % 101) / F.lit(100.0)).alias("p")).withColumn("predicted", (F.col("p") >= 0.5).cast("int"))


@query(f"""WITH {_MEASURED}, w AS (SELECT doc_id AS id, p, CASE WHEN p >= 0.5 THEN 'false_approval' ELSE 'missed' END AS kind FROM m WHERE label <> (p >= 0.5)::INT)
SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY CASE kind WHEN 'missed' THEN p ELSE -p END, id)::INT AS rank, id, p FROM w QUALIFY rank <= 5""")
def worst_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surest wrong predictions of either kind."""
    return training.worst_errors(_measured(spark, sf_dir))


@query("""WITH r AS (SELECT doc_id, doc_id % 5 = 0 AS seen, s AS system, (doc_id * (s + 3) % 11) / 10.0::DOUBLE AS x FROM documents, (SELECT unnest([0, 1]) AS s)), u AS (SELECT 'all' AS slice, * FROM r UNION ALL SELECT CASE WHEN seen THEN 'seen' ELSE 'unseen' END, * FROM r)
SELECT slice, system::BIGINT AS system, count(*) AS n, round(avg(x), 9) AS word_f1, round(avg(x / 2), 9) AS rouge_l, round(avg(1 - x), 9) AS coverage FROM u GROUP BY slice, system""")
def extraction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by system over all, seen and unseen posts."""
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(d.alias("post_id"), (d % 5 == 0).alias("seen"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("system"))
    x = (F.col("post_id") * (F.col("system") + 3) % 11) / F.lit(10.0)
    out = training.extraction_summary(rows.withColumns({"word_f1": x, "rouge_l": x / 2, "coverage": 1 - x}))
    return out.select("slice", "system", "n", *[F.round(m, 9).alias(m) for m in ("word_f1", "rouge_l", "coverage")])


@query(f"WITH {_SCORED} SELECT win_ord, (p_ent >= greatest(p_neu, p_con))::INT AS by_nli, (similarity >= 0.43 AND p_ent >= 0.72)::INT AS by_rule FROM i")
def baseline_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: decisions without training."""
    return _scored(spark, sf_dir).select("win_ord", training.nli_decision(F.col("p_ent"), F.col("p_neu"), F.col("p_con")).alias("by_nli"), training.rule_decision(F.col("similarity"), F.col("p_ent")).alias("by_rule"))


@query(r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^.!?]+[.!?]*'))::BIGINT AS sentences, md5(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS tsv_md5 FROM documents")
def text_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sentences a trace counts, and texts as fields of tab-separated files."""
    return table(spark, sf_dir, "documents").select("doc_id", files.sentence_count(F.col("text")).cast("long").alias("sentences"), F.md5(files.tsv_text(F.col("text"))).alias("tsv_md5"))


@query(f"""WITH {_SCORED}, f AS (SELECT claim_id, grp, source_ord FROM i GROUP BY ALL) SELECT claim_id, grp, string_agg('t' || source_ord, ' ' ORDER BY source_ord) AS titles FROM f GROUP BY claim_id, grp""")
def trace_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The titles of each group."""
    rows = _scored(spark, sf_dir).withColumn("title", F.concat(F.lit("t"), "source_ord"))
    return report.groups_of_trace(rows).select("claim_id", "grp", F.array_join("titles", " ").alias("titles"))


