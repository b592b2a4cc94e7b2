"""Queries over the driver's tables and their DuckDB SQL. Every query reads its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import copies, evaluate, retrieval, verdict
from attesta.sources.store import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
CLASSES = ["0", "1"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_STOP = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"
_SENTENCES = r"list_slice(list_transform(list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda s: length(s) BETWEEN 45 AND 800), lambda s: substr(s, 1, 650)), 1, 120)"
_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"


@query(f"WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents) SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM s")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents),
w AS (SELECT doc_id, list_concat(s, list_transform(range(1, len(s)), lambda i: s[i] || ' ' || s[i + 1])) AS w FROM s)
SELECT doc_id, generate_subscripts(w, 1) - 1 AS win_ord, md5(unnest(w)) AS window_md5 FROM w""")
def sentence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: windows of one and two sentences, as digests."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.windows(T.sentences(F.col("text")))).alias("win_ord", "w"))
    return w.select("doc_id", F.col("win_ord").cast("long").alias("win_ord"), F.md5("w").alias("window_md5"))


@query(f"SELECT item_id, array_to_string(list_slice(list_distinct_in_order, 1, 8), ' ') AS terms FROM (SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_in_order FROM (SELECT item_id, list_filter({_WORDS}, lambda x: length(x) > 2 AND x NOT IN {_STOP}) AS w FROM benchmark))")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight distinct terms of each claim."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.terms(F.col("text"), 8), " ").alias("terms"))


_ASKED_STOP = "(" + ", ".join(f"'{w}'" for w in T.QUERY_STOP_WORDS) + ")"
_INDEXED = r"regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}]+')"
_BM25 = f"""q AS (SELECT DISTINCT qid, unnest(regexp_extract_all(strip_accents(w), '[\\p{{L}}\\p{{N}}]+')) AS term FROM (SELECT item_id AS qid, unnest(list_filter({_WORDS}, lambda x: length(x) > 2 AND x NOT IN {_ASKED_STOP})) AS w FROM benchmark)),
t AS (SELECT doc_id AS chunk_id, {_INDEXED} AS w FROM documents),
n AS (SELECT count(*) AS n, avg(len(w)) AS a FROM t),
p AS (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM t),
f AS (SELECT chunk_id, dl, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM f GROUP BY term),
b AS (SELECT qid, chunk_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS score FROM f JOIN d USING (term) JOIN q USING (term), n GROUP BY qid, chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM b QUALIFY rank <= 10)"""


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return retrieval.ranked(retrieval.bm25(claims, chunks).withColumn("score", F.round("score", 9)), "qid", "score", "chunk_id", retrieval.TOP)


@query(f"WITH {_BM25} SELECT qid, chunk_id, rank, round(score, 6) AS score FROM r")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each claim."""
    return _bm25(spark, sf_dir).select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


_VECTOR = """v AS (SELECT a.vec_id AS qid, b.vec_id AS chunk_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
w AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM v QUALIFY rank <= 10)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    return retrieval.vector_topk(vectors.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("qid"), F.col("vec").alias("qvec")), vectors)


@query(f"WITH {_VECTOR} SELECT qid, chunk_id, rank, round(score, 6) AS score FROM w")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every query vector."""
    return _vectors(spark, sf_dir).select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"""WITH {_BM25}, {_VECTOR}, u AS (SELECT qid, chunk_id, rank FROM r UNION ALL SELECT qid, chunk_id, rank FROM w),
s AS (SELECT qid, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM u GROUP BY qid, chunk_id)
SELECT qid, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s QUALIFY rank <= 10""")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank fusion of both searches."""
    fused = retrieval.rrf([_bm25(spark, sf_dir), _vectors(spark, sf_dir)]).withColumn("score", F.round("score", 9))
    return retrieval.ranked(fused, "qid", "score", "chunk_id", retrieval.TOP).select("qid", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_PAIRS = f"""t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' ')) END)) AS s FROM t),
c AS MATERIALIZED (SELECT s, min(doc_id) AS doc_id, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
e AS MATERIALIZED (SELECT doc_id, n, unnest(s) AS g FROM c),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter, a.n + b.n - count(*) AS uni FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n),
l AS MATERIALIZED (SELECT a, b, inter, uni FROM o WHERE 5 * inter >= 4 * uni),
m AS (SELECT s.doc_id, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE c.doc_id END AS rep FROM s LEFT JOIN c ON c.s = s.s)"""


@query(f"WITH {_PAIRS} SELECT a, b, inter, uni FROM l")
def shingle_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies, between representatives of equal sets."""
    return copies.jaccard_pairs(table(spark, sf_dir, "documents")).select("a", "b", F.col("inter").cast("long").alias("inter"), F.col("uni").cast("long").alias("uni"))


@query(f"""WITH RECURSIVE {_PAIRS}, y AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
k(node, root) AS (SELECT DISTINCT rep, rep FROM m UNION SELECT y.b, k.root FROM k JOIN y ON y.a = k.node WHERE k.root < y.b)
SELECT doc_id, min(root) AS copy_group FROM m JOIN k ON k.node = m.rep GROUP BY doc_id""")
def copy_groups_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected groups of copies."""
    return copies.copy_groups(table(spark, sf_dir, "documents"))


@query(f"""WITH RECURSIVE {_PAIRS}, u AS (SELECT b AS node, min(a) AS up FROM l GROUP BY b),
k(node, root) AS (SELECT rep, rep FROM (SELECT DISTINCT rep FROM m) WHERE rep NOT IN (SELECT node FROM u) UNION ALL SELECT u.node, k.root FROM k JOIN u ON u.up = k.node)
SELECT doc_id, root AS copy_group FROM m JOIN k ON k.node = m.rep""")
def copy_groups_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: groups by the first earlier copy."""
    return copies.copy_groups(table(spark, sf_dir, "documents"), greedy=True)


_SCORED = """x AS (SELECT vec_id, vec_id % 50 AS claim_id, vec_id // 50 % 12 AS source_ord, label, embedding[1]::DOUBLE AS e1, embedding[2]::DOUBLE AS e2, embedding[3]::DOUBLE AS e3 FROM embeddings),
i AS (SELECT claim_id, source_ord, 'g' || (source_ord % 5)::VARCHAR AS grp, vec_id AS win_ord, round(0.5 + 2 * e1, 6) AS similarity, abs(e1) / (abs(e1) + abs(e2) + abs(e3) + 1e-9) AS p_ent, abs(e2) / (abs(e1) + abs(e2) + abs(e3) + 1e-9) AS p_neu, abs(e3) / (abs(e1) + abs(e2) + abs(e3) + 1e-9) AS p_con FROM x)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored windows made from the embeddings' first coordinates: stand-ins for model output, to exercise the operators on whole tables."""
    e = [F.col("embedding")[k].cast("double") for k in range(3)]
    total = F.abs(e[0]) + F.abs(e[1]) + F.abs(e[2]) + 1e-9
    claim, source = F.col("vec_id") % 50, (F.expr("vec_id div 50") % 12)
    return table(spark, sf_dir, "embeddings").select(claim.alias("claim_id"), source.alias("source_ord"), F.concat(F.lit("g"), (source % 5).cast("string")).alias("grp"), F.col("vec_id").alias("win_ord"), F.round(0.5 + 2 * e[0], 6).alias("similarity"), (F.abs(e[0]) / total).alias("p_ent"), (F.abs(e[1]) / total).alias("p_neu"), (F.abs(e[2]) / total).alias("p_con"))


@query(f"""WITH {_SCORED}, t AS (SELECT *, row_number() OVER (PARTITION BY claim_id, source_ord ORDER BY similarity DESC, win_ord) AS win_rank FROM i WHERE similarity >= 0.38 QUALIFY win_rank <= 3),
s AS (SELECT claim_id, source_ord, similarity AS best, (row_number() OVER (PARTITION BY claim_id, grp ORDER BY similarity DESC, source_ord) > 1)::INT AS again FROM t WHERE win_rank = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY again, best DESC, source_ord) AS source_rank FROM s QUALIFY source_rank <= 6)
SELECT claim_id, source_ord, win_ord, win_rank, source_rank FROM t JOIN p USING (claim_id, source_ord)""")
def diversified_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best windows of diversified sources."""
    return verdict.select_windows(_scored(spark, sf_dir)).select("claim_id", "source_ord", "win_ord", F.col("win_rank").cast("long").alias("win_rank"), F.col("source_rank").cast("long").alias("source_rank"))


_REL = "CASE WHEN p_ent >= p_neu AND p_ent >= p_con THEN 'entailment' WHEN p_neu >= p_con THEN 'neutral' ELSE 'contradiction' END"


@query(f"""WITH {_SCORED}, b AS (SELECT *, row_number() OVER (PARTITION BY claim_id, source_ord ORDER BY p_ent DESC, win_ord) AS a, row_number() OVER (PARTITION BY claim_id, source_ord ORDER BY p_con DESC, win_ord) AS c FROM i)
SELECT claim_id, source_ord, win_ord, {_REL} AS relation FROM b WHERE a = 1 OR c = 1""")
def consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: the telling windows of each source."""
    return verdict.consolidate(_scored(spark, sf_dir)).select("claim_id", "source_ord", "win_ord", "relation")


@query(f"""WITH {_SCORED}, g AS (SELECT claim_id, grp, max(({_REL} = 'entailment')::INT) AS s, max(({_REL} = 'contradiction')::INT) AS r FROM i WHERE similarity >= 0.43 AND greatest(p_ent, p_neu, p_con) >= 0.72 GROUP BY ALL),
v AS (SELECT claim_id, sum(s) AS s, sum(r) AS r, sum(greatest(s, r)) AS n FROM g GROUP BY claim_id)
SELECT b.item_id AS claim_id, CASE WHEN s > 0 AND r > 0 THEN 'CONFLICTING_EVIDENCE' WHEN r > 0 THEN 'REFUTED' WHEN s > 0 THEN 'SUPPORTED' ELSE 'NOT_ENOUGH_EVIDENCE' END AS verdict, coalesce(n, 0)::BIGINT AS independent_sources
FROM benchmark b LEFT JOIN v ON v.claim_id = b.item_id""")
def verdict_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2: the verdict on every claim."""
    items = _scored(spark, sf_dir)
    relation = F.when((F.col("p_ent") >= F.col("p_neu")) & (F.col("p_ent") >= F.col("p_con")), "entailment").when(F.col("p_neu") >= F.col("p_con"), "neutral").otherwise("contradiction")
    items = items.select("claim_id", "grp", relation.alias("relation"), "similarity", F.greatest("p_ent", "p_neu", "p_con").alias("nli"))
    claims = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"))
    return verdict.verdicts(claims, items).withColumn("independent_sources", F.col("independent_sources").cast("long"))


QUERIES["verdict"], SQL["verdict"] = QUERIES.pop("verdict_"), SQL.pop("verdict_")


@query("SELECT o_orderkey, o_orderdate::DATE AS published FROM orders WHERE o_orderdate IS NULL OR o_orderdate::DATE <= DATE '1996-06-30'")
def date_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was published by a date, and what is undated."""
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").where(day.isNull() | (day <= F.lit("1996-06-30").cast("date"))).select("o_orderkey", day.alias("published"))


@query(r"SELECT page_id, coalesce(nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), ''), 'documento:' || page_id) AS domain FROM pages")
def page_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: the domain of every page."""
    return table(spark, sf_dir, "pages").select("page_id", T.domain(F.col("url"), F.col("page_id").cast("string")).alias("domain"))


_CODES = "p AS (SELECT quality::VARCHAR AS real, toxic::VARCHAR AS predicted FROM labels)"


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("real"), F.col("toxic").cast("string").alias("predicted"))


_F1 = f"{_CODES}, c AS (SELECT unnest(['0', '1']) AS class), f AS (SELECT class, 2 * count(*) FILTER (real = class AND predicted = class) AS a, count(*) FILTER (real = class) + count(*) FILTER (predicted = class) AS b FROM c, p GROUP BY class), g AS (SELECT class, CASE WHEN b > 0 THEN a::DOUBLE / b END AS f1 FROM f)"


@query(f"WITH {_CODES}, c AS (SELECT unnest(['0', '1']) AS c) SELECT a.c AS real, b.c AS predicted, (SELECT count(*) FROM p WHERE real = a.c AND predicted = b.c) AS n FROM c a, c b")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7."""
    return evaluate.confusion(_codes(spark, sf_dir), CLASSES)


@query(f"WITH {_F1} SELECT class, round(f1, 6) AS f1 FROM g")
def f1_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8."""
    return evaluate.f1(_codes(spark, sf_dir), CLASSES).select("class", F.round("f1", 6).alias("f1"))


@query(f"WITH {_F1} SELECT round(coalesce(avg(f1), 0.0), 6) AS macro_f1 FROM g")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9."""
    return evaluate.macro_f1(_codes(spark, sf_dir), CLASSES).select(F.round("macro_f1", 6).alias("macro_f1"))


@query(f"WITH {_CODES} SELECT round(avg((predicted = '1')::INT) FILTER (real <> '1'), 6) AS false_approval_rate FROM p")
def false_approval_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    return evaluate.false_approval_rate(_codes(spark, sf_dir), "1").select(F.round("false_approval_rate", 6).alias("false_approval_rate"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id IS NOT NULL)")
def missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf_dir, "documents").join(vectors, "doc_id", "left_anti").select("doc_id")


@query("SELECT count(*) AS documents, count(DISTINCT md5(text)) AS texts, count(DISTINCT source) AS domains, count(*) FILTER (lang IS NULL) AS unlabelled, sum(n_chars)::BIGINT AS chars FROM documents")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: the store in numbers."""
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("documents"), F.count_distinct(F.md5("text")).alias("texts"), F.count_distinct("source").alias("domains"), F.count_if(F.col("lang").isNull()).alias("unlabelled"), F.sum("n_chars").alias("chars"))


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last snapshot, ties by id."""
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id", "event_type")
