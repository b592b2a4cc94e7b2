"""The queries opN_<name> over the driver's tables, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import decontam, html, jaccard, lm, packing, quality, rules, sharding, substring, urls
from attesta.llm.base import table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _remainder(divisor: int) -> str:
    return f"pmod(crc32(cast(doc_id as string)), {divisor})"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op3_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), f"{_remainder(5)} != 1")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), f"{_remainder(4)} != 2")
    return scored.select("doc_id", F.coalesce(F.expr(f"{_remainder(4)} = 2"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=24)


QUERIES = {f.__name__: f for f in (op1_packing, op2_html_extraction, op3_class_lm, op4_decontamination, op5_quality, op6_host_rules, op7_url_filter, op8_substring_dedup, op9_jaccard_join, op10_sharding)}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '')"

SQL = {
    "op4_decontamination": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT DISTINCT item_id, least(5, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda p: array_to_string(w[p:p + least(5, len(w)) - 1], ' '))) AS g FROM i WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n FROM s GROUP BY item_id),
k AS (SELECT DISTINCT k FROM s),
e AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS g FROM d, k WHERE len(w) >= k),
m AS (SELECT doc_id, item_id, count(*) AS c FROM e JOIN s USING (k, g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n AS item_shingles, c AS shared_shingles FROM m JOIN n USING (item_id) WHERE c * 10 >= n * 8""",
    "op6_host_rules": rf"""
WITH w AS (SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS l FROM documents),
g AS (SELECT doc_id, list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' ')) AS g, w FROM w),
x AS (SELECT doc_id, unnest(g) AS h, generate_subscripts(g, 1) AS p FROM g WHERE len(g) > 1),
r AS (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, h) AS c FROM x) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT q) AS c FROM r GROUP BY doc_id),
f AS (SELECT doc_id, host, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
 (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines, coalesce(c, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
a AS (SELECT *, base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 3 * n_words OR word_chars > 10 * n_words AS failed FROM b),
h AS (SELECT host, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS k FROM a GROUP BY host),
m AS (SELECT avg(k / n) AS m, greatest(0.0, var_pop(k / n) - avg(k / n) * (1 - avg(k / n)) * avg(1 / n)) AS v FROM h),
p AS (SELECT m, CASE WHEN v = 0 THEN 10000.0 ELSE least(10000.0, greatest(2.0, m * (1 - m) / v - 1)) END AS w, least(0.5, m + greatest(2.0 * sqrt(v), 0.2)) AS top FROM m),
s AS (SELECT host, (k + m * w) / (n + w) AS r, n + w + 1 AS d, top FROM h, p),
j AS (SELECT host, r - 1.645 * sqrt(r * (1 - r) / d) <= top AS host_kept FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept FROM a JOIN j USING (host)""",
    "op8_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
m AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS first FROM s),
r AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM m WHERE first < doc_id),
c AS (SELECT doc_id, count(*) AS n, list(q) AS q FROM r GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, u.q, u.x FROM d LEFT JOIN c USING (doc_id) LEFT JOIN (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS q FROM d) u ON u.doc_id = d.doc_id)
SELECT k.doc_id, any_value(n_words)::BIGINT AS n_words, any_value(n_removed)::BIGINT AS n_removed, sha256(coalesce(string_agg(k.x, ' ' ORDER BY k.q) FILTER (WHERE k.x IS NOT NULL AND r.q IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN r ON r.doc_id = k.doc_id AND r.q = k.q GROUP BY k.doc_id""",
    "op9_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda p: array_to_string(w[p:p + 2], ' ')) END) AS s FROM d),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, n, unnest(s) AS g FROM s JOIN n USING (doc_id)),
o AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n - count(*) AS u, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n),
l AS MATERIALIZED (SELECT a, b FROM o WHERE 100 * i >= 90 * u UNION SELECT b, a FROM o WHERE 100 * i >= 90 * u),
c(node, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.node WHERE c.root < l.b)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(c.root) AS component_id FROM n JOIN c ON c.node = n.doc_id GROUP BY n.doc_id, n.n""",
}
