"""Queries of the verifier, extraction, sources, evaluation and report over the driver's tables, added to the registry.

The tables hold no text of the language that the rules read, so claims, windows, feeds and articles are made from whole tables by templates, with every rule in turn; the SQL states what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import periods as P
from attesta.functions.verifier import MONTHS
from attesta.operators import evaluate, report, textual
from attesta.plans.registry import _WORDS, query
from attesta.sources import feeds, pages
from attesta.sources.store import table

_MONTH_LIST = "[" + ", ".join(f"'{m}'" for m in MONTHS) + "]"
_ORDERS = f"""o AS (SELECT o_orderkey AS claim_id, o_orderkey % 5 AS k, {_MONTH_LIST}[month(o_orderdate)] AS mon, year(o_orderdate) AS y, strftime(o_orderdate, '%m') AS mm, 'Loja L' || (o_custkey % 50) AS shop, o_orderkey % 90 + 10 AS v FROM orders),
c AS (SELECT *, 'Em ' || mon || ' de ' || y || ', a ' || shop || ' registrou ' || v || ' mil peças, ante ' || mon || ' de ' || (y - 1) || '.' AS claim FROM o)"""


def _sale(shop: Column, month: Column, year: Column, value: Column) -> Column:
    return F.concat(F.lit("Em "), month, F.lit(" de "), year, F.lit(", a "), shop, F.lit(" registrou "), value, F.lit(" mil peças, ante "), month, F.lit(" de "), year - 1, F.lit("."))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim and a window for each order; k tells what differs: 0 nothing, 1 the name, 2 the year, 3 the number, 4 the document's period."""
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    month, year, value = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day)), F.year(day), F.col("o_orderkey") % 90 + 10
    shop = F.concat(F.lit("Loja L"), F.col("o_custkey") % 50)
    other = F.concat(F.lit("Loja M"), F.col("o_custkey") % 50)
    bare = F.concat(F.lit("A "), shop, F.lit(" registrou "), value, F.lit(" mil peças."))
    window = F.when(k == 4, bare).otherwise(_sale(F.when(k == 1, other).otherwise(shop), month, year + (k == 2).cast("int"), value + (k == 3).cast("int")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), k.alias("k"), _sale(shop, month, year, value).alias("claim"), window.alias("window"), F.when(k == 4, F.concat(year + 1, F.lit("-"), F.date_format(day, "MM"))).alias("doc_period"), shop.alias("shop"))


@query(f"""WITH {_ORDERS} SELECT claim_id, CASE k WHEN 1 THEN 'entidade ausente: ' || shop WHEN 2 THEN 'período divergente' WHEN 3 THEN 'número sem correspondente: ' || v || '000' WHEN 4 THEN 'período divergente (documento de ' || (y + 1) || '-' || mm || ')' END AS entailment, k IN (1, 2, 4) AS both FROM c""")
def verifier_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules block for each claim and window."""
    pairs = _claims(spark, sf_dir).withColumns({"document": F.col("window"), "title": F.lit(""), "domain": F.lit("")})
    b = F.col("blocks")
    return textual.blocked(pairs).select("claim_id", F.try_element_at(b, F.lit("entailment")).alias("entailment"), F.try_element_at(b, F.lit("contradiction")).isNotNull().alias("both"))


@query(f"WITH {_ORDERS} SELECT CASE k WHEN 1 THEN 'entidade ausente' WHEN 2 THEN 'período divergente' WHEN 3 THEN 'número sem correspondente' ELSE 'período divergente (documento de ' || (y + 1) || '-' || mm || ')' END AS kinds, count(*) AS n FROM c WHERE k > 0 GROUP BY 1")
def blocked_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of reasons over all claims."""
    pairs = _claims(spark, sf_dir).withColumns({"document": F.col("window"), "title": F.lit(""), "domain": F.lit("")})
    return report.blocked_note(textual.blocked(pairs)).groupBy("kinds").agg(F.count("*").alias("n"))


@query(f"WITH {_ORDERS} SELECT claim_id, y || '-' || mm AS months, k = 2 AS diverges, k = 4 AS document_diverges FROM c")
def period_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods without comparisons, and whether window and document are about others."""
    rows = _claims(spark, sf_dir).withColumns({"a": P.periods(P.without_comparisons(F.col("claim"))), "b": P.periods(P.without_comparisons(F.col("window"))), "d": P.of_reference(F.col("doc_period"))})
    return rows.select("claim_id", F.array_join("a.month", " ").alias("months"), P.diverges(F.col("a"), F.col("b")).alias("diverges"), F.coalesce(P.document_diverges(F.col("a"), F.col("d")), F.lit(False)).alias("document_diverges"))


@query(r"WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\b20\d{2}/\d{2}\b'))), ' ') AS cycles, array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(t, '\b20\d{2}/\d{2}\b', ' # ', 'g'), '\b(?:19|20)\d{2}\b'))), ' ') AS years FROM t")
def period_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: cycles and lone years of every document."""
    p = P.periods(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(p["cycle"], " ").alias("cycles"), F.array_join(p["year"], " ").alias("years"))


@query(f"WITH {_ORDERS} SELECT claim_id, shop AS names, (v * 1000)::DOUBLE AS value, y || '-' || mm AS months FROM c")
def claim_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and quantities of every claim."""
    rows = textual.measured(textual.named(_claims(spark, sf_dir).select("claim_id", F.col("claim").alias("text"))))
    q = F.explode_outer("quantities")
    return rows.select("claim_id", F.array_join("names", "|").alias("names"), q.alias("q")).select("claim_id", "names", F.col("q.value").alias("value"), F.array_join("q.months", " ").alias("months"))


@query(f"WITH {_ORDERS} SELECT claim_id AS article_id, 1::BIGINT AS rank, claim, 1::BIGINT AS pos, 5::BIGINT AS score, 'número|período|nome próprio|verbo de fato' AS signals, '' AS alerts FROM c")
def claim_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims of articles with one fact and one opinion each."""
    text = F.concat(F.col("claim"), F.lit(" Foi um absurdo total para todos os seus vizinhos!"))
    got = textual.candidates(_claims(spark, sf_dir).select(F.col("claim_id").alias("article_id"), F.lit("").alias("title"), text.alias("text"), F.lit("1999-01-01").alias("date")))
    long = lambda c: F.col(c).cast("long").alias(c)
    return got.select("article_id", long("rank"), "claim", long("pos"), long("score"), F.array_join("signals", "|").alias("signals"), F.array_join("alerts", "|").alias("alerts"))


@query(f"WITH o AS (SELECT o_orderkey, {_MONTH_LIST}[month(o_orderdate)] AS mon, month(o_orderdate) AS m FROM orders) SELECT o_orderkey, 'Vendas sobem em ' || mon || ' de ' || CASE WHEN m <= 6 THEN 1997 ELSE 1996 END AS premise, CASE WHEN m <= 6 THEN 1997 ELSE 1996 END || '-' || lpad(m::VARCHAR, 2, '0') AS ref_period FROM o")
def reference_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years after bare months, and the period that a title is about, published in June 1997."""
    title = F.concat(F.lit("Vendas sobem em "), F.element_at(F.array(*map(F.lit, MONTHS)), F.month("o_orderdate")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", title.alias("title"), title.alias("window"), F.lit("1997-06-30").alias("published"))
    return textual.reference_periods(textual.with_years(rows)).select("o_orderkey", "premise", "ref_period")


@query()
def overlapping_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every document, as digests."""
    return textual.chunked(table(spark, sf_dir, "documents")).select("doc_id", "pos", F.md5("text").alias("chunk_md5"), F.size(F.split("text", " ")).alias("n_words"))


@query()
def provided_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every turn of a conversation, taken as provided text."""
    docs = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text")
    return textual.provided_pieces(docs).select("doc_id", "pos", F.md5("text").alias("piece_md5"))


@query()
def page_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, date, text and error of every page."""
    return pages.read_pages(table(spark, sf_dir, "pages")).select("page_id", "page.title", "page.date", F.md5("page.text").alias("text_md5"), "page.error")


_TURNS = f"t AS (SELECT conv_id, turn, list_distinct({_WORDS}) AS w FROM conversations), p AS (SELECT a.conv_id, a.turn, a.w AS a, b.w AS b FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return rows.join(rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next")), ["conv_id", "turn"])


@query(f"""WITH {_TURNS}, n AS (SELECT *, len(list_intersect(a, b)) AS i, len(a) AS na, len(b) AS nb FROM p)
SELECT conv_id, turn, round(CASE WHEN na + nb - i > 0 THEN i / (na + nb - i)::DOUBLE ELSE 0.0 END, 9) AS jaccard, round(CASE WHEN na > 0 THEN i / na::DOUBLE ELSE 0.0 END, 9) AS coverage, round(na / greatest(nb, 1)::DOUBLE, 9) AS length_ratio FROM n""")
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: features of every turn and the next."""
    f = P.text_features(F.col("text"), F.col("next"))
    return _turns(spark, sf_dir).select("conv_id", "turn", *(F.round(f[c], 9).alias(c) for c in ("jaccard", "coverage", "length_ratio")))


@query()
def text_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1: word F1, ROUGE-L and coverage of every turn and the next."""
    got = textual.overlaps(_turns(spark, sf_dir).select("conv_id", "turn", F.col("text").alias("candidate"), F.col("next").alias("reference")))
    return got.select("conv_id", "turn", *(F.round(f"overlap.{c}", 9).alias(c) for c in ("word_f1", "rouge_l", "coverage")))


_JSON = "{\"claims\":[{\"text\":\"c%d\",\"claimReview\":[{\"url\":\"https://Site%d.org/a\",\"textualRating\":\"Falso\",\"reviewDate\":\"1996-02-03T10:00:00Z\",\"publisher\":{\"name\":\"\",\"site\":\"%s\"}},{\"url\":\"https://Site%d.org/a\",\"textualRating\":\"Outro\"},{\"url\":\"ftp://x\"}]}]}"


@query("SELECT o_orderkey AS answer_id, 'c' || o_orderkey AS claim, 'https://Site' || (o_custkey % 7) || '.org/a' AS url, CASE WHEN o_custkey % 2 = 0 THEN 'agency' ELSE 'site' || (o_custkey % 7) || '.org' END AS agency, '1996-02-03' AS date, 'Falso' AS verdict_original FROM orders")
def fact_check_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of nested answers, the first of equals."""
    site = F.col("o_custkey") % 7
    json = F.format_string(_JSON, "o_orderkey", site, F.when(F.col("o_custkey") % 2 == 0, "agency").otherwise(""), site)
    return feeds.fact_checks(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("answer_id"), json.alias("json")))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 3 AS k FROM orders), u AS (SELECT o_orderkey, unnest(CASE WHEN k = 0 THEN ['https://a.org/' || o_orderkey, 'https://b.org/x'] ELSE ['https://a.org/' || o_orderkey, 'https://b.org/x', 'https://c.org/y'] END) AS url FROM o)
SELECT o_orderkey AS answer_id, CASE substr(url, 9, 1) WHEN 'a' THEN 1 WHEN 'b' THEN 2 ELSE 3 END::BIGINT AS source_ord, url FROM u""")
def merged_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of two services, each URL once, in order."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("answer_id"), (F.col("o_orderkey") % 3).alias("k"))
    item = "<item><link>https://news.example/r?url=%s&amp;n=1</link></item>"
    xml = F.format_string(f"<rss><channel>{item % 'https%%3A%%2F%%2Fa.org%%2F%d'}{item % 'https%%3A%%2F%%2Fb.org%%2Fx'}</channel></rss>", "answer_id")
    json = F.format_string('{"articles":[{"url":"https://b.org/x"}%s]}', F.when(F.col("k") == 0, "").otherwise(',{"url":"https://c.org/y"}'))
    links = feeds.merged_links([feeds.rss_links(orders.select("answer_id", xml.alias("xml"))), feeds.article_links(orders.select("answer_id", json.alias("json")))])
    return links.select("answer_id", F.col("source_ord").cast("long").alias("source_ord"), "url")


_PROBS = "x AS (SELECT label % 2 AS y, least(greatest(0.5 + 2 * embedding[1]::DOUBLE, 0.0), 1.0) AS p FROM embeddings)"


def _probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.least(F.greatest(0.5 + 2 * F.col("embedding")[0].cast("double"), F.lit(0.0)), F.lit(1.0))
    return table(spark, sf_dir, "embeddings").select((F.col("label") % 2).alias("y"), p.alias("p"))


@query(f"""WITH {_PROBS}, b AS (SELECT least(floor(p * 10), 9) AS b, sum(y) AS y, sum(p) AS p, count(*) AS n, sum((p - y) ** 2) AS e FROM x GROUP BY 1)
SELECT sum(n)::BIGINT AS n, round(sum(e) / sum(n), 9) AS brier, round(sum(abs(y - p)) / sum(n), 9) AS ece FROM b""")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier score and calibration error."""
    return evaluate.calibration(_probs(spark, sf_dir)).select("n", F.round("brier", 9).alias("brier"), F.round("ece", 9).alias("ece"))


@query(f"""WITH {_PROBS}, g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM x GROUP BY p), w AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT round(sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg))::DOUBLE, 9) AS auc FROM w""")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the curve."""
    return evaluate.auc(_probs(spark, sf_dir)).select(F.round("auc", 9).alias("auc"))


@query(f"""WITH {_PROBS}, c AS (SELECT y, floor(round(p * 100, 9)) AS r FROM x), g AS (SELECT t, count(*) FILTER (y = 1 AND r >= t) AS tp, count(*) FILTER (y = 0 AND r >= t) AS fp, count(*) FILTER (y = 1 AND r < t) AS fn, count(*) FILTER (y = 0 AND r < t) AS tn FROM c, range(5, 96) s(t) GROUP BY t)
SELECT t / 100.0::DOUBLE AS threshold, round((2.0::DOUBLE * tp / (2 * tp + fp + fn) + 2.0::DOUBLE * tn / (2 * tn + fp + fn)) / 2, 9) AS macro_f1 FROM g ORDER BY macro_f1 DESC, t LIMIT 1""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold with the greatest macro F1."""
    return evaluate.threshold_sweep(_probs(spark, sf_dir)).select("threshold", F.round("macro_f1", 9).alias("macro_f1"))


@query("WITH p AS (SELECT quality AS y, toxic AS p FROM labels) SELECT round(avg((y = p)::INT), 9) AS accuracy, round(coalesce(sum(y * p) / nullif(sum(p), 0)::DOUBLE, 0.0), 9) AS precision, round(coalesce(sum(y * p) / nullif(sum(y), 0)::DOUBLE, 0.0), 9) AS recall, round(coalesce(2 * sum(y * p) / nullif(sum(y) + sum(p), 0)::DOUBLE, 0.0), 9) AS f1 FROM p")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, precision, recall and F1."""
    got = evaluate.binary_metrics(table(spark, sf_dir, "labels").select(F.col("quality").alias("y"), F.col("toxic").alias("predicted")))
    return got.select(*(F.round(c, 9).alias(c) for c in got.columns))


@query("""WITH a AS (SELECT o_orderkey AS claim_id, CASE o_orderkey % 3 WHEN 0 THEN '1996-06-30' WHEN 1 THEN '' ELSE '30/06/1996' END AS d, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate::DATE END AS p FROM orders)
SELECT claim_id, (d LIKE '1996%' AND p > DATE '1996-06-30' AND p IS NOT NULL)::BIGINT AS removed, (d LIKE '1996%' AND p IS NULL)::BIGINT AS undated, d LIKE '30/%' AS noted FROM a""")
def cutoff_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sources the date of each article removes, are undated, and whether its date can't be read."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(key.alias("claim_id"), F.when(key % 3 == 0, "1996-06-30").when(key % 3 == 1, "").otherwise("30/06/1996").alias("article_date"), F.when(key % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("published"))
    return report.cutoff(rows.select("claim_id", "published"), rows.select("claim_id", "article_date"))[1].select("claim_id", "removed", "undated", F.col("note").isNotNull().alias("noted"))
