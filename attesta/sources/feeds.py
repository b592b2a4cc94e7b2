"""Answers of search services and fact-check archives as rows (S4 to S7, S12, S13), in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.text import one_space

CLAIM_REVIEW = "struct<claims:array<struct<text:string,claimReview:array<struct<url:string,textualRating:string,reviewDate:string,publisher:struct<name:string,site:string>>>>>>"
ARTICLES, MOST_URLS, RESULTS = "struct<articles:array<struct<url:string>>>", 10, 8
VERDICTS = ("SUPPORTED", "REFUTED", "NOT_ENOUGH_EVIDENCE", "CONFLICTING_EVIDENCE")
LABELLED = "id string, pair string, claim string, evidence array<struct<text:string,source:string,date:string,url:string>>, label string, event string, date string, source string, rationale string"


def fact_checks(answers: DataFrame) -> DataFrame:
    """S7 on answers(answer_id, json): one row for each (url, claim) of an answer, the first of equals; only http(s) URLs. The agency is the publisher's name, else its site, else the URL's host. JSON that can't be read gives none."""
    got = answers.select("answer_id", F.from_json("json", CLAIM_REVIEW).alias("j")).select("answer_id", F.posexplode("j.claims").alias("i", "c"))
    got = got.select("answer_id", "i", F.coalesce("c.text", F.lit("")).alias("claim"), F.posexplode("c.claimReview").alias("k", "r"))
    url = F.coalesce("r.url", F.lit(""))
    got = got.select("answer_id", "i", "k", "claim", url.alias("url"), "r").where("url like 'http://%' or url like 'https://%'")
    first = F.row_number().over(Window.partitionBy("answer_id", "url", "claim").orderBy("i", "k"))
    got = got.withColumn("_first", first).where("_first = 1")
    agency = F.coalesce(F.nullif("r.publisher.name", F.lit("")), F.nullif("r.publisher.site", F.lit("")), F.lower(F.try_parse_url("url", F.lit("HOST"))), F.lit(""))
    return got.select("answer_id", "claim", "url", agency.alias("agency"), F.substring(F.nullif("r.reviewDate", F.lit("")), 1, 10).alias("date"), F.coalesce("r.textualRating", F.lit("")).alias("verdict_original"))


def rss_links(answers: DataFrame) -> DataFrame:
    """S5 on answers(answer_id, xml): the URLs that the first eight items of a feed point to, with their place."""
    links = F.slice(F.xpath("xml", F.lit("//item/link/text()")), 1, RESULTS)
    rows = answers.select("answer_id", F.posexplode(links).alias("pos", "link"))
    return rows.select("answer_id", "pos", F.try_url_decode(F.try_parse_url("link", F.lit("QUERY"), F.lit("url"))).alias("url")).where("url is not null")


def article_links(answers: DataFrame) -> DataFrame:
    """S4 on answers(answer_id, json): the URLs of a list of articles, with their place."""
    return answers.select("answer_id", F.posexplode(F.slice(F.from_json("json", ARTICLES)["articles"], 1, RESULTS)).alias("pos", "a")).select("answer_id", "pos", F.col("a.url").alias("url")).where("url is not null")


def merged_links(lists: list[DataFrame], most: int = MOST_URLS) -> DataFrame:
    """The lists one after another, the first of equal URLs of an answer, at most `most` of each."""
    rows = None
    for k, x in enumerate(lists):
        x = x.select("answer_id", F.lit(k).alias("engine"), "pos", "url")
        rows = x if rows is None else rows.unionByName(x)
    rows = rows.groupBy("answer_id", "url").agg(F.min(F.struct("engine", "pos")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("answer_id").orderBy("at.engine", "at.pos"))
    return rows.withColumn("source_ord", rank).where(F.col("source_ord") <= most).select("answer_id", "source_ord", "url")


def classified(checks: DataFrame, classes: DataFrame, origin: str) -> tuple[DataFrame, DataFrame]:
    """checks(id, class, class_origin) with the classes of classes(line, id, class), and an error for each line with an unknown class or id. Empty classes are passed over; of lines for one id the last holds."""
    stated = classes.withColumn("class", F.btrim(F.coalesce("class", F.lit("")))).where("class != ''")
    known = F.col("class").isin(*VERDICTS)
    last = stated.where(known).groupBy("id").agg(F.max_by("class", "line").alias("_new"))
    out = checks.join(last, "id", "left").withColumns({"class": F.coalesce("_new", "class"), "class_origin": F.when(F.col("_new").isNotNull(), origin).otherwise(F.col("class_origin"))}).drop("_new")
    bad = stated.where(~known).select("line", F.format_string("linha %d: classe desconhecida '%s'", "line", "class").alias("error"))
    lost = stated.where(known).join(checks.select("id").distinct(), "id", "left_anti").select("line", F.format_string("linha %d: checagem '%s' não existe na base", "line", F.col("id").cast("string")).alias("error"))
    return out, bad.unionByName(lost)


def query_terms(claim: Column) -> Column:
    """W10's fall-back: the first 90 characters, where a claim has no terms."""
    return F.substring(one_space(claim), 1, 90)


def labelled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid labelled items, and those with a missing key or an unknown label."""
    complete = F.lit(True)
    for name in ("claim", "evidence", "label", "event", "date", "source", "rationale"):
        complete = complete & F.col(name).isNotNull()
    good = F.coalesce(complete & F.col("label").isin(*VERDICTS), F.lit(False))
    return rows.where(good), rows.where(~good)
