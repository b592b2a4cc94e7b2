"""Requests of an analysis or an extraction (O7, P14, E7): which are valid, and what is wrong with the others, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import iso_date
from attesta.operators import textual

# Bounds of a request, and the notes of an extraction.
TITLE, ARTICLE, EVIDENCE, CLAIM, URL = (1, 300), (0, 30_000), (1, 40_000), (10, 500), 2048
CLAIMS, EVIDENCES, ATTACHMENTS, MOST = (1, 10), (0, 20), (0, 20), (1, 10)
ORIGINS = ("link_publisher", "anexo")
UNCHECKED = "Afirmações propostas por regras, sem verificação: confirme, edite ou descarte cada uma antes de analisar."
NO_DATE = "Sem data da notícia no formato AAAA-MM-DD: as datas relativas e os meses sem ano não foram completados."
NO_TEXT = "A notícia veio sem texto: só o título foi considerado."
#: Scheme, then perhaps a user, a host (an address of version 6 in brackets), perhaps a port.
_URL = r"^(?i)https?://(?:[^/?#@]*@)?(\[[0-9a-fA-F:.]+\]|[^/?#:\[\]]+)(?::\d{0,5})?(?:[/?#]|$)"
_LABELS = r"^(?i)(?=.{1,253}$)[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)*$"


def _international(host: str | None) -> bool | None:
    """Whether a host with letters beyond ASCII has a valid form in ASCII."""
    if host is None:
        return None
    try:
        labels = host.encode("idna").decode().removesuffix(".").split(".")
    except UnicodeError:
        return False
    return sum(map(len, labels)) + len(labels) - 1 <= 253 and all(0 < len(x) <= 63 and x[0] != "-" != x[-1] and x.replace("-", "a").isalnum() for x in labels)


def with_url_validity(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds valid_url. An empty or null URL is valid; others need http or https, no white space and a host: an address, or labels of up to 63 letters, digits and inner hyphens, 253 in all. Hosts beyond ASCII are judged by their ASCII form, in Arrow batches; all others in the JVM."""
    text = F.btrim(F.coalesce(F.col(url), F.lit("")))
    host = F.regexp_extract(text, _URL, 1)
    plain = host.rlike(r"^[\x00-\x7F]*$")
    wide = textual.with_result(df.withColumn("_host", F.when(~plain, host)), "_valid", "boolean", _international, F.col("_host"))
    ascii_ok = host.rlike(r"^\[") | F.regexp_replace(host, r"\.$", "").rlike(_LABELS)
    return wide.withColumn("valid_url", (text == "") | ((F.length(text) <= URL) & ~text.rlike(r"\s") & F.coalesce("_valid", ascii_ok))).drop("_host", "_valid")


def _outside(n: Column, bounds: tuple[int, int]) -> Column:
    return ~F.coalesce(n, F.lit(0)).between(*bounds)


def checked(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O7 on requests(request_id, title, text, date, claims array, evidence array<struct<title,text,url,origin,published>>, attachments): the valid ones with claims trimmed, and request_id with its errors (codes, in order) of the others.

    Nulls count as empty lists, texts and zero; a null origin as `anexo`. Repeated ids are judged row by row."""
    trimmed = F.transform(F.coalesce("claims", F.array().cast("array<string>")), lambda c: F.btrim(F.coalesce(c, F.lit(""))))
    rows = requests.withColumns({"claims": trimmed, "_row": F.monotonically_increasing_id()})
    urls = with_url_validity(rows.select("_row", F.explode("evidence").alias("e")).select("_row", F.col("e.url").alias("url")))
    bad_urls = urls.groupBy("_row").agg(F.count_if(~F.col("valid_url")).alias("_bad"))
    e = F.coalesce(F.col("evidence"), F.array())
    any_ = lambda test: F.exists(e, lambda x: F.coalesce(test(x), F.lit(False)))
    length = lambda x: F.length(F.coalesce(x, F.lit("")))
    tests = {
        "title": _outside(F.length("title"), TITLE), "article": _outside(F.length("text"), ARTICLE), "claims": _outside(F.size("claims"), CLAIMS),
        "claim": F.exists("claims", lambda c: ~F.length(c).between(*CLAIM)), "evidences": _outside(F.size(e), EVIDENCES), "attachments": _outside(F.col("attachments"), ATTACHMENTS),
        "evidence_title": any_(lambda x: ~length(x["title"]).between(*TITLE)), "evidence_text": any_(lambda x: ~length(x["text"]).between(*EVIDENCE)),
        "evidence_origin": any_(lambda x: ~x["origin"].isin(*ORIGINS)), "evidence_url": F.coalesce(F.col("_bad"), F.lit(0)) > 0,
    }
    judged = rows.join(bad_urls, "_row", "left").withColumn("errors", F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))).drop("_row", "_bad")
    return judged.where(F.size("errors") == 0).drop("errors"), judged.where(F.size("errors") > 0).select("request_id", "errors")


def proposals(articles: DataFrame, config: str, most: int = MOST[1]) -> DataFrame:
    """For every row of articles(article_id, title, text, date) the candidate claims in order, notes and versions. A date that is no day completes nothing and is noted, as is an article without text."""
    if not MOST[0] <= most <= MOST[1]:
        raise ValueError(f"most must be from {MOST[0]} to {MOST[1]}")
    day = iso_date(F.btrim("date"))
    valid = F.when(F.length(F.btrim("date")) == 10, day)
    rows = articles.select("article_id", "title", "text", valid.cast("string").alias("date"))
    found = textual.candidates(rows, most)
    listed = found.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("rank", "claim", "source_sentence", "pos", "score", "signals", "alerts", "attribution"))).alias("claims"))  # at most `most`
    notes = F.array_compact(F.array(F.lit(UNCHECKED), F.when(F.col("date").isNull(), NO_DATE), F.when(F.btrim(F.coalesce("text", F.lit(""))) == "", NO_TEXT)))
    out = rows.withColumn("notes", notes).join(listed, "article_id", "left")
    return out.select("article_id", F.coalesce("claims", F.array().cast(listed.schema["claims"].dataType)).alias("claims"), "notes", F.struct(F.lit("1").alias("extraction"), F.lit(config).alias("config")).alias("versions"))
