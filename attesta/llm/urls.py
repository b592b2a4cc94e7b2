"""URL filter: explicit host and path rules, and gradient-boosted trees on lexical features for the rest (DataFrame functions and JVM trees only).

The labelled URLs are those that a rule decides; the label rates of suffixes, domains and folders come from all of them. A URL that the trees are fitted on gets the rates of the other
FOLDS - 1 folds, so that no rate holds its own label. The trees are fitted on a bounded sample of different URLs and judge every URL without a rule."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.base import Scratch

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Different labelled URLs to fit the trees on, those with the least hashes; the bound of what one task and the driver see.
SAMPLE_ROWS = 8_000
TREES, DEPTH = 12, 4
#: Folds of URLs by hash; the weight of the overall rate in a key's rate.
FOLDS, PRIOR = 5, 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "path_length", "depth", "host_dots", "digit_ratio", "entropy", "params", "hyphens", "other_ratio", "has_fragment", "suffix_rate", "domain_rate", "folder_rate")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or a url without '://'."""
    u = F.coalesce(url, F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def lexical(df: DataFrame) -> DataFrame:
    """Adds to url, host and path what the trees see, and the keys of the suffix statistics."""
    u, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    n = F.length(u)
    count = lambda s, chars: F.length(s) - F.length(F.translate(s, chars, ""))
    over = lambda a: F.coalesce(F.try_divide(a, n), F.lit(0.0)).cast("double")
    chars = F.array_distinct(F.filter(F.split(u, ""), lambda c: c != ""))
    share = lambda c: (n - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.aggregate(chars, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return df.withColumns(
        {
            "length": n.cast("double"), "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"),
            "depth": count(path, "/").cast("double"), "host_dots": count(host, ".").cast("double"), "digit_ratio": over(count(u, "0123456789")),
            "entropy": entropy, "params": F.when(F.locate("?", u) > 0, count(u, "&=")).otherwise(0).cast("double"), "hyphens": count(u, "-_").cast("double"),
            "other_ratio": over(n - count(u, _UPPER + _LOWER + "0123456789/.:-_?&=#")), "has_fragment": (F.locate("#", u) > 0).cast("double"),
            "_suffix": F.substring_index(host, ".", -1), "_domain": F.substring_index(host, ".", -2), "_folder": F.regexp_extract(path, r"^/([^/]*)/", 1),
        }
    )


def fold_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(11)), F.lit(FOLDS)).cast("int")


class UrlModel:
    """Suffix statistics of all labelled rows, and trees fitted on at most `sample_rows` different labelled URLs; with one class of label or none there is no tree, and that class (or allow) is the verdict."""

    def __init__(self, scratch: Scratch, labelled: DataFrame, sample_rows: int = SAMPLE_ROWS):
        self.scratch, order = scratch, [F.xxhash64("url"), F.col("url")]
        sample = labelled.select("url", "host", "path", "blocked").distinct().orderBy(*order).limit(sample_rows)
        sample = scratch.cut(lexical(sample).withColumn("_fold", fold_of(F.col("url"))), "sample")
        seen = {r["blocked"] for r in sample.select("blocked").distinct().collect()}
        self.only = None if len(seen) == 2 else ("block" if 1.0 in seen else "allow")
        self.trees: GBTClassificationModel | None = None
        if self.only:
            return
        self.mean = labelled.agg(F.avg("blocked")).first()[0]
        keyed = lexical(labelled).withColumn("_fold", fold_of(F.col("url")))
        folds = {k: scratch.cut(keyed.groupBy(f"_{k}", "_fold").agg(F.sum("blocked").alias("_b"), F.count("*").alias("_n")), f"{k}_folds") for k in ("suffix", "domain", "folder")}
        whole = {k: x.groupBy(f"_{k}").agg(F.sum("_b").alias("_b"), F.sum("_n").alias("_n")) for k, x in folds.items()}
        self.rates = {k: scratch.cut(x.select(f"_{k}", self._rate(F.col("_b"), F.col("_n")).alias(f"{k}_rate")), k) for k, x in whole.items()}
        for k, x in folds.items():  # a fold's rate is that of all other rows of the key
            others = x.join(whole[k].withColumnsRenamed({"_b": "_tb", "_n": "_tn"}), f"_{k}").select(f"_{k}", "_fold", self._rate(F.col("_tb") - F.col("_b"), F.col("_tn") - F.col("_n")).alias(f"{k}_rate"))
            sample = sample.join(others, [f"_{k}", "_fold"])
        sample = scratch.cut(sample, "fitted")
        self.trees = GBTClassifier(labelCol="blocked", featuresCol="_x", maxIter=TREES, maxDepth=DEPTH, seed=7, checkpointInterval=-1).fit(self._assembled(sample).select("blocked", "_x").coalesce(1))

    def _rate(self, blocked: Column, n: Column) -> Column:
        return (blocked + PRIOR * self.mean) / (n + PRIOR)

    @staticmethod
    def _assembled(df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(df)

    def vectors(self, df: DataFrame) -> DataFrame:
        for k, rates in self.rates.items():
            df = df.join(rates, f"_{k}", "left").fillna({f"{k}_rate": self.mean})
        return self._assembled(df)

    def verdicts(self, df: DataFrame) -> DataFrame:
        """Adds block_score and model_verdict to rows with url, host and path."""
        if not self.trees:
            return df.withColumns({"block_score": F.lit(float(self.only == "block")), "model_verdict": F.lit(self.only)})
        out = self.trees.transform(self.vectors(lexical(df)))
        score = vector_to_array("probability")[1]
        return out.select(*df.columns, score.alias("block_score"), F.when(score >= 0.5, "block").otherwise("allow").alias("model_verdict"))


def _ruled(scratch: Scratch, pages: DataFrame, rules) -> DataFrame:
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path")).withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    return scratch.cut(rows.select("page_id", "url", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("ruled")), "rows")


def _labelled(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("ruled").isNotNull()).select("url", "host", "path", (F.col("ruled") == "block").cast("double").alias("blocked"))


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score (null where a rule decides) for every row of pages(page_id, url).

    Null or malformed urls have empty host and path and get the trees' verdict. Repeated rows are judged alike and all returned. No rows in, no rows out. Other columns are ignored."""
    scratch = Scratch(pages.sparkSession, "urls")
    rows = _ruled(scratch, pages, rules)
    out = UrlModel(scratch, _labelled(rows)).verdicts(rows)
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "model_verdict").alias("verdict"), F.when(F.col("ruled").isNull(), F.col("block_score")).alias("block_score"))


def held_out(pages: DataFrame, fold: int = 0, rules=RULES) -> tuple[int, int]:
    """How many labelled URLs of one fold there are, and for how many of them a model of the other folds gives the rule's verdict."""
    scratch = Scratch(pages.sparkSession, "urls")
    labelled = _labelled(_ruled(scratch, pages, rules)).distinct()
    out = UrlModel(scratch, labelled.where(fold_of(F.col("url")) != fold)).verdicts(labelled.where(fold_of(F.col("url")) == fold))
    n, right = out.agg(F.count("*"), F.sum(((F.col("blocked") == 1) == (F.col("model_verdict") == "block")).cast("long"))).first()
    return n, right or 0
