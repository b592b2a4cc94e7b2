"""Quality rules judged by host (DataFrame functions only).

Each document gets base figures and fails if one of the rules does: the base rules, symbols, repeated lines, mean word length. Failures are summed by host, each host's rate is shrunk by a beta
prior fitted to all hosts by moments, less the noise of finite counts, and a host is rejected if its rate is surely above a limit taken from the prior. The verdict is joined back to the documents.
Sums are made before the shuffle, so a host with a third of all rows is a few rows per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.base import SPACES, Scratch

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Further rules, which count for the host alone: symbols a word, repeated lines, mean characters of a word.
MAX_SYMBOLS_PERCENT, MAX_DUP_LINES_PERCENT, WORD_CHARS = 10, 30, (3, 10)
#: The limit of a host's rate is SPREADS standard deviations of the prior above its mean, or MARGIN if that is more, but never above MAX_RATE.
SPREADS, MARGIN, MAX_RATE = 2.0, 0.2, 0.5
#: So many standard deviations of a host's own rate must lie above the limit (95 %).
SURE = 1.645
#: What the prior may weigh, in documents.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 10_000.0
#: Hosts up to this number are broadcast; more are joined by shuffle with the host's rows salted.
BROADCAST_HOSTS, SALTS = 20_000, 32


def _has_word(line: Column) -> Column:
    return F.translate(line, SPACES, "") != ""


def base_figures(docs: DataFrame, extra: list[str]) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and _failed (a base rule or another one) to the columns in `extra`.

    Windows are compared by 64-bit hashes within one document. Null texts have no words. Hot paths: a document in which no window repeats needs one pass with a hash set; only others are sorted."""
    t = F.col("_t")
    d = docs.select(*extra, F.coalesce("text", F.lit("")).alias("_t"))
    d = d.select(
        *extra,
        F.when(_has_word(t), F.split(F.btrim(t, F.lit(SPACES)), "[ \\t-\\r]+")).otherwise(F.array().cast("array<string>")).alias("_w"),
        F.char_length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(t, "\n"), _has_word).alias("_l"),
    )
    w = F.col("_w")
    window = lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)])
    d = d.select(
        *extra, "word_chars", "n_symbols",
        F.size(w).cast("long").alias("n_words"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), F.size("_l").cast("long").alias("_lines"),
        F.when(F.size(w) > WINDOW, F.transform(F.slice(w, F.lit(1), F.size(w) - (WINDOW - 1)), window)).alias("_g"),
    )
    g = F.col("_g")
    d = d.withColumn("_p", F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_g")
    p = F.col("_p")
    same = lambda x, k: F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))
    d = d.withColumn("_s", F.sort_array(F.transform(F.filter(p, lambda x, k: same(x, k + 1) | same(x, k - 1)), lambda x: x["i"]))).drop("_p")
    covered = F.aggregate("_s", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, s: F.struct((s + WINDOW).alias("end"), (a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - s)).alias("n")))
    d = d.withColumn("n_repeat_words", F.coalesce(covered["n"], F.lit(0)).cast("long")).drop("_s")
    n = F.col("n_words")
    d = d.withColumn("base_failed", (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n))
    more = (100 * F.col("n_symbols") > MAX_SYMBOLS_PERCENT * n) | (100 * F.col("n_dup_lines") > MAX_DUP_LINES_PERCENT * F.col("_lines")) | ~F.col("word_chars").between(WORD_CHARS[0] * n, WORD_CHARS[1] * n)
    return d.withColumn("_failed", F.col("base_failed") | more).drop("_lines")


def host_verdicts(scratch: Scratch, figures: DataFrame) -> DataFrame:
    """One row for each _host: the shrunk rate of failures and whether the host is kept.

    The prior beta has the mean m of the hosts' own rates and their variance v less the noise m (1 - m) / n of n documents; its weight is m (1 - m) / v - 1, within bounds (the greatest where v is 0 or less). Its
    numbers are read by the driver."""
    hosts = scratch.cut(figures.groupBy("_host").agg(F.count("*").alias("n"), F.sum(F.col("_failed").cast("long")).alias("f")), "hosts")
    rate = F.col("f") / F.col("n")
    mean, variance, inverse = hosts.agg(F.avg(rate), F.var_pop(rate), F.avg(1 / F.col("n"))).first()
    mean = mean or 0.0
    v = max(0.0, (variance or 0.0) - mean * (1 - mean) * (inverse or 0.0))
    weight = min(MOST_WEIGHT, max(LEAST_WEIGHT, mean * (1 - mean) / v - 1)) if v else MOST_WEIGHT
    limit = min(MAX_RATE, mean + max(SPREADS * v**0.5, MARGIN))
    shrunk = (F.col("f") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    rated = hosts.select("_host", shrunk.alias("host_rate"), F.sqrt(shrunk * (1 - shrunk) / (F.col("n") + F.lit(weight + 1))).alias("sd"))
    return rated.select("_host", "host_rate", (F.col("host_rate") - SURE * F.col("sd") <= limit).alias("_host_kept"))


def judge(scratch: Scratch, figures: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """Joins the hosts' verdicts to rows with _host, base_failed and _failed; adds host_rate and kept. More than `broadcast_hosts` hosts meet the rows by shuffle, each in SALTS places."""
    hosts = scratch.cut(host_verdicts(scratch, figures), "verdicts")
    if hosts.count() <= broadcast_hosts:
        joined = figures.join(F.broadcast(hosts), "_host", "left")
    else:
        salted = hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = figures.withColumn("_salt", F.pmod(F.xxhash64("n_words", "word_chars", "n_symbols"), F.lit(SALTS)).cast("int")).join(salted, ["_host", "_salt"], "left").drop("_salt")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("_host_kept")).drop("_host_kept", "_failed")


def quality_rules(docs: DataFrame, host: str = "source", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """doc_id, the base figures, host_rate and kept for every row of docs(doc_id, text, <host>).

    Null or empty text: no words, so base_failed. Null host: a host of its own. Repeated rows are judged one by one and all returned. No rows in, no rows out. Other columns are ignored."""
    scratch = Scratch(docs.sparkSession, "rules")
    figures = scratch.cut(base_figures(docs.select("doc_id", "text", F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("_host")), ["doc_id", "_host"]), "figures")
    return judge(scratch, figures, broadcast_hosts).drop("_host")


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns. Rows and their figures are written together once, so that no join on an id is needed."""
    scratch = Scratch(docs.sparkSession, "rules")
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "text", F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("_host"))
    figures = scratch.cut(base_figures(rows, ["_row", "_host"]), "figures")
    return judge(scratch, figures).where("kept").select("_row.*")
