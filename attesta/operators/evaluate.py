"""Evaluation of predicted verdicts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(pairs: DataFrame, classes: list[str]) -> DataFrame:
    """real, predicted and n for all pairs of classes, with zeros: pairs(real, predicted)."""
    grid = pairs.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, classes))).alias("real")).select("real", F.explode(F.array(*map(F.lit, classes))).alias("predicted"))
    return grid.join(pairs.groupBy("real", "predicted").agg(F.count("*").alias("n")), ["real", "predicted"], "left").select("real", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def f1(pairs: DataFrame, classes: list[str]) -> DataFrame:
    """class and f1 = 2 tp / (2 tp + fp + fn), null where that is 0 / 0."""
    table = confusion(pairs, classes)
    sides = table.select(F.explode(F.array(F.struct(F.col("real").alias("class"), F.col("n").alias("a")), F.struct(F.col("predicted").alias("class"), F.col("n").alias("a")))).alias("x"), F.when(F.col("real") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"))
    return sides.groupBy("x.class").agg(F.try_divide(F.sum("tp").cast("double"), F.sum("x.a").cast("double")).alias("f1"))


def macro_f1(pairs: DataFrame, classes: list[str]) -> DataFrame:
    return f1(pairs, classes).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))


def false_approval_rate(pairs: DataFrame, approved: str) -> DataFrame:
    return pairs.agg(F.avg(F.when(F.col("real") != approved, (F.col("predicted") == approved).cast("double"))).alias("false_approval_rate"))


def _scores(cells: np.ndarray) -> np.ndarray:
    """Macro F1 of each confusion matrix of cells(..., real, predicted); classes without rows don't count, and with none at all it is 0."""
    hits, sides = np.diagonal(cells, axis1=-2, axis2=-1), cells.sum(-1) + cells.sum(-2)
    each = np.where(sides > 0, 2 * hits / np.maximum(sides, 1), np.nan)
    counted = np.isfinite(each)
    return np.where(counted.any(-1), np.nansum(each, -1) / np.maximum(counted.sum(-1), 1), 0.0)


def macro_f1_of(cells: np.ndarray) -> np.ndarray:
    return _scores(cells)


def false_approvals_of(approved: int) -> Callable[[np.ndarray], np.ndarray]:
    """The rate of false approvals of each matrix, nan where nothing is there to approve falsely."""

    def f(cells: np.ndarray) -> np.ndarray:
        rest = np.delete(cells, approved, axis=-2)
        total = rest.sum((-2, -1))
        return np.where(total > 0, rest[..., approved].sum(-1) / np.maximum(total, 1), np.nan)

    return f


def bootstrap(pairs: DataFrame, classes: list[str], metric: Callable[[np.ndarray], np.ndarray], repetitions: int = 1000, seed: int = 0) -> tuple[float, float] | None:
    """The 95% interval of a metric of the confusion matrix, by order statistics; None if it is never defined.

    Rows drawn with replacement change the metric only through the counts of their cells, which are multinomial. So only len(classes) ** 2 counts reach the driver, and the cost doesn't grow with the rows. The draws differ from those of a generator over rows; their law is the same."""
    at = {c: k for k, c in enumerate(classes)}
    cells = np.zeros((len(classes), len(classes)), np.int64)
    for r in confusion(pairs, classes).collect():  # one row for each pair of classes
        cells[at[r["real"]], at[r["predicted"]]] = r["n"]
    n = int(cells.sum())
    if not n:
        return None
    drawn = np.random.default_rng(seed).multinomial(n, cells.ravel() / n, repetitions).reshape(repetitions, *cells.shape)
    values = np.sort(metric(drawn))
    values = values[np.isfinite(values)]
    return (float(values[int(0.025 * (len(values) - 1))]), float(values[int(0.975 * (len(values) - 1))])) if len(values) else None


def paired_bootstrap(rows: DataFrame, repetitions: int = 1000, seed: int = 0, classes: tuple[int, ...] = (0, 1)) -> tuple[float, float] | None:
    """The 95% interval (interpolated) of the difference of macro F1 between predicted a and b, both on the same draws of rows(real, a, b)."""
    counts = rows.where(F.col("real").isin(*classes) & F.col("a").isin(*classes) & F.col("b").isin(*classes)).groupBy("real", "a", "b").count().orderBy("real", "a", "b").collect()
    k, cells = len(classes), np.zeros((len(classes),) * 3, np.int64)
    for r in counts:
        cells[classes.index(r["real"]), classes.index(r["a"]), classes.index(r["b"])] = r["count"]
    n = int(cells.sum())
    if not n:
        return None
    drawn = np.random.default_rng(seed).multinomial(n, cells.ravel() / n, repetitions).reshape(repetitions, k, k, k)
    low, high = np.percentile(_scores(drawn.sum(3)) - _scores(drawn.sum(2)), [2.5, 97.5])
    return float(low), float(high)


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """N, brier and ece of rows(y, p), y 0 or 1 and p from 0 to 1; no rows, nulls."""
    binned = rows.where("y is not null and p is not null").groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(
        F.count("*").alias("n"), F.sum("y").cast("double").alias("y"), F.sum("p").alias("p"), F.sum((F.col("p") - F.col("y")) ** 2).alias("e"))
    return binned.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.try_divide(F.sum("e"), F.sum("n")).alias("brier"), F.try_divide(F.sum(F.abs(F.col("y") - F.col("p"))), F.sum("n")).alias("ece"))


def auc(rows: DataFrame) -> DataFrame:
    """The share of (positive, negative) pairs that p orders rightly, ties half; null without both. Equal p meet first, so the running count is over distinct p; it is summed by range of p and then within each, so that no task gets all."""
    by = rows.where("y is not null and p is not null").groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    by = by.withColumn("_r", F.floor(F.col("p") * 4096))
    sums = by.groupBy("_r").agg(F.sum("pos").alias("rp"), F.sum("neg").alias("rn"))
    before = sums.select("_r", (F.sum("rn").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))).alias("below"))  # at most 4097 rows
    inner = F.coalesce(F.sum("neg").over(Window.partitionBy("_r").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = by.withColumn("inner", inner).join(before, "_r")
    return won.agg(F.try_divide(F.sum(F.col("pos") * (F.coalesce("below", F.lit(0)) + F.col("inner") + F.col("neg") / 2)), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def binary_metrics(rows: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and f1 of label 1 for rows(y, predicted); precision is 0 where nothing is predicted."""
    both, said, real = F.sum(F.col("y") * F.col("predicted")), F.sum("predicted"), F.sum("y")
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return rows.agg(F.avg((F.col("y") == F.col("predicted")).cast("double")).alias("accuracy"), share(both, said).alias("precision"), share(both, real).alias("recall"), share(2 * both, said + real).alias("f1"))


def threshold_sweep(rows: DataFrame, low: int = 5, high: int = 95) -> DataFrame:
    """The threshold of `low` to `high` hundredths with the greatest macro F1 of p >= threshold, the least of equals.

    Rows are counted by the hundredths that p reaches before they meet the thresholds, so at most 101 groups do."""
    reach = F.least(F.greatest(F.floor(F.round(F.col("p") * 100, 9)), F.lit(-1)), F.lit(100)).cast("int")
    counts = rows.where("y is not null and p is not null").groupBy("y", reach.alias("reach")).agg(F.count("*").alias("n"))
    wide = counts.select("y", "n", "reach", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("t")).withColumn("predicted", (F.col("reach") >= F.col("t")).cast("int"))
    cell = lambda y, p: F.sum(F.when((F.col("y") == y) & (F.col("predicted") == p), F.col("n")).otherwise(0))
    m = wide.groupBy("t").agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))
    one = F.try_divide(2.0 * F.col("tp"), (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double"))
    zero = F.try_divide(2.0 * F.col("tn"), (2 * F.col("tn") + F.col("fp") + F.col("fn")).cast("double"))
    mean = F.coalesce((one + zero) / 2, one, zero)
    return m.select((F.col("t") / 100).alias("threshold"), F.round(mean, 12).alias("macro_f1")).orderBy(F.desc("macro_f1"), "threshold").limit(1)
