"""Training and evaluation over labelled sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.text import one_space
from attesta.operators import analysis, evaluate, textual, verdict

# The grid of the regression's strength.
GRID, FOLDS = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0), 5


def model_features(pairs: DataFrame, profiles: dict[str, tuple[Callable, Callable]], prefixes: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Adds <profile>_similarity, _support, _neutral and _against for each profile (embed, nli) to pairs(passage, claim). prefixes: what a profile's embedding puts before a claim and a passage."""

    def one(embed: Callable, nli: Callable, ask: str, give: str) -> Callable:
        def f(passages: list, claims: list) -> list[dict]:
            a, b = embed([ask + (c or "") for c in claims]), embed([give + (p or "") for p in passages])
            p = nli([(x or "", y or "") for x, y in zip(passages, claims, strict=True)])
            return [{"s": float(sum(x * y for x, y in zip(u, v, strict=True))), "e": float(q[0]), "n": float(q[1]), "c": float(q[2])} for u, v, q in zip(a, b, p, strict=True)]

        return f

    out = pairs
    for name, (embed, nli) in profiles.items():
        ask, give = (prefixes or {}).get(name, ("", ""))
        out = textual.with_result(out, "_f", "struct<s:double,e:double,n:double,c:double>", one(embed, nli, ask, give), F.col("passage"), F.col("claim"), batched=True)
        out = out.withColumns({f"{name}_{k}": F.col(f"_f.{x}") for k, x in (("similarity", "s"), ("support", "e"), ("neutral", "n"), ("against", "c"))}).drop("_f")
    return out


def fold_of(group: Column, folds: int = FOLDS, seed: int = 42) -> Column:
    """All rows of a group in one fold."""
    return F.pmod(F.xxhash64(group, F.lit(seed)), F.lit(folds)).cast("int")


def fit_logistic(rows: DataFrame, features: list[str], group: str, grid: tuple[float, ...] = GRID, folds: int = FOLDS) -> tuple[PipelineModel, DataFrame]:
    """M7: standardised features and a logistic regression on rows(label, <features>, <group>), its strength chosen by mean macro F1 over folds that keep a group's rows together; of equal ones the least. Returns the model of all rows, and strength and macro_f1 of the grid.

    C of the grid is the inverse of n times Spark's regParam, as Spark's loss is a mean. Folds hash groups and are not stratified by label, unlike the reference's."""
    spark, numbered = rows.sparkSession, rows.withColumn("_fold", fold_of(F.col(group), folds)).withColumn("label", F.col("label").cast("double"))
    n = rows.count()

    def pipeline(c: float) -> Pipeline:
        return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True), LogisticRegression(featuresCol="_z", labelCol="label", regParam=1 / (c * max(1, n)), standardization=False, maxIter=200)])

    scores = []
    for c in grid:
        predicted = None
        for k in range(folds):
            train, test = numbered.where(F.col("_fold") != k), numbered.where(F.col("_fold") == k)
            if train.select("label").distinct().count() < 2 or test.isEmpty():
                continue
            out = pipeline(c).fit(train).transform(test).select(F.lit(k).alias("fold"), F.col("label").cast("int").cast("string").alias("real"), F.col("prediction").cast("int").cast("string").alias("predicted"))
            predicted = out if predicted is None else predicted.unionByName(out)
        per_fold = [evaluate.macro_f1(predicted.where(F.col("fold") == k).drop("fold"), ["0", "1"]).first()[0] for k in range(folds)] if predicted is not None else []
        kept = [x for x in per_fold if x is not None]
        scores.append((c, sum(kept) / len(kept) if kept else 0.0))
    best = max(scores, key=lambda s: (round(s[1], 12), -s[0]))[0]
    return pipeline(best).fit(numbered), spark.createDataFrame(scores, "strength double, macro_f1 double")


def probabilities(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds p, the probability of label 1."""
    return model.transform(rows.withColumn("label", F.col("label").cast("double"))).select(*rows.columns, vector_to_array("probability")[1].alias("p"))


def nli_decision(support: Column, neutral: Column, against: Column) -> Column:
    """M8: 1 where support is the likeliest relation, ties included."""
    return (support >= F.greatest(neutral, against)).cast("int")


def rule_decision(similarity: Column, support: Column) -> Column:
    """M8: 1 where both thresholds of the verdict are met."""
    return ((similarity >= verdict.SIM_STRONG) & (support >= verdict.NLI_STRONG)).cast("int")


def leakage(parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """For each two parts in the order given, how many distinct values of `keys` (nulls are a value) are in both."""
    names, out = list(parts), None
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            n = parts[a].select(*keys).intersect(parts[b].select(*keys)).agg(F.count("*").alias("shared")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "shared")
            out = n if out is None else out.unionByName(n)
    return out


def seen_in(rows: DataFrame, train: DataFrame, column: str) -> DataFrame:
    """Adds seen, whether the training part has the text but for case and white space. Null texts count as empty."""
    key = lambda c: one_space(F.lower(F.coalesce(F.col(c), F.lit(""))))
    known = train.select(key(column).alias("_key")).distinct().withColumn("seen", F.lit(True))
    return rows.withColumn("_key", key(column)).join(known, "_key", "left").drop("_key").withColumn("seen", F.coalesce("seen", F.lit(False)))


def worst_errors(rows: DataFrame, most: int = 5) -> DataFrame:
    """W9 on rows(id, label, predicted, p): the surest false approvals and the surest missed ones, with kind and rank; ties by id."""
    wrong = rows.where("label != predicted").withColumn("kind", F.when(F.col("predicted") == 1, "false_approval").otherwise("missed"))
    sure = F.when(F.col("kind") == "false_approval", -F.col("p")).otherwise(F.col("p"))
    return wrong.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(sure, "id"))).where(F.col("rank") <= most).select("kind", "rank", "id", "p")


def extraction_summary(rows: DataFrame) -> DataFrame:
    """A15 on rows(post_id, system, seen, word_f1, rouge_l, coverage): n and means of each system over all posts, the unseen and the seen ones."""
    slices = F.explode(F.array(F.lit("all"), F.when(F.col("seen"), "seen").otherwise("unseen")))
    return rows.select("*", slices.alias("slice")).groupBy("slice", "system").agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in ("word_f1", "rouge_l", "coverage")])


def candidate_counts(candidates: DataFrame, posts: DataFrame) -> DataFrame:
    """Posts, how many have no candidate, and the median and greatest number of candidates of a post."""
    n = posts.select("post_id").join(candidates.groupBy("post_id").agg(F.count("*").alias("n")), "post_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return n.agg(F.count("*").alias("posts"), F.count_if(F.col("n") == 0).alias("without"), F.median("n").alias("median"), F.max("n").alias("most"))


def metrics(pairs: DataFrame, classes: list[str], approved: str) -> dict[str, DataFrame]:
    """The confusion matrix, F1 by class, macro F1 and the rate of false approvals of pairs(real, predicted)."""
    return {"confusion": evaluate.confusion(pairs, classes), "f1": evaluate.f1(pairs, classes), "macro_f1": evaluate.macro_f1(pairs, classes), "false_approvals": evaluate.false_approval_rate(pairs, approved)}


def predict_set(items: DataFrame, sources: DataFrame, embed: Callable, nli: Callable, verify: bool = True) -> DataFrame:
    """Id, real label, predicted and the greatest similarity of every row of items(claim_id, claim, label), by the whole analysis of its sources."""
    kept = verdict.consolidate(analysis.score(items.select("claim_id", "claim"), analysis.independence_groups(sources), embed, nli, verify))
    found = verdict.verdicts(items.select("claim_id"), kept.select("claim_id", "grp", "relation", "similarity", F.greatest("p_ent", "p_neu", "p_con").alias("nli")))
    most = kept.groupBy("claim_id").agg(F.max("similarity").alias("max_similarity"))
    return items.join(found, "claim_id").join(most, "claim_id", "left").select("claim_id", F.col("label").alias("real"), F.col("verdict").alias("predicted"), "max_similarity")
