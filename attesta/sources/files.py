"""Files as sources and sinks (S9 to S15, K8 to K11, T11, T12): rows of good input, and beside them a row for each error."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, StructType

from attesta.functions.similarity import without_repeats
from attesta.functions.text import one_space
from attesta.operators import textual
from attesta.sources import feeds

MOST_URLS = 100
DOCUMENT = "ord long, url string, reference string, domain string, title string, origin_type string, published string, text string"


def _plain(path: Column) -> Column:
    return F.url_decode(F.regexp_replace(path, "^file:(//)?", ""))


def text_files(spark: SparkSession, paths: list[str] | str, published: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A document for each file, by path, and (reference, error) for empty ones. The path is the reference, the file's stem the title."""
    if published is not None and spark.range(1).select(F.try_to_date(F.lit(published), "yyyy-MM-dd").isNull() | (F.length(F.lit(published)) != 10)).first()[0]:
        raise ValueError("the date must have the form YYYY-MM-DD")
    stem = F.regexp_replace(F.regexp_extract("reference", r"[^/]*$", 0), r"(?<=.)\.[^.]*$", "")
    files = spark.read.format("binaryFile").load(paths)
    text = F.btrim(F.decode("content", "utf-8"), F.lit(" \t\n\x0b\f\r"))
    rows = files.select(F.regexp_replace("path", "^file:(//)?", "").alias("reference"), text.alias("text")).withColumn("title", stem)
    good = rows.where("text != ''").select(
        F.xxhash64("reference").alias("ord"), F.lit("").alias("url"), "reference", F.concat(F.lit("documento:"), "reference").alias("domain"), "title", F.lit("texto_local").alias("origin_type"), F.lit(published).cast("string").alias("published"), "text",
    )
    empty = spark.createDataFrame([(x,) for x in _without_bytes(spark, paths)], "reference string")  # sources pass over files of no bytes
    return good, rows.where("text = ''").select("reference").unionByName(empty).withColumn("error", F.lit("arquivo vazio"))


def _without_bytes(spark: SparkSession, paths: list[str] | str) -> list[str]:
    """Files of length 0 among those that a curated list of paths names."""
    out = []
    for given in [paths] if isinstance(paths, str) else paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(given)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in system.globStatus(path) or ():
            for s in system.listStatus(found.getPath()):
                if s.isFile() and not s.getLen():
                    out.append(s.getPath().toUri().getPath())
    return out


def url_list(spark: SparkSession, path: str, most: int = MOST_URLS) -> DataFrame:
    """Ord and url of a list's lines without blanks, comments and repeats, in order. More than `most` are an error: a load is a curated list."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("ord", "line"))
    urls = lines.select("ord", F.btrim("line", F.lit(" \t﻿")).alias("url")).where("url != '' and url not like '#%'").groupBy("url").agg(F.min("ord").alias("ord"))
    n = urls.count()
    if n > most:
        raise ValueError(f"the file has {n} URLs; a load may have {most}")
    return urls.select("ord", "url").orderBy("ord")


def fact_check_file(spark: SparkSession, path: str) -> DataFrame:
    """The checks of files that hold an answer of a fact-check service each."""
    return feeds.fact_checks(spark.read.text(path, wholetext=True).select(_plain(F.col("_metadata.file_path")).alias("answer_id"), F.col("value").alias("json")))


def class_csv(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Line, id and class of a CSV file with `id` and the class's column, a leading byte-order mark allowed. Lines count records from 2, as the header is 1."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')  # one task, which reads in order
    rows = rows.toDF(*[c.lstrip("﻿").removeprefix("ï»¿") for c in rows.columns])
    return rows.select((F.monotonically_increasing_id() + 2).alias("line"), F.col("id").cast("string").alias("id"), F.col(f"`{column}`").alias("class"))


def labelled_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid labelled items, and the others."""
    return feeds.labelled(spark.read.schema(feeds.LABELLED).json(path))


def evidence_sources(items: DataFrame) -> DataFrame:
    """The sources of labelled items(id, evidence): one for each piece of evidence, provided and in order."""
    rows = items.select(F.col("id").alias("claim_id"), F.posexplode("evidence").alias("source_ord", "e"))
    return rows.select("claim_id", "source_ord", F.col("e.url").alias("url"), F.col("e.source").alias("title"), F.lower(F.coalesce(F.try_parse_url("e.url", F.lit("HOST")), "e.source")).alias("domain"), F.col("e.text").alias("text"), F.lit("anexo").alias("origin"), F.col("e.date").alias("published"))


def posts_csv(spark: SparkSession, path: str) -> DataFrame:
    """Post and reference of a CSV file with the columns `post` and `normalized claim`; posts without white space runs, a closing None and copies of their own head."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"').select(F.col("post").alias("_raw"), F.col("normalized claim").alias("reference"))
    return textual.with_result(rows, "post", "string", without_repeats, F.col("_raw")).select("post", "reference")


def labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Passage, claim and label (0 or 1) of a Parquet file of premises, hypotheses and judgments."""
    return spark.read.parquet(path).select(F.col("premise").alias("passage"), F.col("hypothesis").alias("claim"), F.col("entailment_judgment").cast("int").alias("label"))


def stratified(rows: DataFrame, label: str, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """N rows, as many of each label (fewer where a label has fewer), by the least hashes of `key` and the seed. Repeated rows count one by one. The draw is this engine's own: the reference's generator is not reproduced."""
    kinds = rows.select(label).distinct().count()
    order = Window.partitionBy(label).orderBy(F.xxhash64(*key, F.lit(seed)), *key)
    return rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n // max(1, kinds)).drop("_k")


def sentence_count(text: Column) -> Column:
    """Runs of other signs than full stops, each with what stops follow it."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^.!?]+[.!?]*"))


def tsv_text(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return one_space(F.coalesce(text, F.lit("")))


def _rounded(x: Column, kind: DataType, places: int) -> Column:
    if isinstance(kind, DoubleType | FloatType):
        return F.round(x, places)
    if isinstance(kind, ArrayType):
        return F.transform(x, lambda y: _rounded(y, kind.elementType, places))
    if isinstance(kind, StructType):
        return F.when(x.isNotNull(), F.struct(*[_rounded(x[f.name], f.dataType, places).alias(f.name) for f in kind.fields]))
    return x


def rounded_json(df: DataFrame, places: int = 6) -> DataFrame:
    """K9: each row as JSON, its floats at any depth of lists and structs rounded."""
    return df.select(F.to_json(F.struct(*[_rounded(F.col(f"`{f.name}`"), f.dataType, places).alias(f.name) for f in df.schema.fields])).alias("json"))


def write_predictions(predictions: DataFrame, path: str) -> None:
    """K8: a JSON object for each prediction, nulls included."""
    predictions.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_projection(points: DataFrame, path: str, vector: str = "vec") -> None:
    """Metadata as tab-separated text, and vectors as little-endian 32-bit floats beside their position, both in the order of `id`."""

    def packed(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.asarray(v, "<f4").tobytes() for v in b.column(1).to_pylist()], pa.binary())], ["id", "f32"])

    meta = [tsv_text(F.col(f"`{c}`").cast("string")).alias(c) for c in points.columns if c != vector]
    points.orderBy("id").select(*meta).write.option("sep", "\t").option("header", "true").csv(f"{path}/metadata")
    points.where(F.col(vector).isNotNull()).select("id", vector).mapInArrow(packed, "id long, f32 binary").orderBy("id").write.parquet(f"{path}/vectors")


def write_model(spark: SparkSession, model, facts: dict, path: str) -> None:
    """A fitted pipeline, and beside it what it was made from (features in order, threshold, hashes, metrics)."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(facts, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")
