"""Reading tables, cutting lineage through the shared folder, and small Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.sources.store import checkpoint_dir, ship, table  # noqa: F401

#: Space and \t to \r: what separates words in every contract of this package.
SPACES = " \t\n\x0b\f\r"
#: Rows in one Arrow batch; documents may be long, so Spark's default of 10,000 is too many.
BATCH_ROWS = 1000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """Before Python runs on executors: sends them the code, and bounds a worker's memory by the rows that it holds at once."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


_stages: list[list[Scratch]] = []


@contextmanager
def stage() -> Iterator[None]:
    """Deletes, at its end, the tables of all runs that began within: for a caller that has written the result by then."""
    _stages.append([])
    try:
        yield
    finally:
        for scratch in _stages.pop():
            scratch.drop()


class Scratch:
    """Tables of one run in the shared folder. What cut() returns reads files, so a lost executor costs no recomputation before it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        for opened in _stages:
            opened.append(self)

    def cut(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """Writes df, in folders by the values of `by`, and returns what reads it."""
        with shuffles_end_with_the_query(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more; without names all of the run."""
        jvm = self.spark.sparkContext._jvm
        for name in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_end_with_the_query(spark: SparkSession) -> Iterator[None]:
    """Queries that start within delete their shuffle files when they end; afterwards the session's own setting holds again."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def text_or_empty(df: DataFrame) -> DataFrame:
    return df.withColumn("text", F.coalesce("text", F.lit("")))


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, without decoding; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
