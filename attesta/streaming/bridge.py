"""Requests by folder (K12): JSON files that appear in one folder are answered in another by a streaming query, each once, also over restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

REQUEST = "request_id string, title string, text string, date string, claims array<string>, evidence array<struct<title:string,text:string,url:string,origin:string,published:string>>, attachments int"


def answer_requests(spark: SparkSession, requests: str, answers: str, checkpoint: str, answer: Callable[[DataFrame], tuple[DataFrame, DataFrame]], per_batch: int = 100, once: bool = True) -> StreamingQuery:
    """Runs answer(requests) -> (results, errors) on each micro-batch and writes both as JSON under its number, so that a batch that is run again replaces its own files. once: what is there now, then an end; else it goes on."""
    stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", per_batch).json(requests)

    def put(batch: DataFrame, number: int) -> None:
        for kind, rows in zip(("results", "errors"), answer(batch), strict=True):
            rows.write.mode("overwrite").json(f"{answers}/{kind}/batch={number}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
