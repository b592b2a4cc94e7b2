"""A corpus pipeline of five stages over `documents`: quality rules, near duplicates, repeated passages, benchmark items, packing.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import decontam, jaccard, packing, rules, substring
from attesta.llm.base import Scratch, stage, table
from attesta.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their own figures or their host's verdict reject go.

    Null and empty texts have no words, so they go. Null sources are one host. Repeated rows are judged one by one. Columns keep their names and values. No rows in, no rows out."""
    return rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, stays of each group linked by 0.8 similarity of five-word shingles.

    Null and empty texts link nothing and stay. Of repeated rows (same id and text) one stays; rows that share an id but not their text are documents of their own; rows without an id stay. Other columns keep
    their names and values. No rows in, no rows out."""
    return jaccard.keep_one(docs, width=5, num=8, den=10)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 13-word windows that a document with a smaller id has go; documents left without words go, and with them null and empty texts.

    Rows that share an id don't cut each other; rows without an id stay whole. A text that loses words becomes its kept words joined by one space, and n_chars (if there) its length; all else stays."""
    cut = substring.with_repeats_removed(docs)
    return cut.where(F.col("text").rlike("[^ \\t-\\r]"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least 0.8 of a benchmark item's five-word shingles go.

    Null and empty texts hold no item and stay, as all do without items. Columns keep their names and values."""
    return decontam.without_items(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of at most 2048 tokens: a row for each piece. Null and empty texts are the end id alone; repeated rows are packed each; other columns are ignored."""
    pieces = packing.pack(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing_stage),
]

#: Tokenisation has no SQL; tests/llm compares each stage and the whole with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. The tables of a stage are deleted when the next one's input is written."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        with stage():
            docs = scratch.cut(step(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
