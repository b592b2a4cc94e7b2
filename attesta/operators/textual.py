"""Verifier, extraction, chunking and overlap over DataFrames, in Arrow batches: no shuffle, bounded by the batch, and a lost task is only run again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attesta.functions import chunks as C
from attesta.functions import claims as E
from attesta.functions import similarity as S
from attesta.functions import verifier as V
from attesta.sources.store import ship

CANDIDATE = "array<struct<claim string, source_sentence string, pos int, score int, signals array<string>, alerts array<string>, attribution string>>"


def with_result(df: DataFrame, name: str, kind: str, f: Callable, *inputs: Column, batched: bool = False) -> DataFrame:
    """df with column `name` = f(*inputs) for each row; inputs pass as Python values, null as None. Other columns stay as they are. batched: f takes a batch's lists and returns a list, as models do."""
    ship(df.sparkSession)
    args = [f"_arg{k}" for k in range(len(inputs))]
    wide = df.withColumns(dict(zip(args, inputs, strict=True)))
    schema = StructType([*df.schema.fields, *StructType.fromDDL(f"`{name}` {kind}").fields])
    keep = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(schema[-1].dataType)
        for b in batches:
            given = [b.column(a).to_pylist() for a in args]
            values = f(*given) if batched else [f(*row) for row in zip(*given, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(values, arrow)], [*keep, name])

    return wide.mapInArrow(run, schema)


def _empty(*values):
    return tuple("" if x is None else x for x in values)


def blocked(pairs: DataFrame, only_off_topic: bool = False) -> DataFrame:
    """V18 on pairs(claim, window, document, title, domain, doc_period): adds blocks, a map from relation to reason, empty where nothing is blocked. Nulls count as empty."""
    f = lambda c, w, d, t, h, p: list(V.blocks(*_empty(c, w, d, t, h), p, only_off_topic).items())
    return with_result(pairs, "blocks", "map<string,string>", f, *(F.col(c) for c in ("claim", "window", "document", "title", "domain", "doc_period")))


def reference_periods(titles: DataFrame) -> DataFrame:
    """V8, K5: adds ref_period, from titles(title, published)."""
    return with_result(titles, "ref_period", "string", lambda t, p: V.reference_period(t or "", p), F.col("title"), F.col("published").cast("string"))


def with_years(windows: DataFrame) -> DataFrame:
    """Adds premise, the window with years after its bare months."""
    return with_result(windows, "premise", "string", lambda w, p: V.with_years(w or "", p), F.col("window"), F.col("published").cast("string"))


def named(texts: DataFrame) -> DataFrame:
    """V2: adds names, from texts(text)."""
    return with_result(texts, "names", "array<string>", lambda t: V.names(t or ""), F.col("text"))


def measured(texts: DataFrame) -> DataFrame:
    """Adds quantities, each with the periods and direction that surround it."""
    kind = "array<struct<value double, negative boolean, unit string, falls boolean, months array<string>, start int, end int>>"

    def f(text):
        return [{"value": x.quantity.value, "negative": x.quantity.negative, "unit": x.quantity.unit, "falls": x.falls, "months": sorted(f"{y}-{m:02d}" for m, y in x.periods["month"]), "start": x.quantity.start, "end": x.quantity.end} for x in V.facts(text or "")]

    return with_result(texts, "quantities", kind, f, F.col("text"))


def candidates(articles: DataFrame, most: int = E.MOST, least: int = E.LEAST_SCORE) -> DataFrame:
    """A row for each candidate claim of articles(article_id, title, text, date), with its rank; articles without any give none."""
    got = with_result(articles.select("article_id", "title", "text", "date"), "c", CANDIDATE, lambda t, x, d: E.extract(t, x, d, most, least), F.col("title"), F.col("text"), F.col("date").cast("string"))
    return got.select("article_id", F.posexplode("c").alias("rank", "c")).select("article_id", (F.col("rank") + 1).alias("rank"), "c.*")


def chunked(docs: DataFrame, words: int = C.CHUNK_WORDS, overlap: int = C.OVERLAP_WORDS) -> DataFrame:
    """doc_id, pos and text of the chunks of docs(doc_id, text)."""
    got = with_result(docs.select("doc_id", "text"), "c", "array<string>", lambda t: C.chunks(t, words, overlap), F.col("text"))
    return got.select("doc_id", F.posexplode("c").alias("pos", "text"))


def provided_pieces(docs: DataFrame) -> DataFrame:
    """doc_id, pos and text of the pieces of provided texts."""
    got = with_result(docs.select("doc_id", "text"), "c", "array<string>", C.pieces, F.col("text"))
    return got.select("doc_id", F.posexplode("c").alias("pos", "text"))


def overlaps(pairs: DataFrame) -> DataFrame:
    """Q1: adds word_f1, rouge_l and coverage, from pairs(candidate, reference)."""
    f = lambda c, r: {"word_f1": S.word_f1(*(x := _empty(c, r))), "rouge_l": S.rouge_l(*x), "coverage": S.coverage(*x)}
    return with_result(pairs, "overlap", "struct<word_f1:double,rouge_l:double,coverage:double>", f, F.col("candidate"), F.col("reference"))
