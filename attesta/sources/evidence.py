"""The evidence store (K1 to K7, S16, A5, A6, J10): Parquet tables by load, and a manifest of loads that makes each visible at once.

A load writes its rows under its own id and joins the manifest last, so a load that fails or still runs is never read. Readers pass the snapshot (the ids) that they began with. Nothing is rewritten: later classes of checks and periods of documents are tables of their own, and of several the last load's holds."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.functions.text import iso_date
from attesta.operators import copies, textual
from attesta.operators import search as finding
from attesta.sources import feeds

VERSION = 3
SCHEMAS = {
    "loads": "seq long, load string, created_at timestamp, command string, version int",
    "documents": "doc_id long, url string, reference string, domain string, title string, origin_type string, published date, collected timestamp, sha256 string, copy_group long, text string, ref_period string, load string",
    "chunks": "chunk_id long, doc_id long, pos int, text string, load string",
    "vectors": "chunk_id long, model string, dim int, vec array<float>, load string",
    "checks": "id string, claim string, verdict_original string, agency string, date date, url string, load string",
    "classes": "id string, class string, class_origin string, load string",
    "periods": "doc_id long, period string, load string",
    "sets": "doc_id long, s array<bigint>, copy_group long, load string",
    "postings": "t long, doc_id long, n int, load string",
}
#: What leads from a version of the store to the next; a method of the store.
MIGRATIONS = {1: "backfill_periods", 2: "index_copies"}
_POSITIONS = 1 << 24  # chunks of one document at most


class EvidenceStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _raw(self, name: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")

    def version(self) -> int:
        """The version that the last load left the store in; a new store has the present one."""
        rows = self._raw("loads").orderBy(F.desc("seq"), F.desc("created_at")).limit(1).collect()
        return rows[0]["version"] if rows else VERSION

    def snapshot(self) -> tuple[str, ...]:
        """Ids of published loads, oldest first (one for each load command). A store of a later version is refused, one of an earlier version must be migrated first."""
        if (version := self.version()) != VERSION:
            raise RuntimeError(f"the store has version {version}, this program {VERSION}: " + ("run migrate()" if version in MIGRATIONS else "use a later program" if version > VERSION else "make the store anew"))
        return self._loads()

    def _loads(self) -> tuple[str, ...]:
        return tuple(r["load"] for r in self._raw("loads").orderBy("seq", "created_at").collect())

    def migrate(self) -> list[int]:
        """K7: leads the store to the present version, step by step; returns the versions it came from. Nothing is done twice."""
        if not self._loads():
            raise FileNotFoundError(f"no store in {self.root}")
        done = []
        while (version := self.version()) != VERSION:
            if version not in MIGRATIONS:
                raise RuntimeError(f"no way from version {version} of the store to {VERSION}")
            getattr(self, MIGRATIONS[version])(migrating=True)
            self._publish(self._new_load(), f"migrate {version}", version + 1)
            done.append(version)
        return done

    def _latest(self, name: str, key: str, snapshot: tuple[str, ...]) -> DataFrame:
        """The last load's row of each key."""
        order = F.array_position(F.array(*map(F.lit, snapshot)), F.col("load")) if snapshot else F.lit(0)
        rows = self._raw(name).where(F.col("load").isin(*snapshot))
        return rows.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in SCHEMAS_COLUMNS[name] if c not in (key, "load")])

    def checks(self, snapshot: tuple[str, ...] | None = None) -> DataFrame:
        """Checks with their class and its origin, null where none was set."""
        snapshot = self.snapshot() if snapshot is None else snapshot
        return self.read("checks", snapshot).join(self._latest("classes", "id", snapshot), "id", "left")

    def documents(self, snapshot: tuple[str, ...] | None = None) -> DataFrame:
        """Documents with periods that were filled in later."""
        snapshot = self.snapshot() if snapshot is None else snapshot
        later = self._latest("periods", "doc_id", snapshot)
        return self.read("documents", snapshot).join(later, "doc_id", "left").withColumn("ref_period", F.coalesce("ref_period", "period")).drop("period")

    def set_classes(self, classes: DataFrame, origin: str, command: str = "classes") -> tuple[int, DataFrame]:
        """classes(line, id, class) of known checks; how many were set, and (line, error) of lines with an unknown class or check. Empty classes are passed over."""
        before, load = self.checks(), self._new_load()
        changed, errors = feeds.classified(before.select("id", F.lit(None).cast("string").alias("class"), F.lit(None).cast("string").alias("class_origin")), classes, origin)
        rows = self._staged(changed.where("class is not null"), load)
        if n := rows.count():
            self._write("classes", rows, load)
            self._publish(load, command)
        return n, errors

    def backfill_periods(self, migrating: bool = False) -> int:
        """K5: finds the period of documents that have none; returns how many got one."""
        loads, load = self._loads() if migrating else self.snapshot(), self._new_load()
        lacking = self.documents(loads).where("ref_period is null").select("doc_id", "title", "published")
        rows = self._staged(textual.reference_periods(lacking).where("ref_period is not null").select("doc_id", F.col("ref_period").alias("period")), load)
        if n := rows.count():
            self._write("periods", rows, load)
            self._publish(load, "periods", VERSION if not migrating else self.version())
        return n

    def search(self, claims: DataFrame, model: str, top: int = finding.retrieval.TOP) -> DataFrame:
        """The store's sources for claims(qid, text, qvec, until), best first. Every chunk must have a vector of the model."""
        self.check_index(model)
        snapshot = self.snapshot()
        docs = self.documents(snapshot).select("doc_id", F.col("text").alias("full_text"))
        chunks = self.searchable(snapshot=snapshot)
        vectors = self.read("vectors", snapshot).where(F.col("model") == model).select("chunk_id", "vec")
        found = finding.hybrid(claims, chunks.select("chunk_id", "text", "published"), vectors, top)
        return finding.hydrated(found, chunks.join(docs, "doc_id"))

    def prior_checks(self, claims: DataFrame, top: int = finding.CHECKS) -> DataFrame:
        """The checks most like claims(qid, text). Their ids are hashes, so ties go by a number made of the id."""
        known = self.read("checks").withColumn("check_id", F.xxhash64("id"))
        return finding.prior_checks(claims, known.select("check_id", "claim", "agency", "date", "url", "verdict_original"), top)

    def read(self, name: str, snapshot: tuple[str, ...] | None = None) -> DataFrame:
        """A table as of a snapshot; the partition filter leaves other loads unread."""
        return self._raw(name).where(F.col("load").isin(*(self.snapshot() if snapshot is None else snapshot)))

    def _write(self, name: str, rows: DataFrame, load: str) -> None:
        rows.withColumn("load", F.lit(load)).select(*SCHEMAS_COLUMNS[name]).write.mode("append").partitionBy("load").parquet(f"{self.root}/{name}")

    def _publish(self, load: str, command: str, version: int = VERSION) -> None:
        row = [(len(self._loads()) + 1, load, datetime.now(UTC), command, version)]
        self.spark.createDataFrame(row, SCHEMAS["loads"]).coalesce(1).write.mode("append").parquet(f"{self.root}/loads")

    @staticmethod
    def _new_load() -> str:
        return f"base-{datetime.now(UTC):%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:6]}"

    def ingest(self, docs: DataFrame, command: str = "ingest") -> str | None:
        """K1, K2: loads docs(ord, url, reference, domain, title, origin_type, published, text) and returns the load's id, or None if all are known.

        A row is known if its reference and text are stored; of equal rows that with the least ord stays. Null texts are empty and null references are one reference. Ids follow ord; dates that are no days are null."""
        with self._alone():
            return self._ingest(docs, command)

    @contextmanager
    def _alone(self) -> Iterator[None]:
        """One load of documents at a time, as their numbers follow one another: a file that only one can make."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_lock")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        try:
            system.create(path, False).close()
        except Exception as e:
            raise RuntimeError(f"another load holds {self.root}/_lock; delete it if that load is dead") from e
        try:
            yield
        finally:
            system.delete(path, False)

    def _ingest(self, docs: DataFrame, command: str) -> str | None:
        load, before = self._new_load(), self.snapshot()
        rows = docs.withColumns({"text": F.coalesce("text", F.lit("")), "reference": F.coalesce("reference", F.lit("")), "published": iso_date(F.col("published").cast("string"))})
        rows = rows.withColumn("sha256", F.sha2("text", 256)).withColumn("_k", F.row_number().over(Window.partitionBy("reference", "sha256").orderBy("ord"))).where("_k = 1").drop("_k")
        rows = rows.join(self.read("documents", before).select("reference", "sha256"), ["reference", "sha256"], "left_anti")
        staged = self._staged(rows.repartitionByRange("ord").sortWithinPartitions("ord").withColumn("_part", F.spark_partition_id()), load)
        sizes = {r["_part"]: r["count"] for r in staged.groupBy("_part").count().collect()}  # one row for each partition
        if not sizes:
            return None
        first, at = self.read("documents", before).agg(F.max("doc_id")).first()[0] or 0, {}
        for part in sorted(sizes):
            at[part], first = first, first + sizes[part]
        offset = F.element_at(F.create_map(*[F.lit(x) for kv in at.items() for x in kv]), F.col("_part")).cast("long")
        numbered = staged.withColumn("doc_id", offset + F.row_number().over(Window.partitionBy("_part").orderBy("ord")))
        fresh_sets = self._index(load, numbered.select("doc_id", "text"), before)
        groups = fresh_sets.select("doc_id", "copy_group")
        full = textual.reference_periods(numbered).join(groups, "doc_id").withColumn("collected", F.current_timestamp())
        self._write("documents", full, load)
        fresh = self._raw("documents").where(F.col("load") == load)
        chunked = textual.chunked(fresh).withColumn("chunk_id", F.col("doc_id") * _POSITIONS + F.col("pos"))
        self._write("chunks", chunked, load)
        self._publish(load, command)
        return load

    def _index(self, load: str, docs: DataFrame, before: tuple[str, ...]) -> DataFrame:
        """Groups new documents by probing the index of sets, and adds those of new classes to it: C4 without a second look at stored texts."""
        new = self._staged(copies.indexed(docs), f"{load}-new")  # a table: filters on it must not be pushed into the shingles
        groups = copies.greedy_groups(new, self.read("sets", before), self.read("postings", before))
        known = self._staged(groups.join(new, "doc_id"), f"{load}-sets")
        same = known.where("doc_id = rep and n > 0").select("doc_id", "n", "s", "prefix", "copy_group")
        same = same.join(self.read("sets", before).select("s"), "s", "left_anti")
        self._write("sets", same, load)
        self._write("postings", same.select(F.explode("prefix").alias("t"), "doc_id", "n"), load)
        return known

    def index_copies(self, migrating: bool = False) -> None:
        """What a store of version 2 lacks: the index of its documents' sets, with the groups that they have."""
        loads, load = self._loads() if migrating else self.snapshot(), self._new_load()
        sets = self._staged(copies.indexed(self.read("documents", loads).select("doc_id", "text")), f"{load}-all").where("n > 0")
        first = sets.groupBy("s").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
        rows = self._staged(first.join(self.read("documents", loads).select("doc_id", "copy_group"), "doc_id"), load)
        self._write("sets", rows, load)
        self._write("postings", rows.select(F.explode("prefix").alias("t"), "doc_id", "n"), load)
        self._publish(load, "index of sets", self.version())

    def _staged(self, rows: DataFrame, load: str) -> DataFrame:
        rows.write.parquet(f"{self.root}/_staged/{load}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/_staged/{load}")

    def clean(self) -> None:
        """Deletes what loads staged; not while one runs."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_staged")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def import_checks(self, checks: DataFrame, command: str = "checks") -> str | None:
        """K3: fact checks(claim, verdict_original, agency, date, url) with an unknown (url, claim); of equal rows the first by verdict. Ids are hashes of both."""
        load, before = self._new_load(), self.snapshot()
        rows = checks.withColumns({"url": F.coalesce("url", F.lit("")), "claim": F.coalesce("claim", F.lit("")), "date": iso_date(F.col("date").cast("string"))})
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("url", "claim").orderBy("verdict_original", "agency", "date"))).where("_k = 1")
        rows = rows.join(self.read("checks", before).select("url", "claim"), ["url", "claim"], "left_anti").withColumn("id", F.sha2(F.concat_ws("\n", "url", "claim"), 256))
        staged = self._staged(rows, load)
        if staged.isEmpty():
            return None
        self._write("checks", staged, load)
        self._publish(load, command)
        return load

    def missing_vectors(self, model: str, snapshot: tuple[str, ...] | None = None) -> DataFrame:
        """Chunks without a vector of this model."""
        have = self.read("vectors", snapshot).where(F.col("model") == model).select("chunk_id")
        return self.read("chunks", snapshot).join(have, "chunk_id", "left_anti")

    def index(self, model: str, embed) -> str | None:
        """K6: embeds what lacks a vector of this model; embed takes a list of texts and returns their vectors."""
        load, missing = self._new_load(), self.missing_vectors(model)
        if missing.isEmpty():
            return None
        rows = textual.with_result(missing.select("chunk_id", "text"), "vec", "array<float>", lambda texts: [list(map(float, v)) for v in embed(texts)], F.col("text"), batched=True)
        self._write("vectors", rows.select("chunk_id", "vec").withColumns({"model": F.lit(model), "dim": F.size("vec")}), load)
        self._publish(load, f"index {model}")
        return load

    def check_index(self, model: str) -> None:
        """An error if a chunk lacks a vector of this model."""
        missing = self.missing_vectors(model).count()
        if missing:
            have = sorted(r[0] for r in self.read("vectors").select("model").distinct().collect())  # one for each model
            raise RuntimeError(f"{missing} chunks have no vector of {model}; models with vectors: {', '.join(have) or 'none'}")

    def searchable(self, cutoff: Column | None = None, snapshot: tuple[str, ...] | None = None) -> DataFrame:
        """Chunks with what a source needs of their documents, published by the cutoff or undated."""
        docs = self.documents(snapshot).select("doc_id", "url", "domain", "title", "published", "copy_group", "ref_period")
        docs = docs.where(F.col("published").isNull() | (F.col("published") <= cutoff)) if cutoff is not None else docs
        title = F.when(F.coalesce("url", F.lit("")) != "", F.col("title")).otherwise(F.format_string("%s (base própria, documento %d)", "title", "doc_id"))
        return self.read("chunks", snapshot).join(docs, "doc_id").withColumn("title", title)

    def document(self, doc_id: int) -> DataFrame:
        """One document with its number of chunks."""
        n = self.read("chunks").where(F.col("doc_id") == doc_id).agg(F.count("*").alias("chunks"))
        return self.read("documents").where(F.col("doc_id") == doc_id).join(F.broadcast(n))  # one row by one row

    def statistics(self) -> DataFrame:
        """A5."""
        d = self.documents().agg(F.count("*").alias("documents"), F.count_distinct("copy_group").alias("copy_groups"), F.count_distinct("domain").alias("domains"), F.count_if(F.col("published").isNull()).alias("undated"), F.count_if(F.col("ref_period").isNotNull()).alias("with_period"))
        last = self.snapshot()
        return d.withColumn("snapshot", F.lit(last[-1] if last else None).cast("string"))


SCHEMAS_COLUMNS = {k: [x.split()[0] for x in v.split(", ")] for k, v in SCHEMAS.items()}
