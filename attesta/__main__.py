"""Command line of the evidence store (O9): python -m attesta <store> <command> ... Ends with 0 if all is well, 1 if nothing was loaded because of errors, 2 if something was and something failed."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.sources import files, pages
from attesta.sources.evidence import EvidenceStore


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="attesta", description=__doc__)
    top.add_argument("store", help="the store's folder")
    sub = top.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [sub.add_parser(name), *args]
    for name, *args in (("import-texts", ("paths", "+"), ("--date", "?")), ("import-urls", ("path", None)), ("import-checks", ("path", None)), ("set-classes", ("path", None), ("--column", "?"), ("--origin", "?")), ("fill-periods",), ("migrate",), ("statistics",), ("document", ("doc_id", None)), ("clean",)):
        made, *given = add(name, *args)
        for option, many in given:
            made.add_argument(option, nargs=many)
    return top


def _told(loaded: int, errors: DataFrame | None) -> int:
    """Prints errors; the exit code."""
    wrong = [] if errors is None else errors.collect()  # a line for each bad one of a curated list
    print(f"loaded: {loaded}; errors: {len(wrong)}")
    for row in wrong:
        print("error: " + " ".join(str(x) for x in row), file=sys.stderr)
    return 0 if not wrong else 2 if loaded else 1


def _rows(store: EvidenceStore, name: str, load: str | None) -> int:
    return store.read(name, (load,)).count() if load else 0


def main(args: list[str] | None = None, spark: SparkSession | None = None, fetch=None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("attesta").getOrCreate()
    store = EvidenceStore(spark, a.store)
    if a.command == "import-texts":
        docs, errors = files.text_files(spark, a.paths, a.date)
        return _told(_rows(store, "documents", store.ingest(docs, f"import-texts {len(a.paths)}")), errors)
    if a.command == "import-urls":
        read = pages.read_urls(files.url_list(spark, a.path), fetch or pages.fetch)
        docs = read.where("error is null").select("ord", "url", F.col("url").alias("reference"), "domain", "title", F.lit("url").alias("origin_type"), F.col("published").cast("string").alias("published"), "text")
        return _told(_rows(store, "documents", store.ingest(docs, "import-urls")), read.where("error is not null").select("url", "error"))
    if a.command == "import-checks":
        return _told(_rows(store, "checks", store.import_checks(files.fact_check_file(spark, a.path).drop("answer_id"))), None)
    if a.command == "set-classes":
        return _told(*store.set_classes(files.class_csv(spark, a.path, a.column or "class"), a.origin or "manual"))
    if a.command == "fill-periods":
        return _told(store.backfill_periods(), None)
    if a.command == "migrate":
        print("migrated from: " + (", ".join(map(str, store.migrate())) or "nothing to do"))
    elif a.command == "clean":
        store.clean()
    else:
        (store.statistics() if a.command == "statistics" else store.document(int(a.doc_id)).drop("text")).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
