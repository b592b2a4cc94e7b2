"""Periods and text features as column expressions: what of the verifier stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions import verifier as v
from attesta.functions.text import words

_MONTH = "|".join(v.MONTHS)
MONTH_YEAR = rf"(?<!rio de )\b({_MONTH})\s*(?:de\s+|/\s*)?(\d{{4}})\b"
QUARTER_YEAR = r"\b(primeiro|segundo|terceiro|quarto|[1-4])\s*[ºo°]?\s+trimestre\s+(?:de\s+)?(\d{4})\b"
CYCLE, YEAR = r"\b20\d{2}/\d{2}\b", r"\b(?:19|20)\d{2}\b"
# The words that tell a negation.
NEGATIONS = ("não", "nem", "nunca", "jamais", "ninguém", "nenhum", "nenhuma", "nada")


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def without_comparisons(text: Column) -> Column:
    """V6."""
    return F.regexp_replace(text, "(?iU)" + v.COMPARISON + r"[^,;().]*", " ")


def periods(text: Column) -> Column:
    """V5: struct of sorted months and quarters (`2026-08`, `2026-T2`), cycles and lone years; years inside the others don't count. Null gives empty arrays."""
    text = F.lower(F.coalesce(text, F.lit("")))
    number = lambda names: F.create_map(*[F.lit(x) for kv in names for x in kv])
    months = number([(m, f"{k:02d}") for k, m in enumerate(v.MONTHS, 1)])
    quarters = number([(k, str(q)) for k, q in v.QUARTERS.items()])
    at = lambda s, p, k: F.regexp_extract(s, "(?U)" + p, k)
    found_m = F.transform(_all(text, "(?U)" + MONTH_YEAR), lambda s: F.concat_ws("-", at(s, MONTH_YEAR, 2), F.try_element_at(months, at(s, MONTH_YEAR, 1))))
    found_q = F.transform(_all(text, "(?U)" + QUARTER_YEAR), lambda s: F.concat(at(s, QUARTER_YEAR, 2), F.lit("-T"), F.try_element_at(quarters, at(s, QUARTER_YEAR, 1))))
    rest = F.regexp_replace(text, f"(?U){CYCLE}|{MONTH_YEAR}|{QUARTER_YEAR}", " # ")
    tidy = lambda a: F.array_sort(F.array_distinct(a))
    return F.struct(tidy(found_m).alias("month"), tidy(found_q).alias("quarter"), tidy(_all(text, "(?U)" + CYCLE)).alias("cycle"), tidy(_all(rest, "(?U)" + YEAR)).alias("year"))


def of_reference(reference: Column) -> Column:
    """V9: the periods that a stored reference period stands for."""
    only = lambda p: F.when(reference.rlike(p), F.array(reference)).otherwise(F.array().cast("array<string>"))
    return F.struct(only(r"^\d{4}-\d{2}$").alias("month"), only(r"^\d{4}-T[1-4]$").alias("quarter"), only(r"^\d{4}/\d{2}$").alias("cycle"), only(r"^\d{4}$").alias("year"))


def _has(p: Column, kind: str) -> Column:
    return F.size(p[kind]) > 0


def _apart(a: Column, b: Column, kind: str) -> Column:
    return ~F.arrays_overlap(a[kind], b[kind])


def _decide(a: Column, b: Column) -> Column:
    out = None
    for kind in ("month", "quarter", "cycle"):
        both = _has(a, kind) & _has(b, kind)
        out = F.when(both, _apart(a, b, kind)) if out is None else out.when(both, _apart(a, b, kind))
    return out


def diverges(claim: Column, window: Column) -> Column:
    """V7, on structs of periods()."""
    annual = _has(claim, "year") & ~_has(claim, "month") & ~_has(claim, "quarter") & (_has(window, "year") | _has(window, "month") | _has(window, "quarter"))
    return _decide(claim, window).when(annual, _apart(claim, window, "year")).otherwise(F.lit(False))


def document_diverges(claim: Column, document: Column) -> Column:
    """V10."""
    annual = _has(claim, "year") & _has(document, "year") & ~_has(claim, "month") & ~_has(claim, "quarter")
    return _decide(claim, document).when(annual, _apart(claim, document, "year")).otherwise(F.lit(False))


def text_features(claim: Column, window: Column) -> Column:
    """M5: Jaccard similarity and coverage of word sets, one-sided negation, and the ratio of the sizes (claim to window); 0 where a set is empty, but for the last, which then divides by 1."""
    a, b = F.array_distinct(words(F.coalesce(claim, F.lit("")))), F.array_distinct(words(F.coalesce(window, F.lit(""))))
    both, n = F.size(F.array_intersect(a, b)), F.array(*map(F.lit, NEGATIONS))
    share = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))
    return F.struct(
        share(both, F.size(F.array_union(a, b))).alias("jaccard"), share(both, F.size(a)).alias("coverage"),
        (F.arrays_overlap(a, n) != F.arrays_overlap(b, n)).cast("double").alias("negation"), share(F.size(a), F.greatest(F.size(b), F.lit(1))).alias("length_ratio"),
    )
