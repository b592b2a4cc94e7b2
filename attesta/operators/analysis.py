"""From claims and sources to verdicts (C3, M1 to M4, O1): one plan for all claims.

Models are two functions that load what they need on an executor: embed(texts) gives unit vectors, nli(pairs of premise and claim) gives probabilities (entailment, neutral, contradiction)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import chunks as C
from attesta.functions import text as T
from attesta.operators import report, textual, verdict
from attesta.sources.store import written

# Origins whose texts are provided and never dropped.
PROVIDED = ("link_publisher", "anexo")


def independence_groups(sources: DataFrame) -> DataFrame:
    """sources(claim_id, source_ord, domain, text, copy_of) with grp: sources of a claim with one domain, one stored copy group or shingles of Jaccard similarity 0.8 or more are one group, named after its first source's domain.

    Claims have tens of sources, so each claim is one group of rows; there is no comparison across claims. Nulls count as empty, and an empty domain or copy group joins nothing."""
    wide = sources.select("claim_id", "source_ord", F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce(F.col("copy_of").cast("string"), F.lit("")).alias("copy"), T.shingles(T.words(F.coalesce("text", F.lit("")))).alias("s"))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source_ord", kind="stable")
        domain, copy, sets = rows["domain"].tolist(), rows["copy"].tolist(), [set(s) for s in rows["s"]]
        head = list(range(len(rows)))

        def root(k: int) -> int:
            while head[k] != k:
                k = head[k]
            return k

        for j in range(len(rows)):
            for i in range(j):
                near = sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
                if near or domain[i] and domain[i] == domain[j] or copy[i] and copy[i] == copy[j]:
                    a, b = sorted((root(i), root(j)))
                    head[b] = a
        rows["grp"] = [f"grupo:{domain[root(k)] or root(k)}" for k in range(len(rows))]
        return rows[["claim_id", "source_ord", "grp"]]

    kinds = {f.name: f.dataType.simpleString() for f in sources.schema}
    groups = wide.groupBy("claim_id").applyInPandas(one, f"claim_id {kinds['claim_id']}, source_ord {kinds['source_ord']}, grp string")
    return sources.join(groups, ["claim_id", "source_ord"])


def candidate_windows(sources: DataFrame) -> DataFrame:
    """A row for each window of one or two sentences; provided texts are packed instead of filtered."""
    given = F.coalesce(F.col("origin").isin(*PROVIDED), F.lit(False))
    packed = textual.with_result(sources, "_pieces", "array<string>", C.pieces, F.when(given, F.col("text")))
    parts = packed.withColumn("_parts", F.when(given, F.col("_pieces")).otherwise(T.sentences(F.coalesce("text", F.lit("")))))
    return parts.select("*", F.posexplode(T.windows(F.col("_parts"))).alias("win_ord", "window")).drop("_pieces", "_parts")


def compared(claims: DataFrame, sources: DataFrame, embed: Callable) -> DataFrame:
    """Every candidate window of every claim with its similarity: claim_id, source_ord, grp, win_ord, window. Texts stay behind. A batch embeds each of its claims once."""

    def near(windows: list, texts: list) -> list[float]:
        asked = list(dict.fromkeys(texts))
        known = dict(zip(asked, embed(asked), strict=True))
        return [float(sum(x * y for x, y in zip(a, known[t], strict=True))) for a, t in zip(embed(windows), texts, strict=True)]

    windows = candidate_windows(sources.select("claim_id", "source_ord", "grp", "text", "origin")).select("claim_id", "source_ord", "grp", "win_ord", "window")
    rows = windows.join(claims.select("claim_id", "claim"), "claim_id")
    return textual.with_result(rows, "similarity", "double", near, F.col("window"), F.col("claim"), batched=True).drop("claim")


def _selected(rows: DataFrame, claims: DataFrame, sources: DataFrame) -> DataFrame:
    """The selected windows, and to these alone the claims and what their sources hold."""
    return verdict.select_windows(rows).join(sources.drop("grp"), ["claim_id", "source_ord"]).join(claims.select("claim_id", "claim"), "claim_id")


def score(claims: DataFrame, sources: DataFrame, embed: Callable, nli: Callable, verify: bool = True) -> DataFrame:
    """M3: the selected windows of every claim with similarity, probabilities after the verifier's shift, and blocks. claims(claim_id, claim); sources(claim_id, source_ord, domain, title, text, origin, published, ref_period, grp)."""
    return _judged(_selected(compared(claims, sources, embed), claims, sources), nli, verify)


def _judged(selected: DataFrame, nli: Callable, verify: bool) -> DataFrame:
    top = textual.with_years(selected)
    probs = textual.with_result(top, "p", "struct<e:double,n:double,c:double>", lambda w, c: [dict(zip("enc", map(float, x), strict=True)) for x in nli(list(zip(w, c, strict=True)))], F.col("premise"), F.col("claim"), batched=True)
    if not verify:
        return probs.select("*", F.col("p.e").alias("p_ent"), F.col("p.n").alias("p_neu"), F.col("p.c").alias("p_con")).drop("p")
    dated = textual.reference_periods(probs.withColumn("_stored", F.col("ref_period")).drop("ref_period")).withColumn("doc_period", F.coalesce("_stored", "ref_period"))
    held = textual.blocked(dated.withColumn("document", F.col("text")))
    has = lambda k: F.map_contains_key("blocks", F.lit(k))
    shifted = verdict.shift(F.col("p.e"), F.col("p.n"), F.col("p.c"), has("entailment"), has("contradiction"))
    return held.withColumn("q", shifted).select("*", "q.*").drop("q", "p", "_stored", "document")


def trace(claims: DataFrame, sources: DataFrame, embed: Callable, nli: Callable, verify: bool = True) -> DataFrame:
    """M4: every candidate window of every claim, also those that are not selected, with parts (1 or 2 sentences or pieces), similarity, to_nli (was it selected), probabilities (null if it was not) and in_report (does consolidation keep it).

    Windows of one text in a source are told apart by win_ord; selection prefers the first. Takes what score takes."""
    key = ["claim_id", "source_ord", "win_ord"]
    rows = compared(claims, sources, embed)
    judged = _judged(_selected(rows, claims, sources), nli, verify).select(*key, F.lit(True).alias("to_nli"), "p_ent", "p_neu", "p_con")
    kept = verdict.consolidate(judged).select(*key, F.lit(True).alias("in_report"))
    size = F.count("*").over(Window.partitionBy("claim_id", "source_ord"))  # n single windows and n - 1 pairs
    rows = rows.withColumn("parts", F.when(2 * F.col("win_ord") <= size, 1).otherwise(2))
    no = {"to_nli": False, "in_report": False}
    return rows.select(*key, "grp", "window", "parts", "similarity").join(judged, key, "left").join(kept, key, "left").fillna(no)


def analyze(claims: DataFrame, sources: DataFrame, embed: Callable, nli: Callable, verify: bool = True) -> DataFrame:
    """O1: claim_id, verdict and independent_sources of every claim; claims without sources have not enough evidence."""
    items = verdict.consolidate(score(claims, independence_groups(sources), embed, nli, verify))
    return verdict.verdicts(claims, items.select("claim_id", "grp", "relation", "similarity", F.greatest("p_ent", "p_neu", "p_con").alias("nli")))


def analyze_reports(claims: DataFrame, sources: DataFrame, checks: DataFrame, embed: Callable, nli: Callable, service: str, verify: bool = True) -> DataFrame:
    """O1, O2: the report row of every claim: claims(claim_id, claim, article_date, attachments, searched, used_store), sources as numbered and not yet cut to the article's day, checks as report.reports takes them.

    Sources that the cutoff leaves are grouped and scored; what it removes and cannot date is noted, as are blocked relations. Claims without sources have a report too."""
    kept, noted = report.cutoff(sources, claims.select("claim_id", "article_date"))
    items = written(verdict.consolidate(score(claims, independence_groups(kept), embed, nli, verify)).withColumn("nli", F.greatest("p_ent", "p_neu", "p_con")), "items")
    blocked = report.blocked_note(items) if verify else None
    notes = F.array_compact(F.array(
        F.col("note"), F.when(F.col("removed") > 0, F.format_string("%d fonte(s) publicadas depois da notícia foram desconsideradas.", "removed")), F.when(F.col("undated") > 0, F.format_string("%d fonte(s) sem data de publicação foram mantidas.", "undated")),
        *([F.when(F.col("blocked") > 0, F.format_string("%d trecho(s) tiveram a relação rebaixada: %s.", "blocked", "kinds"))] if verify else []),
    ))
    with_notes = claims.join(noted, "claim_id", "left")
    with_notes = with_notes.join(blocked, "claim_id", "left") if verify else with_notes
    had = kept.where(F.length(F.coalesce("text", F.lit(""))) > 0).select("claim_id").distinct().withColumn("had_text", F.lit(True))
    full = with_notes.withColumn("notes", notes).join(had, "claim_id", "left")
    return report.reports(full.select("claim_id", "claim", "attachments", F.coalesce("had_text", F.lit(False)).alias("had_text"), "searched", "used_store", "notes"), items, checks, service)
