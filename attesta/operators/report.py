"""The report on a claim (A3, A17 to A19, P11 to P13, O2 to O6) as column expressions and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.text import iso_date
from attesta.operators.verdict import NLI_STRONG, SIM_STRONG, strong, verdicts

# Texts of the report.
COUNTS_AS = {"entailment": "apoio", "contradiction": "contradicao"}
RULES = {
    "CONFLICTING_EVIDENCE": "Há fonte independente com apoio forte e fonte independente com contradição forte.",
    "REFUTED": "Há contradição forte de ao menos uma fonte independente e nenhum apoio forte.",
    "SUPPORTED": "Há apoio forte de ao menos uma fonte independente e nenhuma contradição forte.",
    "NOT_ENOUGH_EVIDENCE": "Nenhum trecho passou dos dois limiares (similaridade e NLI) com apoio ou contradição.",
}
PUBLIC = {
    "SUPPORTED": "as evidências encontradas apoiam esta afirmação.",
    "REFUTED": "as evidências encontradas contradizem esta afirmação.",
    "NOT_ENOUGH_EVIDENCE": "não encontramos evidências suficientes para avaliar esta afirmação.",
    "CONFLICTING_EVIDENCE": "as fontes encontradas apresentam conclusões diferentes sobre esta afirmação.",
}
RELATIONS = {"entailment": "apoia", "contradiction": "contradiz", "neutral": "neutro"}
NOT_CALIBRATED = "Porcentagem não exibida: o serviço ainda não foi calibrado com dados rotulados."
WEB = "A busca usa Bing News e GDELT; a cobertura pode ser incompleta."
NO_STORE = "Checagens anteriores ainda não são consultadas em uma base própria."
COPIES = "O agrupamento de cópias só detecta textos quase literais; matérias reescritas da mesma origem ainda contam como fontes independentes."
ATTACHMENTS = "Imagens ou documentos sem texto não foram avaliados pela IA e exigem conferência humana."
NO_FILTER = "A data da notícia não está no formato AAAA-MM-DD; as evidências não foram filtradas por data."


def relation_name(relation: Column) -> Column:
    """P12."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in RELATIONS.items() for x in kv]), relation)


def rationale(verdict: Column, support: Column, against: Column, found: Column) -> Column:
    """O3."""
    return (
        F.when(verdict == "SUPPORTED", F.format_string("%d fonte(s) independente(s) trazem trechos que apoiam a afirmação, e nenhuma fonte com relação forte a contradiz.", support))
        .when(verdict == "REFUTED", F.format_string("%d fonte(s) independente(s) trazem trechos que contradizem a afirmação, e nenhuma fonte com relação forte a apoia.", against))
        .when(verdict == "CONFLICTING_EVIDENCE", F.format_string("%d fonte(s) apoiam e %d fonte(s) contradizem a afirmação.", support, against))
        .when(found, "Os trechos encontrados não têm relação forte o bastante com a afirmação para sustentar um resultado.")
        .otherwise("Nenhum trecho relacionado à afirmação foi encontrado nas fontes consultadas.")
    )


def reason(verdict: Column, attachments: Column, had_text: Column) -> Column:
    """Why no percentage is shown."""
    alone = (F.coalesce(attachments, F.lit(0)) > 0) & ~F.coalesce(had_text, F.lit(False))
    return F.when(verdict != "NOT_ENOUGH_EVIDENCE", "modelo_nao_calibrado").when(alone, "so_anexo_sem_texto").otherwise("evidencia_insuficiente")


def limitations(searched: Column, used_store: Column, attachments: Column, notes: Column | None = None) -> Column:
    """The notes that apply, in order."""
    fixed = F.array(F.lit(NOT_CALIBRATED), F.when(searched, WEB), F.when(~used_store, NO_STORE), F.lit(COPIES))
    last = F.array(F.when(F.coalesce(attachments, F.lit(0)) > 0, ATTACHMENTS))
    return F.array_compact(F.concat(fixed, F.coalesce(notes, F.array().cast("array<string>")), last) if notes is not None else F.concat(fixed, last))


def cutoff(sources: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sources(claim_id, published) that claims(claim_id, article_date) may use, and counts of removed and undated ones with a note for each claim.

    The article's own day stays; undated sources stay; an article without a date in the form of a day filters nothing, and is noted if it has another text."""
    stated = claims.select("claim_id", F.when(F.length(F.btrim("article_date")) == 10, iso_date(F.btrim("article_date"))).alias("_limit"), (F.length(F.coalesce("article_date", F.lit(""))) > 0).alias("_said"))
    dated = sources.withColumn("_day", iso_date(F.col("published"))).join(stated.select("claim_id", "_limit"), "claim_id")
    late = F.coalesce(F.col("_day") > F.col("_limit"), F.lit(False))
    counts = dated.where(F.col("_limit").isNotNull()).groupBy("claim_id").agg(F.count_if(late).alias("removed"), F.count_if(F.col("_day").isNull()).alias("undated"))
    noted = stated.join(counts, "claim_id", "left").select("claim_id", F.coalesce("removed", F.lit(0)).alias("removed"), F.coalesce("undated", F.lit(0)).alias("undated"), F.when(F.col("_said") & F.col("_limit").isNull(), NO_FILTER).alias("note"))
    return dated.where(~late).drop("_day", "_limit"), noted


def blocked_note(items: DataFrame) -> DataFrame:
    """For each claim with blocked items(claim_id, blocks), how many there are and their kinds of reason, sorted."""
    hit = items.where(F.size("blocks") > 0)
    kinds = hit.select("claim_id", F.explode(F.map_values("blocks")).alias("m")).select("claim_id", F.split("m", ":")[0].alias("m")).groupBy("claim_id").agg(F.array_join(F.array_sort(F.collect_set("m")), "; ").alias("kinds"))
    return hit.groupBy("claim_id").agg(F.count("*").alias("blocked")).join(kinds, "claim_id")


def ordered_distinct(notes: DataFrame) -> DataFrame:
    """Each text of notes(ord, text) once, at its first place."""
    return notes.where("text is not null").groupBy("text").agg(F.min("ord").alias("ord"))


def merged_checks(api: DataFrame, store: DataFrame) -> DataFrame:
    """Checks from the service, then those of the store with another (url, claim)."""
    return api.unionByName(store.join(api.select("url", "claim").distinct(), ["url", "claim"], "left_anti"))


def explained(items: DataFrame) -> DataFrame:
    """A3 by item: items(similarity, nli, relation) with which thresholds each passes, whether both, and what it counts as (null: nothing)."""
    close, sure = F.coalesce(F.col("similarity") >= SIM_STRONG, F.lit(False)), F.coalesce(F.col("nli") >= NLI_STRONG, F.lit(False))
    counts = F.when(close & sure, F.try_element_at(F.create_map(*[F.lit(x) for kv in COUNTS_AS.items() for x in kv]), F.col("relation")))
    return items.withColumns({"close": close, "sure": sure, "strong": close & sure, "counts_as": counts})


def explanations(claims: DataFrame, items: DataFrame) -> DataFrame:
    """A3: claim_id, verdict, independent_sources, the groups for and against (sorted) and the rule that decided, for every row of claims. items(claim_id, grp, domain, relation, similarity, nli)."""
    known = explained(items.withColumn("grp", group_of(F.col("grp"), F.col("domain"))))
    side = lambda kind: F.array_sort(F.collect_set(F.when(F.col("counts_as") == kind, F.col("grp"))))
    groups = known.groupBy("claim_id").agg(side("apoio").alias("groups_for"), side("contradicao").alias("groups_against"))
    rule = F.element_at(F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv]), F.col("verdict"))
    none = F.array().cast("array<string>")
    out = verdicts(claims, known).join(groups, "claim_id", "left")
    return out.select("claim_id", "verdict", "independent_sources", F.coalesce("groups_for", none).alias("groups_for"), F.coalesce("groups_against", none).alias("groups_against"), rule.alias("rule"))


def group_of(grp: Column, domain: Column) -> Column:
    """The independence group, else the domain."""
    return F.coalesce(F.nullif(grp, F.lit("")), domain)


def rounded(x: Column, places: int = 4) -> Column:
    """Half up on the decimal rendering; the reference rounds halves of the binary value to even, so a last digit may differ where the value ends in 5 there."""
    return F.round(x, places)


def public_text(verdict: Column, service: str) -> Column:
    """O2: the sentence that readers see."""
    return F.concat(F.lit(f"Resultado da verificação {service}: "), F.element_at(F.create_map(*[F.lit(x) for kv in PUBLIC.items() for x in kv]), verdict))


def reports(claims: DataFrame, items: DataFrame, checks: DataFrame, service: str) -> DataFrame:
    """O2: one row for each row of claims(claim_id, claim, attachments, had_text, searched, used_store, notes).

    items(claim_id, source_ord, win_ord, title, url, published, window, relation, origin, similarity, nli, grp, domain): consolidated windows, at most two for each of a claim's sources. checks(claim_id, rank, agency, date, url, claim, verdict_original). While nothing is calibrated no row is evaluable
    and none has a percentage, whatever its verdict. Lists follow source and window, and rank."""
    items = items.withColumn("grp", group_of(F.col("grp"), F.col("domain")))
    evidence = F.struct(
        "source_ord", "win_ord", F.col("title").alias("source"), "url", F.col("published").cast("string").alias("published"), F.col("window").alias("passage"),
        relation_name(F.col("relation")).alias("relation"), "origin", rounded(F.col("similarity")).alias("similarity"), rounded(F.col("nli")).alias("nli"),
    )
    listed = items.groupBy("claim_id").agg(F.array_sort(F.collect_list(evidence)).alias("e"))
    bare = F.transform("e", lambda x: x.dropFields("source_ord", "win_ord")).alias("evidence")
    earlier = checks.groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "agency", F.col("date").cast("string").alias("date"), "url", "claim", "verdict_original"))), lambda x: x.dropFields("rank")).alias("prior_checks"))
    sides = items.where(strong(F.col("similarity"), F.col("nli"))).groupBy("claim_id").agg(F.count_distinct(F.when(F.col("relation") == "entailment", F.col("grp"))).alias("n_for"), F.count_distinct(F.when(F.col("relation") == "contradiction", F.col("grp"))).alias("n_against"))
    found = verdicts(claims.select("claim_id"), items)
    out = claims.join(found, "claim_id").join(listed.select("claim_id", bare), "claim_id", "left").join(earlier, "claim_id", "left").join(sides, "claim_id", "left")
    v, zero = F.col("verdict"), F.lit(0)
    return out.select(
        "claim_id", "claim", v, public_text(v, service).alias("public_text"), F.lit(False).alias("evaluable"), F.lit(None).cast("double").alias("percentage"),
        reason(v, F.col("attachments"), F.col("had_text")).alias("reason"), "independent_sources", "evidence", "prior_checks",
        rationale(v, F.coalesce("n_for", zero).cast("int"), F.coalesce("n_against", zero).cast("int"), F.col("evidence").isNotNull()).alias("rationale"),
        limitations(F.col("searched"), F.col("used_store") | F.col("prior_checks").isNotNull(), F.col("attachments"), F.col("notes")).alias("limitations"),
    )


def versions(model: str, nli: str, embedding: str, config: str, snapshot: str | None) -> Column:
    """What a report was made with; without a store the search alone."""
    return F.struct(F.lit(model).alias("model"), F.lit(nli).alias("nli"), F.lit(embedding).alias("embedding"), F.lit(config).alias("config"), F.lit(snapshot or "busca_web_tempo_real").alias("evidence"))


def groups_of_trace(rows: DataFrame) -> DataFrame:
    """The titles of each group of a claim, in the order of sources: rows(claim_id, source_ord, grp, title)."""
    first = rows.groupBy("claim_id", "grp", "title").agg(F.min("source_ord").alias("source_ord"))
    return first.groupBy("claim_id", "grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("source_ord", "title"))), lambda x: x["title"]).alias("titles"))


def numbered_sources(origins: list[DataFrame]) -> DataFrame:
    """sources(claim_id, ord, ...) of several origins, one after another within each claim."""
    rows = None
    for k, x in enumerate(origins):
        x = x.withColumn("_origin", F.lit(k))
        rows = x if rows is None else rows.unionByName(x)
    return rows.withColumn("source_ord", F.row_number().over(Window.partitionBy("claim_id").orderBy("_origin", "ord"))).drop("_origin", "ord")
