"""Guidance that is in force on a day, and evidence in order of weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.graphs import superseded
from quillspark.operators.logs import latest, opposed

# Weights of kinds of evidence.
WEIGHTS = {
    "clinical_guideline": 100, "randomized_trial": 80, "cohort": 65, "diagnostic_accuracy": 65, "case_control": 55, "cross_sectional": 45, "narrative_review": 35,
    "guideline": 100, "systematic review": 90, "systematic_review": 90, "meta-analysis": 90, "meta_analysis": 90, "randomised trial": 80, "randomized_controlled_trial": 80, "cluster trial": 80, "crossover trial": 80,
    "cohort study": 65, "diagnostic accuracy study": 65, "registry analysis": 65, "case-control study": 55, "cross-sectional survey": 45, "narrative review": 35, "journal_article": 30,
}


def applies(jurisdictions: Column, wanted: str) -> Column:
    """Whether a document is for a jurisdiction or for all."""
    return F.array_contains(jurisdictions, wanted) | F.array_contains(jurisdictions, "GLOBAL")


def known_on(documents: DataFrame, key: str, seq: str, recorded: str, as_of: str, columns: list[str]) -> DataFrame:
    """The latest report of each document that had been recorded by an instant; the order of arrival decides."""
    return latest(documents, [key], seq, columns, F.col(recorded) <= F.to_timestamp(F.lit(as_of)))


def _status(states: DataFrame, day: Column) -> Column:
    from quillspark.operators.periods import status_on

    declared = [F.col(c) for c in ("status_changed_on", "declared_status") if c in states.columns]
    return status_on(day, F.col("effective_from"), F.col("effective_until"), F.col("withdrawn_on"), *(declared if len(declared) == 2 else ()))


def in_force(states: DataFrame, relations: DataFrame, as_of: str, jurisdiction: str) -> DataFrame:
    """Documents (document_id, status) for a jurisdiction with their status on a day; current ones are active.

    states has document_id, effective_from, effective_until, withdrawn_on DATE and jurisdictions, and may have declared_status
    and status_changed_on. A relation counts where both of its documents are for the jurisdiction and it has started;
    a successor retires its predecessor once it is effective itself, and supersession then spreads over all relations.
    """
    day = F.to_date(F.lit(as_of))
    docs = states.where(applies(F.col("jurisdictions"), jurisdiction)).withColumn("_status", _status(states, day))
    ids = docs.select("document_id")
    started = docs.where(F.col("effective_from") <= day).select("document_id")
    edges = relations.select(F.col("source_document_id").alias("source"), F.col("target_document_id").alias("target"), F.col("relation_type").alias("relation"), "effective_from")
    edges = edges.where(F.col("effective_from") <= day).join(ids, F.col("source") == F.col("document_id"), "left_semi").join(ids, F.col("target") == F.col("document_id"), "left_semi")
    seeds = edges.where("relation = 'supersedes'").join(started, F.col("source") == F.col("document_id"), "left_semi").select("target")
    gone = superseded(edges, seeds)
    status = F.when((F.col("_status") == "active") & F.col("node").isNotNull(), "superseded").otherwise(F.col("_status"))
    return docs.join(gone, F.col("document_id") == F.col("node"), "left").select("document_id", status.alias("status"))


def ranked_evidence(items: DataFrame, key: str, kind: Column, published: Column, top: int) -> DataFrame:
    """The top items (key, weight, year) by weight of kind, year of publication, key. A year that can't be read is 0."""
    weight = F.coalesce(*(F.when(F.lower(kind) == k, w) for k, w in WEIGHTS.items()), F.lit(0))
    year = F.when(F.col("y").rlike("^[0-9]{4}$"), F.col("y").cast("int")).otherwise(0)
    rows = items.select(key, weight.alias("weight"), F.substring(published, 1, 4).alias("y")).select(key, "weight", year.alias("year"))
    return rows.distinct().orderBy(F.desc("weight"), F.desc("year"), key).limit(top)


def page_after(df: DataFrame, key: str, cursor, size: int) -> DataFrame:
    """The size + 1 rows after a key: the page and, where there is one, the row that shows that more follow."""
    rows = df.where(F.col(key) > F.lit(cursor)) if cursor is not None else df
    return rows.orderBy(key).limit(size + 1)


def page(df: DataFrame, keys: list[str], cursor: tuple | None, size: int) -> DataFrame:
    """A page of at most size rows after a cursor (a value for each key), in order, each with more: whether rows follow it.

    Keys are compared one after the other. At most size + 1 rows are sorted out of the table, and only these are numbered.
    """
    after = None
    for i, k in enumerate(keys if cursor is not None else []):
        step = F.col(k) > F.lit(cursor[i])
        for c, v in zip(keys[:i], cursor[:i], strict=True):
            step = (F.col(c) == F.lit(v)) & step
        after = step if after is None else after | step
    rows = (df if after is None else df.where(after)).orderBy(*keys).limit(size + 1)
    number, total = F.row_number().over(Window.orderBy(*keys)), F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    return rows.select("*", number.alias("_n"), total.alias("_all")).where(F.col("_n") <= size).withColumn("more", F.col("_all") > size).drop("_n", "_all")


# ---- recommendations -----------------------------------------------------------------------------------------------------------


def recommendation_applies(own: Column, document: Column, wanted: str) -> Column:
    """Whether a recommendation is for a jurisdiction: its own list decides where it has one, else its document's."""
    return F.when(F.size(F.coalesce(own, F.array().cast("array<string>"))) > 0, applies(own, wanted)).otherwise(F.coalesce(applies(document, wanted), F.lit(False)))


def in_window(as_of: Column, start: Column, end: Column) -> Column:
    """Whether a day lies between two, both included; a null end is open."""
    return (start.isNull() | (start <= as_of)) & (end.isNull() | (end >= as_of))


def recommendations_in_force(states: DataFrame, recommendations: DataFrame, relations: DataFrame, as_of: str, jurisdiction: str) -> DataFrame:
    """The recommendations that hold on a day for a jurisdiction.

    They belong to active documents, are for the jurisdiction and within their own days (applies_from, applies_until). One
    whose key a later partial update of the same series replaces is left out: the amending document must have started and
    hold a recommendation of that key which was effective at some time since; an update without one takes nothing away.

    states as for in_force, with series_id; recommendations has document_id, recommendation_key, applies_from, applies_until
    and jurisdictions. Keys without a relation and relations without keys change nothing; nulls count as open or as no key.
    """
    day = F.to_date(F.lit(as_of))
    docs = states.where(applies(F.col("jurisdictions"), jurisdiction))
    named = docs.select("document_id", "series_id", *(F.col(c).alias(f"d_{c}") for c in ("effective_from", "effective_until", "withdrawn_on", "jurisdictions")))
    active = in_force(states, relations, as_of, jurisdiction).where("status = 'active'").select("document_id")
    fits = recommendation_applies(F.col("jurisdictions"), F.col("d_jurisdictions"), jurisdiction)
    known = recommendations.join(named, "document_id").where(fits)
    current = known.where(in_window(day, F.col("applies_from"), F.col("applies_until"))).join(active, "document_id", "left_semi")

    partial = relations.where(F.col("relation_type").isin("amends", "focused_update") & (F.col("effective_from") <= day))
    partial = partial.select(F.col("source_document_id").alias("document_id"), F.col("target_document_id").alias("_target"), F.col("effective_from").alias("_from"), F.explode("affected_recommendation_keys").alias("recommendation_key"))
    partial = partial.join(docs.select(F.col("document_id").alias("_target"), F.col("series_id").alias("_series")), "_target")
    start = F.greatest("_from", "d_effective_from", "applies_from")
    was = (start <= day) & (F.col("d_effective_from") <= day) & (F.col("series_id") == F.col("_series"))
    ended = (start > F.col("applies_until")) | (start > F.col("d_effective_until")) | (start >= F.col("d_withdrawn_on"))
    shadows = known.join(partial, ["document_id", "recommendation_key"]).where(was & ~F.coalesce(ended, F.lit(False)))
    shadows = shadows.select(F.col("_target").alias("document_id"), "recommendation_key").distinct()
    return current.join(shadows, ["document_id", "recommendation_key"], "left_anti").select(*recommendations.columns)


def contradictions(recommendations: DataFrame, keys: list[str], key: str, direction: str, position: str) -> DataFrame:
    """Rows (keys, kind, key): every member of a group that contradicts itself in direction or position, see logs.opposed."""
    groups = opposed(recommendations, keys, direction, position).drop("n")
    return recommendations.select(*keys, key).join(groups, keys)


def allowed_host(url: Column, hosts: list[str]) -> Column:
    """Whether an address is https, names no user or port, and its host is one of hosts or below one."""
    host = F.lower(F.regexp_extract(url, r"^https://([^/:?#@\s]+)(?:[/?#]|$)", 1))
    return (host != "") & F.exists(F.array(*map(F.lit, hosts)), lambda h: (host == h) | F.endswith(host, F.concat(F.lit("."), h)))
