"""Observations kept in revisions: which one counts, what replaced it, what contradicts it, and what may be compared.

A revision is a row with a subject, an observation, the version of the document it came from, and the place in the order of
arrival (seq). Folds to one row a key are aggregates, so a subject with a third of all rows is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.logs import latest
from quillspark.operators.numbers import exact_delta, exact_percent

# States of a field that say that its value isn't known.
MISSING = ["unknown", "not_reported", "not_applicable", "ambiguous"]
# Kinds of results with a number.
NUMERIC = ["numeric_exact", "numeric_censored"]
UNKNOWN_DAY = "9999-99-99"


def identity(status: Column, key: Column, raw: Column) -> Column:
    """What an observation is of: the confirmed key, else the text as typed, marked raw."""
    return F.when((status == "confirmed") & key.isNotNull() & (key != ""), key).otherwise(F.concat(F.lit("raw:"), raw))


def time_identity(time: Column, fields: tuple[str, ...] = ("role", "precision", "value", "timezone")) -> Column:
    """A struct that is equal for times that differ in their printed spelling only."""
    return F.struct(*(time[f].alias(f) for f in fields))


def field_known(value: Column, state: Column, reason: Column, trusted: Column) -> Column:
    """Whether a field has a value that counts: not null, neither its state nor a reason says missing; proposed only if trusted."""
    missing = lambda c: F.coalesce(c.isin(*MISSING), F.lit(False))
    return value.isNotNull() & ~missing(state) & ((F.coalesce(state, F.lit("")) != "proposed") | trusted) & ~missing(reason)


def strict_time(known: Column, role: Column, precision: Column) -> Column:
    """Whether a time is the known day or instant at which a sample was collected or a test performed."""
    return F.coalesce(known & role.isin("collected", "performed") & precision.isin("date", "datetime"), F.lit(False))


def history(revisions: DataFrame, relations: DataFrame, subject: str, observation: str, seq: str, version: str, trusted: str, key: list[str]) -> DataFrame:
    """Rows (seq, subject, status, replaced_by): each revision is current, contextual, revised or, in the words of a relation, replaced.

    The latest trusted and the latest untrusted revision of an observation are kept apart: the one is current, the other
    contextual. relations (subject, old_version, new_version, relation) replace current rows one for one where old and new
    version have exactly one current row with the same key; ambiguous and unmatched rows stay. Of several relations that
    replace a row the last in order counts. Nulls in key columns are equal to each other; an empty table on either side is allowed.
    """
    kept = latest(revisions, [subject, observation, trusted], seq, [version, *key])
    current = kept.where(trusted).withColumn("_key", F.struct(*key))
    rel = relations.select(F.col(subject).alias("_s"), "old_version", "new_version", "relation")
    side = lambda column, name: (
        current.join(rel, (F.col(subject) == F.col("_s")) & (F.col(version) == F.col(column)))
        .groupBy("_s", "old_version", "new_version", "relation", "_key").agg(F.count(F.lit(1)).alias("_n"), F.min(seq).alias(name)).where("_n = 1").drop("_n")
    )
    pairs = side("old_version", "_old").join(side("new_version", "_new"), ["_s", "old_version", "new_version", "relation", "_key"])
    replaced = pairs.groupBy("_old").agg(F.max(F.struct("old_version", "new_version", "relation", "_new")).alias("_by")).select("_old", F.col("_by.relation").alias("_relation"), F.col("_by._new").alias("replaced_by"))
    status = kept.select(F.col(seq).alias("_q"), F.when(F.col(trusted), "current").otherwise("contextual").alias("_status"))
    out = revisions.select(seq, subject).join(status, F.col(seq) == F.col("_q"), "left").join(replaced, F.col(seq) == F.col("_old"), "left")
    return out.select(seq, subject, F.coalesce("_relation", "_status", F.lit("revised")).alias("status"), "replaced_by")


def version_conflicts(current: DataFrame, subject: str, bindings: list[str], key: list[str], version: str, seq: str) -> DataFrame:
    """Rows (seq, binding, n_versions, n_revisions): current rows that several versions bound to the same place claim.

    bindings are columns (a document, a file) whose value binds rows; each is one group for itself. A null binds nothing.
    """
    bound = F.explode(F.array_compact(F.array(*(F.when(F.col(b).isNotNull(), F.struct(F.lit(b).alias("kind"), F.col(b).cast("string").alias("value"))) for b in bindings))))
    rows = current.select(seq, subject, version, F.struct(*key).alias("_key"), bound.alias("_b"))
    groups = rows.groupBy(subject, "_b", "_key").agg(F.count_distinct(version).alias("n_versions"), F.count(F.lit(1)).alias("n_revisions")).where("n_versions >= 2")
    return rows.join(groups, [subject, "_b", "_key"]).select(seq, F.col("_b.kind").alias("binding"), "n_versions", "n_revisions")


def history_order(low: Column, high: Column, recorded: Column, seq: Column) -> Column:
    """A struct that sorts a history: by the bounds of the clinical time (unknown ones last), the time of record, the revision."""
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(UNKNOWN_DAY))
    return F.struct(day(low).alias("low"), day(high).alias("high"), recorded.alias("recorded"), seq.alias("seq"))


def comparison_reasons(first: str = "first", row: str = "row") -> tuple[Column, Column]:
    """Two sorted arrays of reasons: why a row counts as context only, and why it can't be compared with the first at all.

    first and row are structs with trusted, current, conflicting, strict, key, mapping_status, specimen, unit, kind, reason.
    """
    a, b = (lambda c: F.col(f"{first}.{c}")), (lambda c: F.col(f"{row}.{c}"))
    either = lambda c: a(c).isNull() | b(c).isNull()
    numeric = lambda x: F.coalesce(x.isin(*NUMERIC), F.lit(False))
    context = {
        "analyte_identity_not_confirmed": b("key").isNull() | ~F.coalesce(b("mapping_status") == "confirmed", F.lit(False)),
        "clinical_time_not_exact_collection_or_performance": ~b("strict"),
        "not_user_confirmed": ~b("trusted"),
        "specimen_unknown": either("specimen"),
        "unit_unknown": either("unit") & numeric(b("kind")),
        "unresolved_source_version_relation": b("conflicting"),
    }
    no = {
        "different_analyte": a("key") != b("key"),
        "different_result_scale": (numeric(a("kind")) != numeric(b("kind"))) | (~numeric(a("kind")) & ~a("kind").eqNullSafe(b("kind"))),
        "different_specimen": a("specimen") != b("specimen"),
        "historical_or_clinically_replaced": b("trusted") & ~b("current"),
        "no_result": b("kind") == "no_result",
        "result_unparsed": b("kind") == "text_unparsed",
        "unit_conversion_rule_not_supported": a("unit") != b("unit"),
    }
    sorted_names = lambda rules: F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for name, c in sorted(rules.items()))))
    return sorted_names(context), sorted_names(no)


def compared(df: DataFrame, group: list[str], order: Column, facts: Column, seq: str) -> DataFrame:
    """Rows (group, seq, category, reasons): each row of a group held against the group's first in order.

    category is excluded (a reason forbids a comparison), contextual or included. The first row is found by an aggregate
    and joined, so no group is one task. Null groups are groups.
    """
    rows = df.select(*group, seq, order.alias("_o"), facts.alias("row"))
    first = rows.groupBy(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group))).agg(F.min_by("row", "_o").alias("first"))
    same = None
    for i, g in enumerate(group):
        c = F.col(g).eqNullSafe(F.col(f"_g{i}"))
        same = c if same is None else same & c
    context, no = comparison_reasons()
    judged = rows.join(first, same).select(*group, seq, context.alias("_c"), no.alias("_n"))
    category = F.when(F.size("_n") > 0, "excluded").when(F.size("_c") > 0, "contextual").otherwise("included")
    return judged.select(*group, seq, category.alias("category"), F.when(F.size("_n") > 0, F.col("_n")).otherwise(F.col("_c")).alias("reasons"))


def changes(included: DataFrame, group: list[str], order: Column, number: str) -> DataFrame:
    """Rows (group, n, delta, percent): the exact change from the first to the last number of groups of two or more.

    Numbers are decimal texts; percent is null for a base of zero.
    """
    ends = included.where(F.col(number).isNotNull()).groupBy(*group).agg(F.min_by(number, order).alias("_a"), F.max_by(number, order).alias("_b"), F.count(F.lit(1)).alias("n"))
    return ends.where("n >= 2").select(*group, "n", exact_delta("_a", "_b").alias("delta"), exact_percent("_a", "_b").alias("percent"))


def reused_identities(drafts: DataFrame, known: DataFrame, subject: str, locator: str, draft: str, name: str) -> DataFrame:
    """Rows (draft, name, status): a draft takes over the one identity that stands at its place in the source.

    Several identities at a place are ambiguous and several drafts at a place too; none is new. Null places are new.
    """
    at = known.where(F.col(locator).isNotNull()).groupBy(subject, locator).agg(F.count_distinct(name).alias("_n"), F.min(name).alias("_id"))
    crowd = drafts.groupBy(subject, locator).agg(F.count(F.lit(1)).alias("_m"))
    joined = drafts.select(draft, subject, locator).join(crowd.where(F.col(locator).isNotNull()), [subject, locator], "left").join(at, [subject, locator], "left")
    status = F.when(F.col("_n").isNull(), "new").when((F.col("_n") > 1) | (F.col("_m") > 1), "ambiguous").otherwise("reused")
    return joined.select(draft, F.when(status == "reused", F.col("_id")).alias(name), status.alias("status"))
