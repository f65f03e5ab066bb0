"""Reading of imported tables: reference intervals, header fields, and which extractor reads which file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMBER = r"([-+]?[0-9]+(?:[.,][0-9]+)?)"
BETWEEN = rf"^\s*{NUMBER}\s*(?:-|–|—|\.\.|to|bis)\s*{NUMBER}\s*$"
ONE_SIDED = rf"^\s*(<=|>=|<|>|≤|≥)\s*{NUMBER}\s*$"
# Headers of laboratory tables, by field.
FIELDS = {
    "analyte_raw": ["analyte", "test", "item", "parameter", "name", "показатель"], "result": ["result", "value", "wert", "результат"], "unit_raw": ["unit", "units", "einheit", "единицы"],
    "reference": ["reference", "reference interval", "laboratory reference interval", "reference range", "норма"], "clinical_time": ["date", "collected", "time", "дата"], "specimen": ["specimen", "sample", "material"],
}


def reference_interval(text: Column) -> dict[str, Column]:
    """Columns low, high (texts with a point), low_inclusive, high_inclusive of "a - b", "< x", "≥ x"; all null for other texts."""
    between, one = text.rlike(BETWEEN), text.rlike(ONE_SIDED)
    number = lambda p, i: F.translate(F.regexp_extract(text, p, i), ",", ".")
    sign = F.regexp_extract(text, ONE_SIDED, 1)
    upper, lower = one & sign.isin("<", "<=", "≤"), one & sign.isin(">", ">=", "≥")
    return {
        "low": F.when(between, number(BETWEEN, 1)).when(lower, number(ONE_SIDED, 2)),
        "high": F.when(between, number(BETWEEN, 2)).when(upper, number(ONE_SIDED, 2)),
        "low_inclusive": F.when(between, True).when(lower, sign != ">"),
        "high_inclusive": F.when(between, True).when(upper, sign != "<"),
    }


def header_key(header: Column) -> Column:
    """A header without case, marks and repeated blanks."""
    return F.trim(F.regexp_replace(F.lower(header), r"[\s.:()]+", " "))


def field_columns(headers: DataFrame, key: str, position: str, header: str) -> DataFrame:
    """Rows (key, field, column_no, status): which column holds which field; a field that two columns claim is ambiguous.

    Headers that are no field's are left out; the list of headers is a literal, so nothing is joined.
    """
    name = header_key(F.col(header))
    field = F.coalesce(*(F.when(name.isin(*names), f) for f, names in FIELDS.items()))
    rows = headers.select(key, F.col(position).alias("column_no"), field.alias("field")).where("field is not null").distinct()
    found = rows.groupBy(key, "field").agg(F.min("column_no").alias("column_no"), F.count(F.lit(1)).alias("_n"))
    return found.select(key, "field", "column_no", F.when(F.col("_n") > 1, "ambiguous").otherwise("known").alias("status"))


def mime_matches(pattern: Column, kind: Column) -> Column:
    """Whether a pattern */*, type/* or type/subtype takes a media type."""
    return (pattern == "*/*") | (pattern == kind) | (F.endswith(pattern, F.lit("/*")) & (F.split(pattern, "/")[0] == F.split(kind, "/")[0]))


def chosen_extractors(artifacts: DataFrame, key: str, kind: str, needs: str, registry: DataFrame) -> DataFrame:
    """Rows (key, extractor_id): the extractor with the highest priority (then id) that takes the type and has all capabilities.

    registry (extractor_id, priority, patterns, capabilities) is one row an extractor. Types and needs are matched once
    for each distinct pair, however many artifacts have it. An artifact that none takes has a null.
    """
    kinds = artifacts.select(F.col(kind).alias("_k"), F.col(needs).alias("_n")).distinct()
    fits = F.exists("patterns", lambda p: mime_matches(p, F.col("_k"))) & (F.size(F.array_except(F.coalesce("_n", F.array().cast("array<string>")), "capabilities")) == 0)
    ranked = kinds.join(registry, fits).withColumn("_r", F.row_number().over(Window.partitionBy("_k", "_n").orderBy(F.desc("priority"), "extractor_id"))).where("_r = 1")
    best = ranked.select("_k", "_n", "extractor_id")
    return artifacts.join(best, F.col(kind).eqNullSafe(F.col("_k")) & F.col(needs).eqNullSafe(F.col("_n")), "left").select(key, "extractor_id")
