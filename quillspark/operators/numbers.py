"""Numeric tokens, results, intervals, allow-listed conversions and exact comparisons."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Context, Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The notation of one numeric token.
TOKEN = r"^\s*(<=|>=|<|>|=|≤|≥)?\s*([-+−]?(?:[0-9]+(?:[.,][0-9]+)?|[.,][0-9]+)(?:[eE][-+]?[0-9]{1,3})?)\s*$"
# Words of qualitative results and of missing ones.
QUALITATIVE = ["не обнаружено", "обнаружено", "положительный", "отрицательный", "positive", "negative", "detected", "not detected"]
NO_RESULT = {"": "not_reported", "материал непригоден": "invalid_specimen", "invalid specimen": "invalid_specimen", "отменён": "cancelled", "отменен": "cancelled", "cancelled": "cancelled"}
SEMIQUANTITATIVE = r"^(\+{1,4}|[0-9]+:[0-9]+)$"


def numeric_token(text: Column) -> dict[str, Column]:
    """Columns comparator and number (text with a point) of one numeric token; nulls where it is none.

    Either mark is a decimal mark; digits are never grouped. An equals sign is no comparator.
    """
    sign = F.regexp_extract(text, TOKEN, 1)
    ok = text.rlike(TOKEN)
    number = F.translate(F.translate(F.regexp_extract(text, TOKEN, 2), ",", "."), "−", "-")
    return {
        "comparator": F.when(ok & ~sign.isin("", "="), F.translate(F.translate(sign, "≤", "L"), "≥", "G")).alias("comparator"),
        "number": F.when(ok, number).alias("number"),
    }


def comparator_name(sign: Column) -> Column:
    """lt, le, gt or ge."""
    return F.when(sign == "<", "lt").when(sign.isin("<=", "L", "≤"), "le").when(sign == ">", "gt").when(sign.isin(">=", "G", "≥"), "ge")


def result_kind(text: Column) -> Column:
    """numeric_exact, numeric_censored, qualitative, semiquantitative, no_result or text_unparsed; null is no result."""
    t = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    token = numeric_token(t)
    return (
        F.when(t.isin(*NO_RESULT), "no_result")
        .when(token["number"].isNotNull() & token["comparator"].isNull(), "numeric_exact")
        .when(token["number"].isNotNull(), "numeric_censored")
        .when(t.isin(*QUALITATIVE), "qualitative")
        .when(t.rlike(SEMIQUANTITATIVE), "semiquantitative")
        .otherwise("text_unparsed")
    )


def missing_reason(text: Column) -> Column:
    """Why a text gives no result: not_reported, invalid_specimen or cancelled; null where it may give one."""
    t = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    return F.coalesce(*(F.when(t == w, reason) for w, reason in NO_RESULT.items()))


def interval_relation(value: Column, low: Column, high: Column, low_inclusive: Column | bool = True, high_inclusive: Column | bool = True, censored: Column | bool = False) -> Column:
    """below, within, above or indeterminate. An open side is null; a censored or null value and no side at all are indeterminate."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    below = (value < low) | ((value == low) & ~lit(low_inclusive))
    above = (value > high) | ((value == high) & ~lit(high_inclusive))
    return (
        F.when(lit(censored) | value.isNull() | (low.isNull() & high.isNull()), "indeterminate")
        .when(F.coalesce(below, F.lit(False)), "below")
        .when(F.coalesce(above, F.lit(False)), "above")
        .otherwise("within")
    )


def convert_listed(df: DataFrame, value: str, unit: str, rules: DataFrame) -> DataFrame:
    """df with target_unit, converted and conversion by an allow-list (unit, target_unit, factor DECIMAL); no rule: not_listed.

    The list is small; Spark broadcasts it while it is. Each unit has one rule at most.
    """
    listed = rules.select(F.col("unit").alias("_u"), "target_unit", "factor")
    joined = df.join(listed, F.col(unit) == F.col("_u"), "left").drop("_u")
    return joined.withColumn("converted", F.col(value) * F.col("factor")).withColumn("conversion", F.when(F.col("factor").isNull(), "not_listed").otherwise("listed")).drop("factor")


@F.pandas_udf(T.StringType())
def exact_delta(a: pd.Series, b: pd.Series) -> pd.Series:
    """b - a of decimal texts of up to 512 digits, as a plain decimal text; null where one is no decimal."""
    return pd.Series([_decimal(x, y, lambda c, p, q: c.subtract(q, p), 512) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def exact_percent(a: pd.Series, b: pd.Series) -> pd.Series:
    """(b - a) / a times 100 at 50 digits, halves to even; null for a zero or missing base."""
    return pd.Series([_decimal(x, y, lambda c, p, q: None if p == 0 else c.multiply(c.divide(c.subtract(q, p), p), Decimal(100)), 50) for x, y in zip(a, b, strict=True)])


def _decimal(a, b, f, digits: int) -> str | None:
    context = Context(prec=digits, rounding=ROUND_HALF_EVEN)
    try:
        p, q = Decimal(a), Decimal(b)
    except (InvalidOperation, TypeError, ValueError):
        return None
    if not (p.is_finite() and q.is_finite()):
        return None
    out = f(context, p, q)
    return None if out is None else format(out.normalize(context), "f")
