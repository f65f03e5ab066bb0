"""Points and periods of time with uncertain precision: bounds, overlap, freshness, status by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounds(norm: Column) -> tuple[Column, Column]:
    """First and last day of a normal form (year, month, day or time of day); nulls for null."""
    n = F.length(norm)
    low = F.when(n == 4, F.concat(norm, F.lit("-01-01"))).when(n == 7, F.concat(norm, F.lit("-01"))).when(n >= 10, F.substring(norm, 1, 10))
    low = F.to_date(low)
    high = F.when(n == 4, F.make_date(F.substring(norm, 1, 4).cast("int"), F.lit(12), F.lit(31))).when(n == 7, F.last_day(low)).otherwise(low)
    return low, high


def split_by_overlap(df: DataFrame, low: str, high: str, start: Column, end: Column) -> tuple[DataFrame, DataFrame]:
    """Rows whose closed period overlaps start to end, and the rows whose period is unknown; the others are in neither."""
    unknown = F.col(low).isNull() | F.col(high).isNull()
    return df.where(~unknown & (F.col(high) >= start) & (F.col(low) <= end)), df.where(unknown)


def freshness(checked: Column, as_of: Column, stale_after_days: int) -> dict[str, Column]:
    """Columns age_days and stale: a check after as_of is stale at age 0, one of over stale_after_days days is stale."""
    age = F.datediff(as_of, checked.cast("date"))
    return {"age_days": F.greatest(age, F.lit(0)).alias("age_days"), "stale": (F.coalesce(age < 0, F.lit(True)) | (age > stale_after_days)).alias("stale")}


def status_on(as_of: Column, effective_from: Column, effective_until: Column, withdrawn_on: Column, changed_on: Column | None = None, declared: Column | None = None) -> Column:
    """A document's status on a day.

    It is withdrawn from the day itself, but superseded only after effective_until. A declared status of superseded or
    withdrawn holds from the day it changed on. Before effective_from nothing else counts.
    """
    out = F.when(effective_from > as_of, "not_yet_effective").when(withdrawn_on <= as_of, "withdrawn").when(effective_until < as_of, "superseded")
    if changed_on is not None and declared is not None:
        out = out.when((changed_on <= as_of) & declared.isin("superseded", "withdrawn"), declared)
    return out.otherwise("active")


def within_clock(minute: Column, start: Column, end: Column) -> Column:
    """Whether a minute of the day lies in a period that may wrap midnight, ends included."""
    return F.when(start <= end, minute.between(start, end)).otherwise((minute >= start) | (minute <= end))
