"""History of changing entity attributes: versions with the period each was valid.

Consecutive snapshots of an entity are compared by null-safe full outer joins, which classify its keys as
inserted, changed, unchanged or deleted; the change events are then closed by the start of the next one.

No step puts the whole history of one key into one task. A window over a key is done in two levels: within a
key's period of time, then over one summary row for each period, so a key with a third of all rows is spread
over its periods, and the joins are on (key, time).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import cut

PERIOD_S = 7 * 86400


def _period(at: Column) -> Column:
    return F.floor(F.unix_micros(at.cast("timestamp")) / (PERIOD_S * 1_000_000))


def by_period(df: DataFrame, key: str, at: str) -> DataFrame:
    """df with _period, dealt to tasks by (key, period): what neighbours does within periods needs no further exchange."""
    return df.withColumn("_period", _period(F.col(at))).repartition(F.col(key), F.col("_period"))


def neighbours(df: DataFrame, key: str, at: str, carry: list[str] = (), previous: str = "_before", following: str = "_after") -> DataFrame:
    """Adds the time before and after each row of its key; blank (null) columns of carry keep the last value standing.

    (key, at) must be unique and not null. Two levels: inside a period of time, and over the periods of a key. df may
    come from by_period, else it is dealt here.
    """
    rows = df if "_period" in df.columns else by_period(df, key, at)
    inner = Window.partitionBy(key, "_period").orderBy(at)
    rows = rows.withColumn("_in_before", F.lag(at).over(inner)).withColumn("_in_after", F.lead(at).over(inner))
    for c in carry:
        rows = rows.withColumn(c, F.last(c, ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy(key, "_period").agg(
        F.min(at).alias("_first"),
        F.max(at).alias("_last"),
        *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(f"_carry_{c}") for c in carry),
    )
    outer = Window.partitionBy(key).orderBy("_period")
    ends = ends.select(
        key,
        "_period",
        F.lag("_last").over(outer).alias("_out_before"),
        F.lead("_first").over(outer).alias("_out_after"),
        *(F.last(f"_carry_{c}", ignorenulls=True).over(outer.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_carry_{c}") for c in carry),
    )
    joined = rows.join(ends, [key, "_period"], "left")
    for c in carry:
        joined = joined.withColumn(c, F.coalesce(c, f"_carry_{c}"))
    return (
        joined.withColumn(previous, F.coalesce("_in_before", "_out_before"))
        .withColumn(following, F.coalesce("_in_after", "_out_after"))
        .drop("_period", "_in_before", "_in_after", "_out_before", "_out_after", *(f"_carry_{c}" for c in carry))
    )


def order_buckets(df: DataFrame, order: str, parts: int = 200) -> Column | None:
    """A number that grows with a column of numbers, days or times, so that each has a like share of all rows; 0 for nulls.

    The bounds are approximate percentiles (parts numbers); where they fall changes no result. None for other types.
    """
    if not any(dict(df.dtypes)[order].startswith(t) for t in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp")):
        return None
    found = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000)).first()[0]
    return F.size(F.filter(F.array(*(F.lit(x) for x in sorted(set(found or [])))), lambda b: b <= F.col(order))) if found else F.lit(0)


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """df with the sum of a value over a key's rows up to each row, in order; nulls sort first and add nothing.

    Two levels: inside buckets of the first order column, and over the buckets of a key, of which there are at most 200.
    """
    bucket = order_buckets(df, order[0])
    rows = df.withColumn("_value", value).withColumn("_bucket", F.lit(0) if bucket is None else F.coalesce(F.when(F.col(order[0]).isNull(), -1).otherwise(bucket), F.lit(0)))
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_bucket").alias("_b")).agg(F.sum("_value").alias("_sum"))
    outer = Window.partitionBy(*(f"_k{i}" for i in range(len(keys)))).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_earlier", F.sum("_sum").over(outer)).drop("_sum")
    same = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = rows.withColumn("_inside", F.sum("_value").over(inner)).join(sums, same)
    total = F.when(F.col("_inside").isNull() & F.col("_earlier").isNull(), None).otherwise(F.coalesce("_inside", F.lit(0)) + F.coalesce("_earlier", F.lit(0)))
    return joined.withColumn(out, total).drop("_value", "_bucket", "_inside", "_b", "_earlier", *(f"_k{i}" for i in range(len(keys))))


def change_events(df: DataFrame, key: str, at: str, attributes: list[str], carry: list[str] = ()) -> DataFrame:
    """The events (key, at, event, attributes) of an entity's reports: inserted, changed.

    Each report is one row of (key, at); see latest_reports where a report was made again. A report is compared with
    the one before it by a full outer join on (key, at): a report without a predecessor is inserted, a predecessor
    without a successor is the newest state and no event, and one whose attributes differ (null-safe) is changed.
    Rows with a null key or time have no place in a history and are left out.
    """
    base = df.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, at, *attributes, *(c for c in ("_period",) if c in df.columns))
    now = cut(neighbours(base, key, at, list(carry)).select(key, at, "_before", *attributes))  # both sides of the join read it
    before = now.select(F.col(key).alias("_b_key"), F.col(at).alias("_b_at"), F.struct(*attributes).alias("_b"))
    joined = now.join(before, (F.col(key) == F.col("_b_key")) & (F.col("_before") == F.col("_b_at")), "full_outer")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col("_b")[c]) for c in attributes), F.lit(True))
    event = F.when(F.col(key).isNull(), "newest").when(F.col("_b_key").isNull(), "inserted").when(~same, "changed").otherwise("unchanged")
    return joined.withColumn("event", event).where(F.col("event").isin("inserted", "changed")).select(key, at, "event", *attributes)


def latest_reports(df: DataFrame, key: str, at: str, seq: str, columns: list[str]) -> DataFrame:
    """One row for each (key, at): the columns of the report that arrived last (highest seq; nulls count lowest), by_period.

    Rows with a null key or time are left out. Repeated reports are few, so they are dealt by period once and combined there.
    """
    value = F.struct(*(F.col(c) for c in columns))
    usable = df.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, at, seq, *(c for c in columns if c not in (key, at, seq)))
    last = by_period(usable, key, at).groupBy(key, "_period", at).agg(F.max_by(value, F.coalesce(F.col(seq), F.lit(-(2**63)))).alias("_v"))
    return last.select(key, at, "_period", *(F.col("_v")[c].alias(c) for c in columns))


def periods(events: DataFrame, key: str, at: str, closing: tuple[str, ...] = ("deleted",)) -> DataFrame:
    """Validity of each event's state: valid_from is its time, valid_to the time of the key's next event (null: open).

    Events named in closing end a period and start none.
    """
    out = neighbours(events, key, at).withColumnRenamed("_after", "valid_to").withColumnRenamed(at, "valid_from").drop("_before")
    return out.where(~F.col("event").isin(*closing))


def report_history(df: DataFrame, key: str, at: str, seq: str, attributes: list[str], carry: list[str] = ()) -> DataFrame:
    """History (key, valid_from, valid_to, event, attributes) from reports of single entities at their own times.

    Reports of the same (key, at) are one check, of which the highest seq counts. Attributes in carry keep their last
    value where a check leaves them null. A state that comes back starts a new period. An empty table gives an empty
    history; further columns of any name are ignored.
    """
    return periods(change_events(latest_reports(df, key, at, seq, attributes), key, at, attributes, carry), key, at)


def snapshot_history(df: DataFrame, key: str, snapshot: str, attributes: list[str]) -> DataFrame:
    """History from whole snapshots: a key missing from a snapshot was deleted then.

    df has one row for each (snapshot, key) (of repeated rows any one counts). Each snapshot is joined with the one before by
    a null-safe full outer join on (key, time), which classifies every key as inserted, changed, unchanged or deleted. The
    time that follows each snapshot is found in two levels too. A null key is a key; rows of a null snapshot are left out.
    """
    rows = df.where(F.col(snapshot).isNotNull()).select(F.struct(F.col(key).alias("k")).alias("_key"), F.col(snapshot).alias("_at"), *attributes).dropDuplicates(["_key", "_at"])
    times = neighbours(rows.select("_at").distinct().withColumn("_one", F.lit(1)), "_one", "_at").select("_at", "_after")
    before = rows.join(times, "_at").where("_after is not null").select(F.col("_key").alias("_b_key"), F.col("_after").alias("_b_at"), F.struct(*attributes).alias("_b"))
    joined = rows.join(before, (F.col("_key") == F.col("_b_key")) & (F.col("_at") == F.col("_b_at")), "full_outer")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col("_b")[c]) for c in attributes), F.lit(True))
    event = F.when(F.col("_at").isNull(), "deleted").when(F.col("_b_at").isNull(), "inserted").when(~same, "changed")
    events = joined.select(F.coalesce("_key", "_b_key").alias("_key"), F.coalesce("_at", "_b_at").alias("_at"), event.alias("event"), *attributes).where("event is not null")
    out = periods(events, "_key", "_at")
    return out.select(F.col("_key")["k"].alias(key), "valid_from", "event", *attributes, "valid_to")
