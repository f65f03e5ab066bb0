"""Folds of append-only logs: latest rows, version numbers, chains, budgets, one-to-one replacement, conflicts.

Folds that need one row a key are aggregates, not windows, so that a hot key is combined before the shuffle. Windows stay
where every row of a key is numbered; their key's rows go through one sorted task, so the operators say so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.history import order_buckets, running


def latest(df: DataFrame, keys: list[str], order: str, columns: list[str], where: Column | None = None) -> DataFrame:
    """The columns of the row with the highest order of each key; the order of arrival decides, not a timestamp."""
    rows = df if where is None else df.where(where)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(order, *columns), order).alias("_v")).select(*keys, f"_v.{order}", *(f"_v.{c}" for c in columns))


def version_numbers(df: DataFrame, key: str, content: str, order: str) -> DataFrame:
    """Rows (key, content, first_seen, version_no): contents numbered in order of first arrival; one that comes back keeps its number.

    The distinct contents of a key are numbered in two levels, after they were combined.
    """
    firsts = df.groupBy(key, content).agg(F.min(order).alias("first_seen"))
    return running(firsts, [key], ["first_seen"], F.lit(1), "version_no")


def chain_breaks(df: DataFrame, key: str, sequence: str, token: str, previous: str) -> DataFrame:
    """Rows that break a chain (key, sequence, reason): the sequence has a gap or the previous token isn't the one before.

    Each row is joined with the one before it by (key, sequence), so a long chain is spread over all tasks.
    """
    before = df.select(F.col(key).alias("_k"), (F.col(sequence) + 1).alias("_s"), F.col(token).alias("_t"))
    joined = df.join(before, F.col(key).eqNullSafe(F.col("_k")) & (F.col(sequence) == F.col("_s")), "left")
    reason = (
        F.when((F.col(sequence) == 1) & F.col(previous).isNotNull(), "first_has_predecessor")
        .when((F.col(sequence) > 1) & F.col("_s").isNull(), "gap")
        .when((F.col(sequence) > 1) & ~F.col(previous).eqNullSafe(F.col("_t")), "wrong_predecessor")
    )
    return joined.withColumn("reason", reason).where("reason is not null").select(key, sequence, "reason")


def chronology(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Rows (key, n, ordered): whether a key's periods follow each other without touching, in order of their start.

    Two levels: inside buckets of the start, and over one row a bucket, so no task sorts all periods of a hot key.
    """
    bucket = order_buckets(df, start)
    rows = df.select(key, start, end, (F.lit(0) if bucket is None else bucket).alias("_b"))
    last = F.lag(end).over(Window.partitionBy(key, "_b").orderBy(start, end))
    rows = rows.withColumn("_clash", F.coalesce(last >= F.col(start), F.lit(False)) | F.col(start).isNull() | F.col(end).isNull())
    place = F.struct(start, end)
    parts = rows.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("n"), F.bool_or("_clash").alias("_clash"), F.min(place).alias("_first"), F.max(place).alias("_last"))
    before = F.lag(F.col("_last")[end]).over(Window.partitionBy(key).orderBy("_b"))
    parts = parts.withColumn("_clash", F.col("_clash") | F.coalesce(before >= F.col("_first")[start], F.lit(False)))
    return parts.groupBy(key).agg(F.sum("n").alias("n"), (~F.bool_or("_clash")).alias("ordered"))


def over_budget(df: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """df with running (the sum of size up to the row) and over (whether it is above the budget), see history.running."""
    return running(df, [key], [order], F.col(size), "running").withColumn("over", F.col("running") > budget)


def one_to_one(old: DataFrame, new: DataFrame, keys: list[str], old_id: str, new_id: str) -> DataFrame:
    """Pairs (keys, old_id, new_id) where a key has exactly one old and exactly one new row; ambiguous keys give nothing."""
    a = old.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(old_id).alias(old_id)).where("_n = 1").drop("_n")
    b = new.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(new_id).alias(new_id)).where("_n = 1").drop("_n")
    return a.join(b, keys)


def source_conflicts(df: DataFrame, binding: str, row_key: str, source: str) -> DataFrame:
    """Rows (binding, row_key, n_sources) that at least two sources claim."""
    pairs = df.select(binding, row_key, source).distinct()
    return pairs.groupBy(binding, row_key).agg(F.count(F.lit(1)).alias("n_sources")).where("n_sources >= 2")


def opposed(df: DataFrame, keys: list[str], direction: str, position: str) -> DataFrame:
    """Rows (keys, kind, n) of groups of two rows or more that contradict each other: in direction (against and for or
    conditional) or in position (more than one)."""
    groups = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(F.col(direction) == "against").alias("_a"),
        F.bool_or(F.col(direction).isin("for", "conditional")).alias("_f"),
        F.min(position).alias("_lo"),
        F.max(position).alias("_hi"),
    )
    kinds = F.array_compact(F.array(F.when(F.col("_a") & F.col("_f"), "direction"), F.when(F.col("_lo") != F.col("_hi"), "position")))
    return groups.where("n >= 2").select(*keys, F.explode(kinds).alias("kind"), "n")


def relative_days(df: DataFrame, key: str, day: str) -> DataFrame:
    """df with relative_day (day - latest day of the key: 0 or less) and days_before_latest, its opposite.

    The latest days are joined, not windowed; rows without a day have nulls.
    """
    last = df.groupBy(F.col(key).alias("_k")).agg(F.max(day).alias("_last"))
    return df.join(last, F.col(key).eqNullSafe(F.col("_k")), "left").withColumns({"relative_day": F.datediff(day, "_last"), "days_before_latest": F.datediff("_last", day)}).drop("_k", "_last")
