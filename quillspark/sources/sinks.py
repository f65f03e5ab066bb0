"""Sinks: immutable puts, exports, snapshots with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.texts import csv_safe


def new_objects(stored: DataFrame, incoming: DataFrame, keys: list[str], payload: str) -> tuple[DataFrame, DataFrame]:
    """Objects to append, and conflicts: incoming objects whose id is taken by another payload, there or among themselves.

    An object that stands there already with the same payload is neither.
    """
    digest = F.sha2(F.coalesce(F.col(payload).cast("string"), F.lit("\0")), 256)
    fresh = incoming.withColumn("_d", digest)
    mixed = fresh.groupBy(*keys).agg(F.min("_d").alias("_lo"), F.max("_d").alias("_hi")).where("_lo != _hi").select(*keys)
    there = stored.select(*keys, digest.alias("_s"))
    joined = fresh.dropDuplicates([*keys, "_d"]).join(there, keys, "left")
    conflicts = joined.where(F.col("_s").isNotNull() & (F.col("_s") != F.col("_d"))).select(*keys).unionByName(mixed).distinct()
    return joined.where(F.col("_s").isNull()).join(conflicts, keys, "left_anti").drop("_d", "_s"), conflicts


def export_csv(df: DataFrame, path: str) -> None:
    """CSV files whose text cells no spreadsheet takes for formulas."""
    safe = [csv_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*safe).write.mode("errorifexists").option("header", "true").csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def _table_row(df: DataFrame, name: str) -> DataFrame:
    """One row (table, n, digest) of a table, also of one without rows."""
    from quillspark.operators.sets import group_digests

    return group_digests(df, [], df.columns).select(F.lit(name).alias("table"), "n", "digest")


def write_snapshot(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Parquet tables and a manifest (table, n, digest) written last; a snapshot without a manifest isn't one."""
    spark = next(iter(tables.values())).sparkSession
    manifest = None
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        row = _table_row(spark.read.parquet(f"{path}/{name}"), name)
        manifest = row if manifest is None else manifest.unionByName(row)
    manifest.write.mode("errorifexists").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def verify_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows (table, ok) of a snapshot held against its manifest."""
    manifest = spark.read.parquet(f"{path}/manifest")
    out = None
    for r in manifest.collect():  # one row a table
        df = spark.read.parquet(f"{path}/{r['table']}")
        row = _table_row(df, r["table"]).select("table", ((F.col("n") == r["n"]) & (F.col("digest") == r["digest"])).alias("ok"))
        out = row if out is None else out.unionByName(row)
    return out
