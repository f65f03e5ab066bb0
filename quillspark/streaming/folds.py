"""Streaming folds: the latest row of each key kept up to date, contents seen before dropped, counts in windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.logs import latest


def _states(spark: SparkSession, path: str) -> list[str]:
    """The state folders under a path in any file system that Spark reads, oldest first."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    return sorted(str(x.getPath()) for x in fs.listStatus(folder) if x.getPath().getName().startswith("state="))


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def keep_latest(stream: DataFrame, keys: list[str], order: str, columns: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the row of the highest order of each key in Parquet under path.

    Each batch is folded with the last state into a new folder, state=<batch>; a batch that is run again writes the same
    folder, and only the two newest ones stay. Late rows of a lower order change nothing.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [p for p in _states(spark, path) if int(p.rpartition("=")[2]) < number]
        rows = batch.select(*keys, order, *columns)
        if before:
            rows = rows.unionByName(spark.read.parquet(before[-1]).select(*keys, order, *columns))
        latest(rows, keys, order, columns).write.mode("overwrite").parquet(f"{path}/state={number:010d}")
        for old in before[:-1]:
            _remove(spark, old)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest state that keep_latest has written."""
    return spark.read.parquet(_states(spark, path)[-1])


def first_contents(stream: DataFrame, content: str, at: str, delay: str) -> DataFrame:
    """Rows whose content wasn't seen within the delay of the watermark."""
    return stream.withColumn("_digest", F.sha2(F.col(content), 256)).withWatermark(at, delay).dropDuplicatesWithinWatermark(["_digest"]).drop("_digest")


def counts_by_window(stream: DataFrame, at: str, width: str, delay: str, keys: list[str]) -> DataFrame:
    """Counts of rows in windows of event time; rows later than the delay are left out."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("from"), F.col("window.end").alias("to"), *keys, "n")
