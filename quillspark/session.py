"""Session helpers: settings, the shared folder for cut lineages, and table readers."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(cpus: int | str = "*", app: str = "quillspark", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own session and settings."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.driver.memory": "16g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where the setting is empty on a local master.

    On a cluster the setting is required: a folder of one machine would be lost with it and isn't seen by the others.
    """
    jsc = spark.sparkContext._jsc.sc()
    known = jsc.getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the shared folder, so that a lost executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def package_root() -> str:
    return os.path.dirname(os.path.abspath(__file__))


def bounded_rows(df: DataFrame, bound: int, what: str, chars: Column | None = None, most_chars: int = 50_000_000) -> list | None:
    """The rows of a table that is expected to be small, or None where it holds more than bound rows or characters.

    Rows and the characters that each holds (chars) are counted before; at most bound + 1 rows reach the driver, so the
    caller can choose a distributed way beyond the bound.
    """
    if chars is not None:
        n = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(chars), F.lit(0))).first()
        if n[0] > bound or n[1] > most_chars:
            return None
    rows = df.limit(bound + 1).collect()
    return None if len(rows) > bound else rows
