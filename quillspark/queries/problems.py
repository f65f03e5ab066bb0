"""Queries of the general data problems (history, units, times)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.guidelines import document_history
from quillspark.operators.times import with_normal_time
from quillspark.operators.units import label_parts, value_milli
from quillspark.queries import times_sql
from quillspark.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """One row for each period of a state of a guideline document."""
    history = document_history(table(spark, d, "guideline_documents"), table(spark, d, "source_sites"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return history.select("document_id", stamp("valid_from").alias("valid_from"), F.coalesce(stamp("valid_to"), F.lit("")).alias("valid_to"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The value of every laboratory row that gives one number and a unit, in its analyte's common unit, times 1,000."""
    sites = table(spark, d, "source_sites").groupBy("site_id").agg(F.min("decimal_mark").alias("mark"))
    catalog = table(spark, d, "analyte_catalog").select("analyte_key", "short_name", "preferred_name", "common_unit", "molar_mass")
    names = catalog.select(F.explode(F.array_distinct(F.array(F.lower(F.trim("short_name")), F.lower(F.trim("preferred_name"))))).alias("_name"), "common_unit", "molar_mass")
    names = names.where("_name is not null").dropDuplicates(["_name"])
    lines = table(spark, d, "ingest").select("row_id", "site_id", "item", "value", "unit").where("value is not null and item is not null")
    lines = lines.withColumn("_label", label_parts(F.col("item"))).withColumn("_name", F.lower(F.trim("_label.name")))
    lines = lines.join(names, "_name").join(sites, "site_id", "left")
    lines = lines.select(F.lit("ingest").alias("table_name"), "row_id", value_milli(F.col("value"), F.col("mark"), F.col("common_unit"), F.col("molar_mass"), F.col("unit"), F.col("_label.unit")).alias("value_milli"))
    answers = table(spark, d, "private_answers").where("mapping_status = 'confirmed'").select("seq", "site_id", "analyte_key", "analyte_raw", "unit_raw", F.col("result.raw").alias("text"))
    answers = answers.where("text is not null").join(catalog.dropDuplicates(["analyte_key"]), "analyte_key").join(sites, "site_id", "left")
    answers = answers.withColumn("_label", label_parts(F.col("analyte_raw")))
    answers = answers.select(F.lit("private_answers").alias("table_name"), F.col("seq").alias("row_id"), value_milli(F.col("text"), F.col("mark"), F.col("common_unit"), F.col("molar_mass"), F.col("unit_raw"), F.col("_label.unit")).alias("value_milli"))
    return lines.unionAll(answers).where("value_milli is not null")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every text of time in three tables that has one determined meaning, in its normal form."""
    sites = table(spark, d, "source_sites")
    by_name = sites.groupBy(F.col("site_name").alias("_site")).agg(F.min("timezone").alias("_zone"), F.min("date_order").alias("_order"))
    by_id = sites.groupBy(F.col("site_id").alias("_site")).agg(F.min("timezone").alias("_zone"), F.min("date_order").alias("_order"))
    answers = table(spark, d, "private_answers").select("seq", "site_id", F.col("clinical_time.raw").alias("text"), F.col("clinical_time.timezone").alias("own_zone"))
    parts = {
        "private_answers": answers.join(by_id, F.col("site_id") == F.col("_site"), "left").withColumn("_zone", F.coalesce(F.when(F.trim("own_zone") != "", F.trim("own_zone")), "_zone")),
        "guideline_documents": table(spark, d, "guideline_documents").select("seq", "issuer", F.col("effective_from").alias("text")).join(by_name, F.col("issuer") == F.col("_site"), "left"),
        "evidence_snapshot": table(spark, d, "evidence_snapshot").select("seq", "organization", F.col("published_at").alias("text")).join(by_name, F.col("organization") == F.col("_site"), "left"),
    }
    rows = None
    for name, part in parts.items():
        part = part.where("text is not null").select(F.lit(name).alias("table_name"), "seq", "text", "_zone", "_order")
        rows = part if rows is None else rows.unionAll(part)
    out = with_normal_time(rows, F.col("text"), F.col("_zone"), F.col("_order"))
    return out.where("time_norm is not null").select("table_name", "seq", "time_norm")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p4_found": p4_found}

VERSION = r"nullif(regexp_replace(regexp_replace(lower({0}), '[\s\x{00a0}]+', '', 'g'), '^(version|vers|ver|v)[.:]?([0-9])', '\2'), '')"
STATUS = r"nullif(replace(trim(regexp_replace(lower({0}), '[\s\x{00a0}_-]+', ' ', 'g')), ' ', '_'), '')"
SQL = {"p1_found": times_sql.p1(VERSION.replace("{0}", "version"), STATUS.replace("{0}", "declared_status")), "p4_found": times_sql.P4}
