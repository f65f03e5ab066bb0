"""Reading of guideline registry reports: one meaning for each notation of a version, status or date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.history import report_history
from quillspark.operators.times import day_in_zone, normal_time

STATE = ["version", "effective_from", "withdrawn_on", "declared_status"]


def canonical_version(version: Column) -> Column:
    """A version without case, blanks and a leading v, ver or version; null where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(version), r"[\s ]+", ""), r"^(version|vers|ver|v)[.:]?(?=\d)", "")
    return F.when(bare != "", bare)


def canonical_status(status: Column) -> Column:
    """A status in lower case with its words joined by _; null for a blank one."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(F.lower(status), r"[\s _-]+", " ")), " ", "_")
    return F.when(bare != "", bare)


def canonical_withdrawal(day: Column) -> Column:
    """A withdrawal day; the filler year 9999 means none."""
    return F.when(F.year(day) < 9999, day)


def document_states(documents: DataFrame, sites: DataFrame) -> DataFrame:
    """Reports with their four state fields in canonical form; the issuer's zone and date order read effective_from.

    An effective_from that names no single day counts as its own text without case and outer blanks.
    """
    issuer = sites.groupBy(F.col("site_name").alias("_issuer")).agg(F.min("timezone").alias("_zone"), F.min("date_order").alias("_order"))
    rows = documents.select("document_id", "seq", "last_checked_at", "issuer", *STATE).join(issuer, F.col("issuer") == F.col("_issuer"), "left")
    rows = rows.withColumn("_time", normal_time(F.col("effective_from"), F.col("_zone"), F.col("_order")))
    return rows.select(
        "document_id",
        "seq",
        "last_checked_at",
        canonical_version(F.col("version")).alias("version"),
        F.coalesce(day_in_zone(F.col("_time"), F.col("_zone")), F.col("_time")["norm"], F.lower(F.trim("effective_from"))).alias("effective_from"),
        canonical_withdrawal(F.col("withdrawn_on")).alias("withdrawn_on"),
        canonical_status(F.col("declared_status")).alias("declared_status"),
    )


def document_history(documents: DataFrame, sites: DataFrame) -> DataFrame:
    """The history of every guideline document's state; a blank status leaves the last one standing."""
    return report_history(document_states(documents, sites), "document_id", "last_checked_at", "seq", STATE, carry=["declared_status"])
