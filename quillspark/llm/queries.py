"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.leakage import leaks
from quillspark.llm.linkage import address_key, link, records, resolver_id
from quillspark.llm.mapping import map_names, reference_rows
from quillspark.llm.packing import pack, token_counts
from quillspark.llm.reading import MAX_LABELS, reading_levels
from quillspark.operators.times import normal_time
from quillspark.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue entry that each typed analyte not confirmed so far means, or 'none'."""
    answers = table(spark, d, "private_answers")
    reference = reference_rows(table(spark, d, "analyte_catalog"), "analyte_key", "preferred_name", "short_name", "synonyms")
    usage = answers.where("mapping_status = 'confirmed'").groupBy(F.col("analyte_key").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    rows = answers.where("mapping_status != 'confirmed' or mapping_status is null").where(F.regexp_replace("analyte_raw", r"[\s ]+", "") != "").select("seq", "analyte_raw")
    return map_names(rows, "analyte_raw", reference, usage).select("seq", F.coalesce("mapped_key", F.lit("none")).alias("analyte_key"))


def works(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The records of both catalogues of works, with addresses and dates in one form."""
    sites = table(spark, d, "source_sites").groupBy("site_name").agg(F.min("timezone").alias("_zone"), F.min("date_order").alias("_order"), F.min("site_id").alias("_site"))
    hosts = table(spark, d, "source_sites").groupBy(F.col("site_id").alias("_resolver")).agg(F.min(F.concat(F.lower(F.split("site_name", " ")[0]), F.lit(".example"))).alias("_host"))
    snapshots = table(spark, d, "evidence_snapshot").select("evidence_id", "title", "url", "published_at", "organization").join(sites, F.col("organization") == F.col("site_name"), "left")
    snapshots = snapshots.withColumn("_time", normal_time(F.col("published_at"), F.coalesce("_zone", F.lit("Etc/UTC")), F.col("_order")))
    sources = table(spark, d, "scientific_source").select("source_id", "title", "url", "published_at", "organization").join(sites, F.col("organization") == F.col("site_name"), "left")
    sources = sources.withColumn("_time", normal_time(F.col("published_at"), F.coalesce("_zone", F.lit("Etc/UTC")), F.lit("DMY")))
    sources = sources.withColumn("_resolver", resolver_id(F.col("url"))).join(hosts, "_resolver", "left")
    left = records(snapshots, "evidence_id", "title", address_key(F.col("url"), F.lit(None).cast("string")), F.col("_time.norm"), "l")
    right = records(sources, "source_id", "title", address_key(F.col("url"), F.col("_host")), F.col("_time.norm"), "r")
    return left, right


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of the same work in the two catalogues."""
    return link(*works(spark, d)).select(F.col("left_id").alias("evidence_id"), F.col("right_id").alias("source_id"))


def p6_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Every text put into standard containers."""
    capacity = table(spark, d, "containers").where("container_kind = 'standard'").agg(F.min("capacity_tokens")).first()[0]
    return pack(token_counts(table(spark, d, "documents").select("doc_id", "text"), "text"), "doc_id", "tokens", capacity)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Every document that repeats two fifths of a test item's case, with the item."""
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The reading level of every document of at least 40 words that has no editor's label."""
    documents, labels = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "reading_labels")
    picked = labels.where("reading_level is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELS)
    levels = reading_levels(documents, documents.join(F.broadcast(picked), "doc_id"), "text", "reading_level", min_words=40)
    found = levels.where("reading_level is not null").select("doc_id", F.col("reading_level").cast("bigint"))
    return found.join(labels.select("doc_id"), "doc_id", "left_anti")  # ids and levels meet the labels, no texts


QUERIES = {"p3_found": p3_found, "p5_found": p5_found, "p6_assignment": p6_assignment, "p7_found": p7_found, "p8_found": p8_found}
