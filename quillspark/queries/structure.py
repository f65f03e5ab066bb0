"""Queries of geometry, snapshots, terms and streams, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.identity import canonical_json, stable_id
from quillspark.operators import geometry as GEO
from quillspark.operators import sets as S
from quillspark.operators import tables as TB
from quillspark.session import ensure_checkpoint_dir, table
from quillspark.streaming.folds import keep_latest, read_latest


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Text boxes from the parts: pages of 50 parts, with places and sizes by size and key."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.lit(1).alias("doc"), F.floor(k / 50).cast("int").alias("page"), k.alias("block"),
        (F.pmod(k * 37, F.lit(500)) / 1.0).alias("x"), (F.pmod(k * 61, F.lit(700)) / 1.0).alias("y"), (F.col("p_size") + 10.0).alias("width"), F.lit(12.0).alias("height"),
    )


def regions(spark, d) -> DataFrame:
    quarters = boxes(spark, d).select("doc", "page").distinct().select("doc", "page", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("region"))
    q = F.col("region")
    return quarters.withColumns({"x": F.pmod(q, F.lit(2)) * 250.0, "y": F.floor(q / 2) * 350.0, "width": F.lit(250.0), "height": F.lit(350.0)})


def boxes_contained(spark, d):
    return GEO.contained(boxes(spark, d), regions(spark, d), ["doc", "page"], "block", "region").select("block", "region")


def box_columns(spark, d):
    columns = regions(spark, d).where("region < 2").withColumn("height", F.lit(12.0))
    return GEO.column_of(boxes(spark, d), columns, ["doc", "page"], "block").select("block", "column_no")


def box_segments(spark, d):
    lines = boxes(spark, d).withColumn("band", F.floor(F.col("y") / 100))
    return GEO.segments(lines, ["doc", "page", "band"], "block").select("block", "segment_no")


def box_lines(spark, d):
    return GEO.line_groups(boxes(spark, d), "doc", "page", "block").select("page", "block", "line_no")


def snapshot_check(spark, d):
    """Imports as snapshots of their lines; the ones whose lines were delivered again state too little."""
    lines = S.ordinals(table(spark, d, "ingest").select("import_id", "row_id", F.length(F.coalesce("value", F.lit(""))).alias("size")), ["import_id"], ["row_id"])
    stated = table(spark, d, "ingest").groupBy("import_id").agg(F.count_distinct("line_no").alias("source_count"), F.sum(F.length(F.coalesce("value", F.lit("")))).alias("total_bytes"))
    return S.snapshot_check(lines, stated, "import_id", "size").select("import_id", F.col("complete").cast("int").alias("complete"))


def first_appearances(spark, d):
    return S.first_appearances(table(spark, d, "evidence_snapshot"), "evidence_id", ["seq"])


def term_candidates(spark, d):
    names = F.concat(F.array("preferred_name", "short_name"), F.coalesce("synonyms", F.array().cast("array<string>")))
    found = S.term_candidates(table(spark, d, "private_answers"), "analyte_raw", table(spark, d, "analyte_catalog"), "analyte_key", names)
    return found.select("analyte_raw", "n", F.array_join("keys", ",").alias("keys"))


def content_ids(spark, d):
    ids = stable_id("ev", F.col("title"), F.col("url"), F.col("published_at"))
    return table(spark, d, "evidence_snapshot").select("seq", ids.alias("content_id"))


def canonical_props(spark, d):
    return table(spark, d, "events").select("event_id", canonical_json("props").alias("props"))


def stated_ranges(spark, d):
    """Imported values that state a range or a limit, as bounds."""
    parts = TB.reference_interval(F.col("value"))
    rows = table(spark, d, "ingest").select("row_id", *(c.alias(n) for n, c in parts.items())).where("low is not null or high is not null")
    return rows.select("row_id", F.coalesce("low", F.lit("")).alias("low"), F.coalesce("high", F.lit("")).alias("high"))


def streamed_latest(spark, d):
    """The latest event of each user, kept by a stream over the events."""
    source = f"{d}/events.parquet"
    # a pattern, as a stream takes a plain path for a folder, which the table may or may not be
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{d}/events.parque[t]")
    place = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    keep_latest(stream, ["user_id"], "event_id", ["event_type"], f"{place}/state", f"{place}/mark").awaitTermination()
    return read_latest(spark, f"{place}/state")


QUERIES = {f.__name__: f for f in (boxes_contained, box_columns, box_segments, box_lines, snapshot_check, first_appearances, term_candidates, content_ids, canonical_props, stated_ranges, streamed_latest)}

_BOXES = "b AS (SELECT p_partkey // 50 AS page, p_partkey AS block, (p_partkey * 37 % 500)::DOUBLE AS x, (p_partkey * 61 % 700)::DOUBLE AS y, p_size + 10.0::DOUBLE AS w, 12.0::DOUBLE AS h FROM part)"
_REGIONS = "r AS (SELECT region, region % 2 * 250.0 AS rx, region // 2 * 350.0 AS ry FROM range(4) t(region))"

SQL = {
    "boxes_contained": f"""
        WITH {_BOXES}, {_REGIONS}, a AS (SELECT block, region, greatest(0, least(x + w, rx + 250) - greatest(x, rx)) * greatest(0, least(y + h, ry + 350) - greatest(y, ry)) AS common, w * h AS area FROM b, r)
        SELECT block, region FROM a WHERE common >= 0.95 * area""",
    "box_columns": f"WITH {_BOXES} SELECT block, (x >= -9)::INT + (x >= 241)::INT AS column_no FROM b",
    "box_segments": f"""
        WITH {_BOXES}, g AS (SELECT *, floor(y / 100) AS band, coalesce(x - lag(x + w) OVER (PARTITION BY page, floor(y / 100) ORDER BY x, block), 0) >= 1.5 * h AS new FROM b)
        SELECT block, sum(new::INT) OVER (PARTITION BY page, band ORDER BY x, block ROWS UNBOUNDED PRECEDING) + 1 AS segment_no FROM g""",
    "snapshot_check": "SELECT import_id, (count(*) = count(DISTINCT line_no))::INT AS complete FROM ingest GROUP BY import_id",
    "first_appearances": "SELECT evidence_id, min(seq) AS seq FROM evidence_snapshot WHERE evidence_id IS NOT NULL GROUP BY 1",
    "term_candidates": r"""
        WITH n AS (SELECT DISTINCT analyte_key AS k, lower(trim(regexp_replace(unnest(list_concat([preferred_name, short_name], coalesce(synonyms, []))), '\s+', ' ', 'g'), ' ')) AS f FROM analyte_catalog),
        t AS (SELECT DISTINCT analyte_raw, lower(trim(regexp_replace(analyte_raw, '\s+', ' ', 'g'), ' ')) AS f FROM private_answers WHERE analyte_raw IS NOT NULL)
        SELECT analyte_raw, count(k)::INT AS n, coalesce(string_agg(k, ',' ORDER BY k), '') AS keys FROM t LEFT JOIN n USING (f) GROUP BY analyte_raw""",
    "content_ids": "SELECT seq, 'ev_' || sha256(concat_ws(chr(0), coalesce('+' || title, '-'), coalesce('+' || url, '-'), coalesce('+' || published_at, '-')))[1:32] AS content_id FROM evidence_snapshot",
    "stated_ranges": rf"""
        WITH v AS (SELECT row_id, value, regexp_extract(value, '{TB.BETWEEN}', 1) AS a, regexp_extract(value, '{TB.BETWEEN}', 2) AS b, regexp_extract(value, '{TB.ONE_SIDED}', 1) AS s, regexp_extract(value, '{TB.ONE_SIDED}', 2) AS c FROM ingest)
        SELECT row_id, replace(CASE WHEN a <> '' THEN a WHEN s IN ('>', '>=', '≥') THEN c ELSE '' END, ',', '.') AS low, replace(CASE WHEN b <> '' THEN b WHEN s IN ('<', '<=', '≤') THEN c ELSE '' END, ',', '.') AS high FROM v WHERE a <> '' OR c <> ''""",
    "streamed_latest": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
}
