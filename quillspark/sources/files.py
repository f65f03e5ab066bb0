"""Files and recorded pages as tables."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The first bytes of file types.
MAGIC = {
    "application/pdf": ["255044462D"], "image/png": ["89504E470D0A1A0A"], "image/jpeg": ["FFD8FF"], "image/gif": ["474946383761", "474946383961"],
    "image/tiff": ["49492A00", "4D4D002A"], "application/zip": ["504B0304", "504B0506"], "application/gzip": ["1F8B"],
}
SUFFIXES = {"txt": "text/plain", "csv": "text/csv", "tsv": "text/tab-separated-values", "md": "text/markdown", "json": "application/json", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg"}


def sniffed(content: Column) -> Column:
    """The media type by the first bytes; text/plain for valid UTF-8, application/octet-stream else."""
    out = F.when(F.is_valid_utf8(content.cast("string")), "text/plain").otherwise("application/octet-stream")
    for kind, heads in MAGIC.items():
        for head in heads:
            out = F.when(F.hex(F.substring(content, 1, len(head) // 2)) == head, kind).otherwise(out)
    return out


def media_type(declared: Column) -> Column:
    """A media type without parameters, blanks and case."""
    return F.lower(F.trim(F.split(declared, ";")[0]))


def scan_files(spark: SparkSession, folder: str, pattern: str = "*", most_bytes: int = 64 << 20) -> DataFrame:
    """One row a file below a folder: path, size, sha256, detected and declared type, whether they conflict, content.

    Files over most_bytes are listed with a null content, digest and detected type: they are reported, not dropped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    small = F.col("length") <= most_bytes
    content = F.when(small, F.col("content"))
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    declared = F.coalesce(*(F.when(suffix == s, t) for s, t in SUFFIXES.items()))
    rows = files.select("path", F.col("length").alias("size"), content.alias("content"), declared.alias("declared"))
    rows = rows.withColumn("sha256", F.sha2("content", 256)).withColumn("detected", F.when(F.col("content").isNotNull(), sniffed(F.col("content"))))
    texts = F.col("declared").startswith("text/") | (F.col("declared") == "application/json")
    return rows.withColumn("conflict", ~F.when(texts, F.col("detected") == "text/plain").otherwise(F.col("detected") == F.col("declared")))


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Text of bytes: UTF-16 with its mark, else strict UTF-8 (with or without mark); null for anything else."""
    out = []
    for b in content:
        try:
            out.append(None if b is None else b.decode("utf-16") if b[:2] in (b"\xff\xfe", b"\xfe\xff") else b.decode("utf-8-sig"))
        except UnicodeDecodeError:
            out.append(None)
    return pd.Series(out, dtype=object)


CELLS = T.ArrayType(T.StructType([T.StructField("row_no", T.IntegerType()), T.StructField("line_start", T.IntegerType()), T.StructField("line_end", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType()))]))


@F.pandas_udf(CELLS)
def quoted_rows(text: pd.Series) -> pd.Series:
    """Rows of a quoted delimited text with the lines each spans; short rows are filled up to the widest.

    The delimiter is the one of tab, semicolon, comma and bar that the first line has most of, comma where it has none.
    Null stays null; a text with an unclosed quote gives the rows that csv reads.
    """
    out = []
    for t in text:
        if t is None:
            out.append(None)
            continue
        head = t.split("\n", 1)[0]
        reader = csv.reader(io.StringIO(t, newline=""), delimiter=max(",\t;|", key=head.count))
        csv.field_size_limit(1 << 30)
        rows, last = [], 0
        for cells in reader:
            if any(c.strip() for c in cells):
                rows.append((len(rows) + 1, last + 1, reader.line_num, cells))
            last = reader.line_num
        width = max((len(r[3]) for r in rows), default=0)
        out.append([(n, a, b, c + [""] * (width - len(c))) for n, a, b, c in rows])
    return pd.Series(out, dtype=object)


def abstract_sections(df: DataFrame, key: str, xml: str) -> DataFrame:
    """Rows (key, position, label, text) of the abstract of a recorded article in XML; broken XML gives no row."""
    usable = df.where(F.col(xml).isNotNull() & F.trim(xml).startswith("<"))
    pairs = F.arrays_zip(F.xpath(F.col(xml), F.lit("//AbstractText/@Label")).alias("label"), F.xpath(F.col(xml), F.lit("//AbstractText/text()")).alias("text"))
    return usable.select(key, F.posexplode(pairs).alias("position", "v")).select(key, "position", "v.label", "v.text")


DOCUMENT = "document_id string, series_id string, title string, issuer string, version string, jurisdictions array<string>, published_on date, effective_from date, effective_until date, withdrawn_on date, declared_status string, last_checked_at timestamp"
RELATION = "source_document_id string, target_document_id string, relation_type string, effective_from date, affected_recommendation_keys array<string>, provenance_note string"


def guidance_registry(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables documents and relations of a JSON file of guidance; fields of other names are left out."""
    raw = spark.read.schema(f"documents array<struct<{DOCUMENT.replace(' string', ':string').replace(' array<string>', ':array<string>').replace(' date', ':date').replace(' timestamp', ':timestamp')}>>, relations array<struct<{RELATION.replace(' string', ':string').replace(' array<string>', ':array<string>').replace(' date', ':date')}>>").option("multiLine", "true").json(path)
    return {name: raw.select(F.inline(name)) for name in ("documents", "relations")}


PROVENANCE = "struct<canonical_url:string,retrieved_at:timestamp,content_sha256:string,locator:string,publisher_document_id:string>"
RECOMMENDATION = "recommendation_id string, document_id string, recommendation_key string, decision_key string, population_key string, verbatim_text string, native_grade_system string, native_grade string, native_strength string, native_certainty string, direction string, position_key string, applies_from date, applies_until date, jurisdictions array<string>, topic string"
PORTAL = "source_id string, issuer string, authority_tier string, index_url string, access_mode string, canonical_hosts array<string>, domains array<string>, jurisdictions array<string>, document_kinds array<string>, status_signals array<string>, languages array<string>, browser_fallback boolean, review_interval_days int, priority int"


def _nested(fields: str) -> str:
    return "array<struct<" + ",".join(f.strip().replace(" ", ":", 1) for f in re.split(r",(?![^<]*>)", fields)) + ">>"


def guidance_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables documents, relations and recommendations of JSON files of guidance, with their provenance.

    Fields of other names are left out; a list that is missing gives an empty table.
    """
    parts = {"documents": f"{DOCUMENT}, status_changed_on date, provenance {PROVENANCE}", "relations": RELATION, "recommendations": f"{RECOMMENDATION}, provenance {PROVENANCE}"}
    raw = spark.read.schema(", ".join(f"{n} {_nested(f)}" for n, f in parts.items())).option("multiLine", "true").json(path)
    return {name: raw.select(F.inline(name)) for name in parts}


def source_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The sources of a JSON catalogue, each with the sorted rules it breaks: no id, one that stands twice, lists that
    are empty or repeat a value, no interval of review."""
    from quillspark.operators.sets import violated

    rows = spark.read.schema(f"sources {_nested(PORTAL)}").option("multiLine", "true").json(path).select(F.inline("sources"))
    twice = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    listed = lambda c: (F.size(c) > 0) & (F.size(F.array_distinct(c)) == F.size(c))
    rules = violated({
        "id_missing": F.trim("source_id") != "", "id_twice": F.col("_n").isNull(), "hosts": listed("canonical_hosts"), "domains": listed("domains"), "jurisdictions": listed("jurisdictions"), "review_interval": F.col("review_interval_days") > 0,
    })
    return rows.join(twice, "source_id", "left").withColumn("rules", rules).drop("_n")


def recorded_pages(spark: SparkSession, path: str) -> DataFrame:
    """Rows (page, position, source_id, title, url, published_at) of recorded result pages in any file system."""
    item = "array<struct<source_id:string,title:string,url:string,published_at:string>>"
    raw = spark.read.schema(f"page int, items {item}").option("multiLine", "true").json(path)
    return raw.select(F.coalesce("page", F.lit(0)).alias("page"), F.posexplode("items").alias("position", "i")).select("page", "position", "i.*")


class RecordedPages(DataSource):
    """Recorded result pages of a search service as a table: one JSON file a page, one partition a file."""

    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return "page int, position int, source_id string, title string, url string, published_at string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PageReader(self.options["path"])


class _PageReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(str(p)) for p in sorted(Path(self.path).glob("*.json"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page = json.loads(Path(partition.value).read_text())
        for i, item in enumerate(page.get("items", [])):
            yield int(page.get("page", 0)), i, item.get("source_id"), item.get("title"), item.get("url"), item.get("published_at")
