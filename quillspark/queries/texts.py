"""Queries of the text operators, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import texts as X
from quillspark.operators.sets import exact_duplicates
from quillspark.operators.units import read_unit
from quillspark.session import table

LINES = r"regexp_split_to_array(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '\n')"
NUMBERED = f"SELECT doc_id, unnest({LINES}) AS line, generate_subscripts({LINES}, 1) AS line_no FROM documents WHERE text IS NOT NULL"


def documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", *columns)


def paragraph_blocks(spark, d):
    return X.paragraph_blocks(documents(spark, d), "doc_id", "text")


def line_candidates(spark, d):
    rows = X.line_candidates(documents(spark, d), "doc_id", "text")
    return rows.select("doc_id", "line_no", "kind", F.coalesce("field_name", F.lit("")).alias("field_name"), F.length("raw_value").alias("n_chars"))


def delimited_cells(spark, d):
    return X.delimited_cells(documents(spark, d), "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("cells"), F.max("column_no").alias("columns"))


def delimited_issues(spark, d):
    rows = X.delimited_issues(documents(spark, d), "doc_id", "text")
    return rows.select("doc_id", "row_no", F.coalesce("column_no", F.lit(0)).alias("column_no"), "reason", F.coalesce("header", F.lit("")).alias("header"), F.coalesce("value", F.lit("")).alias("value"))


def text_fragments(spark, d):
    rows = X.fragments(documents(spark, d), "doc_id", "text")
    return rows.select("doc_id", "fragment_no", F.coalesce("previous_no", F.lit(0)).alias("previous_no"), F.coalesce("next_no", F.lit(0)).alias("next_no"), "n_chars", F.sha2("fragment", 256).alias("digest"))


def search_totals(spark, d):
    return X.search_lines(documents(spark, d), "doc_id", "text", "laborator")[0].drop("matching_lines")


def search_line_totals(spark, d):
    """search_totals with the number of lines that match, which search_first shows the first of."""
    return X.search_lines(documents(spark, d), "doc_id", "text", "laborator")[0]


def search_first(spark, d):
    return X.search_lines(documents(spark, d), "doc_id", "text", "laborator", 25)[1]


def title_search(spark, d):
    return X.title_matches(table(spark, d, "evidence_snapshot"), "title", "Persistent Cough").select("seq")


def finding_counts(spark, d):
    return X.finding_counts(documents(spark, d), "doc_id", "text")


def redaction_log(spark, d):
    rows = documents(spark, d).select(X.redacted(F.col("text")).alias("r")).select(F.explode("r.kinds").alias("kind"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("texts"))


def redacted_texts(spark, d):
    return documents(spark, d).select("doc_id", X.redacted(F.col("text")).alias("r")).where("r.n_spans > 0").select("doc_id", "r.n_spans", F.sha2("r.text", 256).alias("digest"))


def csv_cells(spark, d):
    return table(spark, d, "ingest").select("row_id", X.csv_safe(F.col("value")).alias("value"))


def search_terms(spark, d):
    catalog = table(spark, d, "analyte_catalog")
    concepts = F.concat(F.array("preferred_name"), F.coalesce("synonyms", F.array().cast("array<string>")))
    return catalog.select("analyte_key", X.search_term(concepts, F.array("quantity_kind")).alias("term"))


def duplicate_texts(spark, d):
    return exact_duplicates(documents(spark, d), "doc_id", "text")


def unit_inventory(spark, d):
    """Distinct units of the imported lines, how often each occurs, and how many readings it has."""
    counts = table(spark, d, "ingest").groupBy(F.trim("unit").alias("unit")).agg(F.count(F.lit(1)).alias("n"))

    @F.pandas_udf("int")
    def readings(s):
        return s.map(lambda u: len(read_unit(u)) if isinstance(u, str) else 0)

    status = F.when(F.coalesce("unit", F.lit("")) == "", "missing").when(F.col("readings") == 0, "unknown").when(F.col("readings") > 1, "ambiguous").otherwise("known")
    return counts.withColumn("readings", readings("unit")).select(F.coalesce("unit", F.lit("")).alias("unit"), "n", status.alias("status")).groupBy("unit", "status").agg(F.sum("n").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (paragraph_blocks, line_candidates, delimited_cells, delimited_issues, text_fragments, search_totals, search_line_totals, search_first, title_search, finding_counts, redaction_log, redacted_texts, csv_cells, search_terms, duplicate_texts, unit_inventory)
}

_KINDS = X.IDENTIFIERS | X.INSTRUCTIONS
_FOUND = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, len(regexp_extract_all(text, '{p}')) AS n FROM documents" for k, p in _KINDS.items())
_KEYED = X.KEY_VALUE.replace("'", "''")

SQL = {
    "paragraph_blocks": f"""
        WITH l AS ({NUMBERED}), b AS (SELECT *, regexp_full_match(line, '\\s*') AS blank FROM l),
        i AS (SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM b)
        SELECT doc_id, min(line_no) AS line_start, max(line_no) AS line_end, sum(length(line) + 1) - 1 AS n_chars
        FROM i WHERE NOT blank GROUP BY doc_id, island""",
    "line_candidates": f"""
        WITH l AS ({NUMBERED}), c AS (SELECT *, regexp_matches(line, '{_KEYED}') AS f FROM l WHERE NOT regexp_full_match(line, '\\s*'))
        SELECT doc_id, line_no, CASE WHEN f THEN 'field' ELSE 'statement' END AS kind, CASE WHEN f THEN regexp_extract(line, '{_KEYED}', 1) ELSE '' END AS field_name,
        length(CASE WHEN f THEN regexp_extract(line, '{_KEYED}', 2) ELSE trim(line, ' ') END) AS n_chars FROM c""",
    "delimited_cells": f"""
        WITH l AS ({NUMBERED}), b AS (SELECT *, regexp_full_match(line, '\\s*') AS blank, max(line_no) OVER (PARTITION BY doc_id) AS last FROM l),
        h AS (SELECT doc_id, arg_min(line, line_no) AS head, min(line_no) AS first FROM b WHERE NOT blank GROUP BY doc_id),
        n AS (SELECT *, list_transform([chr(9), ';', ',', '|'], lambda c: length(head) - length(replace(head, c, ''))) AS k FROM h),
        m AS (SELECT doc_id, first, head, [chr(9), ';', ',', '|'][list_position(k, list_max(k))] AS mark FROM n WHERE list_max(k) > 0),
        r AS (SELECT doc_id, line_no, blank, string_split(head, mark) AS names, string_split(line, mark) AS parts FROM b JOIN m USING (doc_id) WHERE (blank OR line_no > first) AND (line <> '' OR line_no < last))
        SELECT doc_id, count(*) AS cells, max(i) AS columns FROM (SELECT doc_id, unnest(generate_series(1, least(len(names), len(parts)))) AS i FROM r WHERE NOT blank) GROUP BY doc_id""",
    "delimited_issues": f"""
        WITH l AS ({NUMBERED}), b AS (SELECT *, regexp_full_match(line, '\\s*') AS blank, max(line_no) OVER (PARTITION BY doc_id) AS last FROM l),
        h AS (SELECT doc_id, arg_min(line, line_no) AS head, min(line_no) AS first FROM b WHERE NOT blank GROUP BY doc_id),
        n AS (SELECT *, list_transform([chr(9), ';', ',', '|'], lambda c: length(head) - length(replace(head, c, ''))) AS k FROM h),
        m AS (SELECT doc_id, first, head, [chr(9), ';', ',', '|'][list_position(k, list_max(k))] AS mark FROM n WHERE list_max(k) > 0),
        r AS (SELECT doc_id, line_no, blank, string_split(head, mark) AS names, string_split(line, mark) AS parts FROM b JOIN m USING (doc_id) WHERE (blank OR line_no > first) AND (line <> '' OR line_no < last)),
        c AS (SELECT *, unnest(generate_series(least(len(names), len(parts)) + 1, greatest(len(names), len(parts)))) AS i FROM r WHERE NOT blank)
        SELECT doc_id, line_no AS row_no, i AS column_no, CASE WHEN i > len(names) THEN 'surplus_cell' ELSE 'missing_cell' END AS reason, coalesce(trim(names[i], ' '), '') AS header, coalesce(trim(parts[i], ' '), '') AS value FROM c
        UNION ALL SELECT doc_id, line_no, 0, 'blank_line', '', '' FROM r WHERE blank""",
    "text_fragments": """
        WITH f AS (SELECT doc_id, text, ceil(length(text) / 1600.0)::INT AS k, unnest(generate_series(1, ceil(length(text) / 1600.0)::INT)) AS fragment_no FROM documents WHERE length(text) > 0)
        SELECT doc_id, fragment_no, fragment_no - 1 AS previous_no, CASE WHEN fragment_no < k THEN fragment_no + 1 ELSE 0 END AS next_no,
        length(text[(fragment_no - 1) * 1600 + 1 : fragment_no * 1600]) AS n_chars, sha256(text[(fragment_no - 1) * 1600 + 1 : fragment_no * 1600]) AS digest FROM f""",
    "search_totals": """
        SELECT count(*) AS scanned, count(*) FILTER (text IS NULL) AS null_texts, coalesce(sum(length(text)), 0) AS chars,
        count(*) FILTER (contains(lower(text), 'laborator')) AS matching_texts FROM documents""",
    "search_line_totals": f"""
        WITH l AS ({NUMBERED}) SELECT count(*) AS scanned, count(*) FILTER (text IS NULL) AS null_texts, coalesce(sum(length(text)), 0) AS chars,
        (SELECT count(*) FROM l WHERE contains(lower(line), 'laborator')) AS matching_lines, count(*) FILTER (contains(lower(text), 'laborator')) AS matching_texts FROM documents""",
    "search_first": f"WITH l AS ({NUMBERED}) SELECT doc_id, line_no FROM l WHERE contains(lower(line), 'laborator') ORDER BY doc_id, line_no LIMIT 25",
    "title_search": "SELECT seq FROM evidence_snapshot WHERE len(list_intersect(regexp_split_to_array(lower(title), '[^\\p{L}\\p{N}]+'), ['cough', 'persistent'])) = 2",
    "finding_counts": f"SELECT doc_id, kind, n FROM ({_FOUND}) WHERE n > 0",
    "csv_cells": r"SELECT row_id, CASE WHEN regexp_matches(value, '^[=+\-@\t\r\n]') THEN chr(39) || value ELSE value END AS value FROM ingest",
    "search_terms": """
        SELECT analyte_key, array_to_string(list_transform(list_concat([preferred_name], coalesce(synonyms, [])), lambda c: '(' || c || ')'), ' AND ') || ' AND (' || quantity_kind || ')' AS term FROM analyte_catalog""",
    "duplicate_texts": """
        WITH h AS (SELECT doc_id, strlen(text) AS n, sha256(text) AS d FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY n, d) AS class_id, count(*) OVER (PARTITION BY n, d) AS copies FROM h""",
}
