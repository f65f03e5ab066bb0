"""Text operators: lines, paragraph blocks, key/value lines, delimited cells, fragments, search, identifiers, redaction."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = r"^\s*$"


def _lines(text: str) -> Column:
    return F.split(F.regexp_replace(text, r"\r\n|\r", "\n"), "\n")


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, line_no, line), numbered from 1; CRLF, CR and LF end a line. A null text has no lines."""
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(_lines(text)).alias("_at", "line")).select(key, (F.col("_at") + 1).alias("line_no"), "line")


def paragraph_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, line_start, line_end, n_chars): runs of lines that aren't blank, each line with one line end.

    The window over a key holds the lines of one text only. Texts without any word give no row.
    """
    lines = text_lines(df, key, text).withColumn("_blank", F.col("line").rlike(BLANK))
    island = F.sum(F.col("_blank").cast("int")).over(Window.partitionBy(key).orderBy("line_no"))
    rows = lines.withColumn("_island", island).where(~F.col("_blank"))
    return rows.groupBy(key, "_island").agg(
        F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), (F.sum(F.length("line") + 1) - 1).alias("n_chars")
    ).drop("_island")


KEY_VALUE = r"^\s*([^:=\t\s][^:=\t]{0,159}?)\s*[:=]\s*(\S.*?)\s*$"


def line_candidates(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, line_no, kind, field_name, raw_value): a line "key: value" is a field, any other one a statement."""
    lines = text_lines(df, key, text).where(~F.col("line").rlike(BLANK))
    field = F.col("line").rlike(KEY_VALUE)
    return lines.select(
        key,
        "line_no",
        F.when(field, "field").otherwise("statement").alias("kind"),
        F.when(field, F.regexp_extract("line", KEY_VALUE, 1)).alias("field_name"),
        F.when(field, F.regexp_extract("line", KEY_VALUE, 2)).otherwise(F.trim("line")).alias("raw_value"),
    )


def _table_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, line_no, line, _blank, _head, _mark, _first) of the lines of delimited texts.

    The empty piece after the last line end is no line.
    """
    lines = text_lines(df, key, text).withColumn("_blank", F.col("line").rlike(BLANK))
    said = lines.where(~F.col("_blank"))
    first = said.groupBy(key).agg(F.min_by("line", "line_no").alias("_head"), F.min("line_no").alias("_first"))
    count = lambda c: F.length("_head") - F.length(F.replace(F.col("_head"), F.lit(c), F.lit("")))
    marks = {"\t": count("\t"), ";": count(";"), ",": count(","), "|": count("|")}
    best = F.greatest(*marks.values())
    mark = F.coalesce(*(F.when((n == best) & (best > 0), F.lit(m)) for m, n in marks.items()))
    last = lines.groupBy(key).agg(F.max("line_no").alias("_last"))
    tables = first.withColumn("_mark", mark).where("_mark is not null").join(last, key)
    return lines.join(tables, key).where((F.col("line") != "") | (F.col("line_no") < F.col("_last"))).drop("_last")


def _parts(line: str) -> Column:
    return F.transform(F.split(F.col(line), F.concat(F.lit("["), F.col("_mark"), F.lit("]"))), lambda x: F.trim(x))


def delimited_cells(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, row_no, column_no, header, value) of delimited texts.

    The delimiter is the one of tab, semicolon, comma and bar that the first line has most of (at least one); the first
    line is the header. Blank lines and cells beyond the header are kept out and stand in delimited_issues.
    """
    tabled = _table_lines(df, key, text).where(~F.col("_blank") & (F.col("line_no") > F.col("_first")))
    cells = tabled.select(key, "line_no", _parts("_head").alias("_names"), F.posexplode(_parts("line")).alias("_at", "value"))
    header = F.get("_names", F.col("_at"))
    return cells.where(header.isNotNull()).select(key, F.col("line_no").alias("row_no"), (F.col("_at") + 1).alias("column_no"), header.alias("header"), "value")


def delimited_issues(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, row_no, column_no, reason, header, value): what delimited_cells leaves out of the same texts.

    A surplus_cell has its value and no header, a missing_cell (the line ends before it) its header and no value; a
    blank_line has neither and no column. With the cells, every cell of a delimited text stands in one of the two.
    """
    at, names, parts = F.col("_at"), F.size("_names"), F.size("_parts")
    rows = _table_lines(df, key, text).where(F.col("_blank") | (F.col("line_no") > F.col("_first")))
    rows = rows.select(key, "line_no", "_blank", _parts("_head").alias("_names"), _parts("line").alias("_parts"))
    blank = rows.where("_blank").select(key, F.col("line_no").alias("row_no"), F.lit(None).cast("int").alias("column_no"), F.lit("blank_line").alias("reason"), F.lit(None).cast("string").alias("header"), F.lit(None).cast("string").alias("value"))
    other = rows.where(~F.col("_blank") & (names != parts)).select(key, "line_no", "_names", "_parts", F.explode(F.sequence(F.least(names, parts), F.greatest(names, parts) - 1)).alias("_at"))
    reason = F.when(at >= names, "surplus_cell").otherwise("missing_cell")
    return other.select(key, F.col("line_no").alias("row_no"), (at + 1).alias("column_no"), reason.alias("reason"), F.get("_names", at).alias("header"), F.get("_parts", at).alias("value")).unionByName(blank)


def fragments(df: DataFrame, key: str, text: str, size: int = 1600) -> DataFrame:
    """Rows (key, fragment_no, previous_no, next_no, n_chars, fragment): a text in order, in pieces of at most size characters."""
    n = F.ceil(F.length(text) / F.lit(size)).cast("int")
    rows = df.where(F.length(text) > 0).select(key, text, n.alias("_n"), F.explode(F.sequence(F.lit(1), n)).alias("fragment_no"))
    piece = F.substring(F.col(text), (F.col("fragment_no") - 1) * size + 1, F.lit(size))
    return rows.select(
        key,
        "fragment_no",
        F.when(F.col("fragment_no") > 1, F.col("fragment_no") - 1).alias("previous_no"),
        F.when(F.col("fragment_no") < F.col("_n"), F.col("fragment_no") + 1).alias("next_no"),
        F.length(piece).alias("n_chars"),
        piece.alias("fragment"),
    )


def search_lines(df: DataFrame, key: str, text: str, needle: str, first: int = 25) -> tuple[DataFrame, DataFrame]:
    """Two frames: totals (scanned, null_texts, chars, matching_lines, matching_texts) and the first matches (key, line_no).

    The totals cover all texts whatever first is. Upper and lower case are alike.
    """
    hits = text_lines(df, key, text).where(F.contains(F.lower("line"), F.lit(needle.lower())))
    lower = F.lower(F.col(text))
    found = F.contains(lower, F.lit(needle.lower()))
    matching = F.size(F.filter(_lines(text), lambda x: F.contains(F.lower(x), F.lit(needle.lower()))))
    totals = df.agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count(F.when(F.col(text).isNull(), 1)).alias("null_texts"),
        F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars"),
        F.coalesce(F.sum(F.when(found, matching)), F.lit(0)).alias("matching_lines"),
        F.count(F.when(found, 1)).alias("matching_texts"),
    )
    return totals, hits.select(key, "line_no").orderBy(key, "line_no").limit(first)


def title_matches(df: DataFrame, title: str, query: str) -> DataFrame:
    """Rows whose title has every word of the query as a word, without case."""
    words = F.split(F.lower(F.col(title)), r"[^\p{L}\p{N}]+")
    wanted = sorted({w for w in re.findall(r"[^\W_]+", query.lower())})
    return df.where(F.size(F.array_except(F.array(*map(F.lit, wanted)), words)) == 0)


# Patterns of identifiers and of instructions to a reader that is a program.
IDENTIFIERS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "phone": r"\+[0-9][0-9 ()-]{7,16}[0-9]",
    "exact_date": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|\b[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}\b",
    "long_number": r"\b[0-9]{9,}\b",
    "record_number": r"(?i)\b(mrn|record no|patient id)[ :#]*[0-9]{4,}",
    "local_path": r"(/home/|/Users/|[A-Z]:\\)[^ \n]+",
}
INSTRUCTIONS = {
    "ignore_previous": r"(?i)\b(ignore|disregard)\b.{0,40}\b(previous|above|prior)\b.{0,20}\binstructions?\b",
    "role_change": r"(?i)\byou are now\b|\bact as\b.{0,20}\bassistant\b",
    "reveal": r"(?i)\b(reveal|print|show)\b.{0,30}\b(system prompt|hidden prompt)\b",
}

# Letters in lower case without which a pattern above can't match.
NEEDED = {"email": ["@"], "phone": ["+"], "record_number": ["mrn", "record no", "patient id"], "local_path": ["/home/", "/users/", ":\\"], "ignore_previous": ["instruction"], "role_change": ["you are now", "act as"], "reveal": ["prompt"]}


def finding_counts(df: DataFrame, key: str, text: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """Rows (key, kind, n) of texts that match a pattern, for each kind how often.

    A pattern runs only over texts that have the letters it needs.
    """
    kinds = patterns or (IDENTIFIERS | INSTRUCTIONS)

    def count(kind: str, pattern: str) -> Column:
        found = F.regexp_count(F.col(text), F.lit(pattern))
        if patterns or kind not in NEEDED:
            return found
        may = None
        for x in NEEDED[kind]:
            one = F.contains(F.col("_lower"), F.lit(x))
            may = one if may is None else may | one
        return F.when(may, found).otherwise(0)

    counts = F.array(*(F.struct(F.lit(k).alias("kind"), count(k, p).alias("n")) for k, p in kinds.items()))
    rows = df.where(F.col(text).isNotNull()).select(key, text, F.lower(text).alias("_lower"))
    return rows.select(key, F.inline(F.filter(counts, lambda x: x["n"] > 0)))


def merged_spans(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans with those that overlap joined, their kinds with + between; spans that only touch stay apart."""
    out: list[list] = []
    for a, b, kind in sorted(spans):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
            out[-1][2].add(kind)
        else:
            out.append([a, b, {kind}])
    return [(a, b, "+".join(sorted(k))) for a, b, k in out]


REDACTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_spans", T.IntegerType()), T.StructField("kinds", T.ArrayType(T.StringType()))])


def redacted(text: Column, patterns: dict[str, str] | None = None) -> Column:
    """A struct (text, n_spans, kinds): a text with each identifier replaced by [REMOVED:kind]. Null stays null."""
    compiled = {k: re.compile(p) for k, p in (patterns or IDENTIFIERS).items()}

    @F.pandas_udf(REDACTED)
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for t in s:
                if t is None:
                    rows.append((None, None, None))
                    continue
                spans = merged_spans([(*m.span(), k) for k, p in compiled.items() for m in p.finditer(t)])
                out, at = [], 0
                for a, b, kind in spans:
                    out += [t[at:a], f"[REMOVED:{kind}]"]
                    at = b
                rows.append(("".join([*out, t[at:]]), len(spans), sorted({k for *_, kinds in spans for k in kinds.split("+")})))
            yield pd.DataFrame(rows, columns=REDACTED.names)

    return redact(text)


def csv_safe(value: Column) -> Column:
    """A cell that a spreadsheet doesn't take for a formula: a leading = + - @ tab or line end gets an apostrophe."""
    return F.when(value.rlike(r"^[=+\-@\t\r\n]"), F.concat(F.lit("'"), value)).otherwise(value)


def search_term(concepts: Column, outcomes: Column) -> Column:
    """A boolean search term: all concepts in parentheses, joined by AND, then any of the outcomes."""
    term = F.array_join(F.transform(concepts, lambda c: F.concat(F.lit("("), c, F.lit(")"))), " AND ")
    other = F.when(F.size(outcomes) > 0, F.concat(F.lit("("), F.array_join(outcomes, " OR "), F.lit(")")))
    return F.concat_ws(" AND ", F.when(term != "", term), other)
