"""Delimited laboratory tables as rows, and everything that is no sure row as issues with their source cells."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.numbers import missing_reason, result_kind

# Headers of laboratory tables, by field.
ALIASES = {
    "analyte_raw": ["analyte", "analyte_raw", "test", "name", "показатель", "анализ", "наименование"],
    "result": ["result", "value", "результат", "значение"],
    "unit_raw": ["unit", "units", "unit_raw", "единица", "единицы", "ед. изм.", "единицы измерения"],
    "reference": ["reference", "ref", "range", "reference_interval", "референс", "референсы", "норма", "референсные значения"],
    "clinical_time": ["date", "clinical_date", "collected", "performed", "reported", "дата", "дата забора", "дата исследования", "дата отчета", "дата отчёта"],
    "specimen": ["specimen", "биоматериал", "образец"],
    "method": ["method", "метод"],
    "lab_flag_raw": ["flag", "флаг"],
}
FIELD_OF = {name: field for field, names in ALIASES.items() for name in names}
# Headers of columns that hold an earlier result.
PRIOR = re.compile(r"(?i)previous|prior|предыдущ|\d{2}\.\d{2}|\d{4}-\d{2}")
csv.field_size_limit(2**31 - 1)

CELL = T.StructType([T.StructField(c, t) for c, t in (("column_no", T.IntegerType()), ("header", T.StringType()), ("role", T.StringType()), ("value", T.StringType()))])
LINE = T.StructType([
    T.StructField("row_no", T.IntegerType()), T.StructField("line_start", T.IntegerType()), T.StructField("line_end", T.IntegerType()),
    T.StructField("reason", T.StringType()), T.StructField("cells", T.ArrayType(CELL)),
])


def read_table(text: str) -> list[tuple]:
    """The rows (row_no, line_start, line_end, reason, cells) of one text.

    The separator is the one of tab, semicolon and comma that the first line has most of. Row 1 is the header. reason is
    set where the whole row stays out: no_separator, no_analyte_or_result, ambiguous_columns (the header, with all
    lines after it), shape_mismatch, broken_quotes. Rows without any text are left out.
    """
    lines = text.splitlines()
    first = lines[0] if lines else ""
    mark = max("\t;,", key=first.count)
    whole = lambda reason: [(1, 1, max(1, len(lines)), reason, [(None, None, "unresolved", text)])]
    if mark not in first:
        return whole("no_separator")
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=mark, strict=True)
    out, last, number = [], 0, 0
    try:
        head = next(reader)
        fields = [FIELD_OF.get(h.strip().casefold()) for h in head]
        named = [f for f in fields if f]
        if len(set(named)) < len(named):
            return whole("ambiguous_columns")
        if not {"analyte_raw", "result"} <= set(named):
            return whole("no_analyte_or_result")
        last = reader.line_num
        for number, values in enumerate(reader, 2):
            start, last = last + 1, reader.line_num
            if not any(v.strip() for v in values):
                continue
            cells = []
            for i, v in enumerate(values):
                label = head[i] if i < len(head) else None
                role = fields[i] if i < len(head) and fields[i] else "prior_result" if label and PRIOR.search(label) else "unknown_column"
                cells.append((i + 1, label, role, v))
            out.append((number, start, last, None if len(values) == len(head) else "shape_mismatch", cells))
    except csv.Error:
        rest = "\n".join(lines[last:])
        out.append((number + 1, last + 1, max(last + 1, len(lines)), "broken_quotes", [(None, None, "unresolved", rest)]))
    return out


@F.pandas_udf(T.ArrayType(LINE))
def _read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([read_table(t) for t in s], dtype=object)


def _lines(df: DataFrame, key: str, text: str) -> DataFrame:
    rows = df.where(F.length(F.trim(text)) > 0).select(key, F.inline(_read(F.col(text))))
    value = lambda f: F.get(F.filter("cells", lambda c: c["role"] == f), F.lit(0))["value"]
    rows = rows.withColumns({f: F.when(F.col("reason").isNull() & (F.trim(value(f)) != ""), F.trim(value(f))) for f in ALIASES if f != "result"}).withColumn("result", F.when(F.col("reason").isNull(), value("result")))
    extra = F.filter("cells", lambda c: c["role"].isin("prior_result", "unknown_column") & (F.trim(c["value"]) != ""))
    kind = result_kind(F.col("result"))
    missing = F.trim(F.coalesce("result", F.lit(""))) == ""
    reasons = F.when(F.col("reason").isNotNull(), F.array("reason")).otherwise(F.array_compact(F.array(
        F.when(F.col("analyte_raw").isNull(), "analyte_missing"), F.when(missing, "missing_result"), F.when(~missing & (kind == "text_unparsed"), "result_unparsed"),
        F.when(F.size(extra) > 0, F.when(F.forall(extra, lambda c: c["role"] == "prior_result"), "prior_result_unresolved").otherwise("unmapped_source_column")),
    )))
    sure = F.col("reason").isNull() & F.col("analyte_raw").isNotNull() & ~missing
    return rows.withColumns({"result_kind": F.when(sure, kind), "missing": missing_reason(F.col("result")), "reasons": reasons, "sure": sure})


def import_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, row_no, line_start, line_end, fields, result_kind) of the delimited tables in texts.

    A row needs an analyte and a result; one with reservations is a row and stands in import_issues as well. Quoted cells
    may span lines. Null and empty texts give nothing; texts of any length are read whole.
    """
    rows = _lines(df, key, text).where("sure")
    return rows.select(key, "row_no", "line_start", "line_end", *ALIASES, "result_kind")


def import_issues(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, row_no, line_start, line_end, is_row, reasons, cells): all source cells of rows that raise an issue.

    Every cell of a table that has any text is in a row of import_rows or here; texts that are no table come whole.
    """
    rows = _lines(df, key, text).where(F.size("reasons") > 0)
    return rows.select(key, "row_no", "line_start", "line_end", F.col("sure").alias("is_row"), "reasons", "cells")
