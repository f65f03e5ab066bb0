from pyspark.sql import functions as F

from quillspark.operators import tables as TB


def test_intervals(spark):
    texts = {"3,5 - 5.1": ("3.5", "5.1", True, True), "< 5": (None, "5", None, False), "≤5,0": (None, "5.0", None, True), ">= 7": ("7", None, True, None), "> 7": ("7", None, False, None), "-1 to 1": ("-1", "1", True, True), "normal": (None,) * 4, "": (None,) * 4, None: (None,) * 4}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(*(c.alias(n) for n, c in TB.reference_interval(F.col("t")).items())).collect()
    assert [tuple(r) for r in got] == list(texts.values())


def test_headers(spark):
    rows = [(1, 1, "Analyte"), (1, 2, " Result: "), (1, 3, "UNIT"), (1, 4, "Laboratory  reference interval"), (1, 5, "note"), (2, 1, "Test"), (2, 2, "Value"), (2, 3, "Result"), (2, 4, None)]
    df = spark.createDataFrame(rows, "k int, n int, h string")
    got = sorted(tuple(r) for r in TB.field_columns(df, "k", "n", "h").collect())
    assert got == [(1, "analyte_raw", 1, "known"), (1, "reference", 4, "known"), (1, "result", 2, "known"), (1, "unit_raw", 3, "known"), (2, "analyte_raw", 1, "known"), (2, "result", 2, "ambiguous")]


def test_extractors(spark):
    registry = spark.createDataFrame([("text", 1, ["text/*"], ["blocks"]), ("csv", 5, ["text/csv"], ["blocks", "tables"]), ("any", 0, ["*/*"], [])], "extractor_id string, priority int, patterns array<string>, capabilities array<string>")
    df = spark.createDataFrame([(1, "text/csv", ["tables"]), (2, "text/plain", ["blocks"]), (3, "text/plain", ["tables"]), (4, "image/png", []), (5, "image/png", None), (6, None, ["tables"])], "k int, t string, n array<string>")
    got = {r.k: r.extractor_id for r in TB.chosen_extractors(df, "k", "t", "n", registry).collect()}
    assert got == {1: "csv", 2: "text", 3: None, 4: "any", 5: "any", 6: None}
