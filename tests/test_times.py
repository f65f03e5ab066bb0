from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.operators.times import day_in_zone, local_to_utc, normal_time, parse_times, shape_mask, with_normal_time, zone_table, zone_transitions


def norm(text, zone="Europe/Berlin", order="DMY"):
    value = parse_times(pd.Series([text], dtype=object), pd.Series([zone], dtype=object), pd.Series([order], dtype=object)).norm[0]
    return None if pd.isna(value) else value


CASES = {
    "2024-10-02T10:43:31+05:30": "2024-10-02T05:13:31Z", "2024-10-02T10:43:31.999Z": "2024-10-02T10:43:31Z", "20251001T085926Z": "2025-10-01T08:59:26Z",
    "18-AUG-23": "2023-08-18", "18-AUG-71": "1971-08-18", "Tue, 27 Jul 2021 04:33:02 +0530": "2021-07-26T23:03:02Z", "28.11.2024 13:31:01 GMT+05:30": "2024-11-28T08:01:01Z", "10.04.2018 14:33:00 GMT-05:00": "2018-04-10T19:33:00Z",
    "23 марта 2023 г.": "2023-03-23", "17 de abril de 2023": "2023-04-17", "9. Februar 2022, 11:26 Uhr": "2022-02-09T10:26:00Z", "11. Juni 2022, 17:25 Uhr": "2022-06-11T15:25:00Z", "3. März 2022": "2022-03-03",
    "Sep 1, 2023 at 8:49 am": "2023-09-01T06:49:00Z", "Sep 1, 2023 at 12:00 am": "2023-08-31T22:00:00Z", "20/04/2021 3:06 PM": "2021-04-20T13:06:00Z", "11-Sep-2022 10:50 AEST": "2022-09-11T00:50:00Z",
    "1689543268": "2023-07-16T21:34:28Z", "1644793173076": "2022-02-13T22:59:33Z", "2024-W09-4": "2024-02-29", "2020-W53-7": "2021-01-03", "2024-366": "2024-12-31", "2019 Jan": "2019-01", "June 2021": "2021-06", "07/2023": "2023-07", "2023-07": "2023-07", "2023": "2023",
    "05/08/2021": "2021-08-05", "2/2/2025": "2025-02-02", "  2023-01-07  17:39 ": "2023-01-07T16:39:00Z", "2024/02/29": "2024-02-29", "20240229": "2024-02-29",
}
NONE = ["", " ", None, "2023-02-29", "2021-366", "2019-W53-1", "31.02.2023", "00/00/0000", "0000-00-00", "2022-13-04", "13/13/2023", "??.05.2023", "2020 Dec-Jan", "Winter 2019", "yesterday", "n.d.", "25:00", "2024-01-01 24:00", "2024-01-01 10:60", "13/01/2024 13:00 PM", "2021-10-31 02:50", "2024-03-31 02:30", "2024-01-01 10:00 XYZ", "x" * 100_000, "9" * 5000]


@pytest.mark.parametrize("text", CASES)
def test_notations(text):
    assert norm(text) == CASES[text]


@pytest.mark.parametrize("text", NONE)
def test_no_determined_meaning(text):
    assert norm(text) is None


def test_order_and_zone():
    assert norm("05/08/2021", order="MDY") == "2021-05-08"
    assert norm("05/08/2021", order=None) is None
    assert norm("23/08/2021", order="MDY") is None
    assert norm("2021-10-31 02:50", "Asia/Tokyo") == "2021-10-30T17:50:00Z"
    assert norm("2021-10-31 02:50", "Nowhere/Land") is None
    assert norm("2021-10-31 02:50", None) is None
    assert norm("2021-10-31", None) == "2021-10-31"
    assert norm("2021-10-31 02:50 CET") == "2021-10-31T01:50:00Z"


@settings(max_examples=200, deadline=None)
@given(st.datetimes(datetime(1972, 1, 1), datetime(2090, 1, 1)), st.sampled_from(["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kathmandu", "America/Bogota"]))
def test_local_times_against_zoneinfo(local, zone):
    local = local.replace(microsecond=0, second=0)
    z = ZoneInfo(zone)
    instants = {local.replace(tzinfo=z, fold=f).astimezone(timezone.utc) for f in (0, 1)}
    real = {t for t in instants if t.astimezone(z).replace(tzinfo=None) == local}
    want = next(iter(real)).strftime("%Y-%m-%dT%H:%M:%SZ") if len(real) == 1 else None
    assert norm(local.strftime("%Y-%m-%d %H:%M"), zone) == want


def test_gap_and_overlap_vectorised():
    table = zone_transitions("America/New_York")
    base = int(datetime(2024, 3, 10, tzinfo=timezone.utc).timestamp())
    _, ok = local_to_utc(np.array([base + 3600, base + 2 * 3600 + 60, base + 3 * 3600]), table)
    assert ok.tolist() == [True, False, True]
    autumn = int((datetime(2024, 11, 3) - datetime(1970, 1, 1)) / timedelta(seconds=1))
    assert local_to_utc(np.array([autumn + 3600 + 60, autumn + 2 * 3600]), table)[1].tolist() == [False, True]


def test_masks_keep_places():
    assert shape_mask("12. März 2024") == "99. aaaa 9999"


def test_in_spark(spark):
    rows = [(i, t, "Europe/Berlin", "DMY", "extra") for i, t in enumerate([*CASES, *NONE[:20], *CASES])]
    df = spark.createDataFrame(rows, "i int, text string, zone string, o string, time_norm string")
    out = with_normal_time(df, F.col("text"), F.col("zone"), F.col("o"))
    assert out.columns == df.columns
    assert [r.time_norm for r in out.orderBy("i").collect()] == [*CASES.values(), *[None] * 20, *CASES.values()]
    assert with_normal_time(df.limit(0), F.col("text"), F.col("zone"), F.col("o")).count() == 0
    nothing = spark.createDataFrame([(None, None, None)], "text string, zone string, o string")
    assert with_normal_time(nothing, F.col("text"), F.col("zone"), F.col("o")).first().time_norm is None


def test_days_and_tables(spark):
    df = spark.createDataFrame([("2021-11-13T23:00:00Z", "Europe/Berlin"), ("2021-11-14", "Asia/Tokyo"), ("2021", "Asia/Tokyo"), ("x", "Asia/Tokyo")], "t string, z string")
    time = normal_time(F.col("t"), F.col("z"), F.lit("DMY"))
    assert [r[0] for r in df.withColumn("n", time).select(day_in_zone(F.col("n"), F.col("z"))).collect()] == ["2021-11-14", "2021-11-14", None, None]
    table = zone_table(spark, ["Europe/Berlin", "No/Zone"])
    assert table.where("offset_s not in (3600, 7200, 10800, 3208)").count() == 0 and table.select("version").distinct().count() == 1


def test_changes_close_together():
    """Two changes within two weeks that cancel are both read."""
    at, off = zone_transitions("America/Argentina/Tucuman")
    june = [(datetime.fromtimestamp(int(t), timezone.utc).strftime("%Y-%m-%d"), int(o)) for t, o in zip(at, off, strict=True)]
    assert ("2004-06-01", -14400) in june and ("2004-06-13", -10800) in june
    local = [int((datetime(2004, 6, d) - datetime(1970, 1, 1)).total_seconds()) for d in (7, 20)]
    assert (np.array(local) - local_to_utc(np.array(local), (at, off))[0]).tolist() == [-14400, -10800]
