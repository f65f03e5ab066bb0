import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from quillspark.operators.guidelines import canonical_status, canonical_version
from quillspark.operators.history import neighbours, report_history, running, snapshot_history

SCHEMA = "id string, at timestamp, seq bigint, a string, b string, _period string, valid_to string"


def brute(rows):
    checks = {}
    for i, at, seq, a, b, *_ in rows:
        if i is not None and at is not None and (seq if seq is not None else -(2**63)) >= checks.get((i, at), (-(2**63),))[0]:
            checks[i, at] = (seq if seq is not None else -(2**63), a, b)
    out, last = [], {}
    for (i, at), (_, a, b) in sorted(checks.items()):
        b = b if b is not None else last.get(i, (None, None))[1]
        if i not in last or last[i] != (a, b):
            out.append([i, at, None, a, b])
        last[i] = (a, b)
    for x, y in zip(out, out[1:], strict=False):
        if x[0] == y[0]:
            x[2] = y[1]
    return sorted(map(tuple, out), key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = report_history(df, "id", "at", "seq", ["a", "b"], carry=["b"])
    return sorted(((r.id, r.valid_from, r.valid_to, r.a, r.b) for r in out.collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for seq in range(1200):
        key = rng.choice(["hot"] * 5 + ["x", "y", "z", None])
        at = rng.choice([None] + [datetime(2024, 1, 1) + timedelta(days=rng.randrange(300), hours=rng.randrange(3))] * 20)
        rows.append((key, at, seq, rng.choice(["1", "2", None]), rng.choice(["p", "q", None]), "clash", "clash"))
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    t = datetime(2024, 1, 1)
    assert run(spark, [(None, t, 1, "1", "p", "", "")]) == []
    one = [("k", t, 1, None, None, "", ""), ("k", t, 1, None, None, "", "")]
    assert run(spark, one) == [("k", t, None, None, None)]
    long = [("k", t, 1, "x" * 100_000, "p", "", ""), ("k", t + timedelta(days=1), 2, "x" * 100_000, None, "", "")]
    assert len(run(spark, long)) == 1
    assert report_history(spark.createDataFrame([], SCHEMA), "id", "at", "seq", ["a", "b"]).count() == 0


def test_comes_back(spark):
    t = [datetime(2024, 1, d) for d in (1, 9, 17)]
    out = run(spark, [("k", t[0], 1, "1", "p", "", ""), ("k", t[1], 2, "2", "p", "", ""), ("k", t[2], 3, "1", None, "", "")])
    assert set(out) == {("k", t[0], t[1], "1", "p"), ("k", t[1], t[2], "2", "p"), ("k", t[2], None, "1", "p")}


def test_neighbours_cross_periods(spark):
    rows = [("k", datetime(2024, 1, 1) + timedelta(days=7 * i)) for i in range(30)]
    got = neighbours(spark.createDataFrame(rows, "k string, at timestamp"), "k", "at").orderBy("at").collect()
    assert [r._before for r in got] == [None, *(t for _, t in rows[:-1])] and [r._after for r in got] == [*(t for _, t in rows[1:]), None]


def test_whole_snapshots(spark):
    d = [date(2024, 1, i) for i in (1, 2, 3, 4)]
    rows = [("a", d[0], "x"), ("a", d[1], "x"), ("a", d[3], "x"), ("b", d[0], None), ("b", d[1], "y"), ("b", d[2], "y"), ("b", d[3], "y"), (None, d[2], "z"), ("b", d[3], "y"), ("c", None, "q")]
    out = snapshot_history(spark.createDataFrame(rows, "k string, on date, v string"), "k", "on", ["v"])
    got = {(r.k, r.valid_from, r.valid_to, r.event, r.v) for r in out.collect()}
    assert got == {("a", d[0], d[2], "inserted", "x"), ("a", d[3], None, "inserted", "x"), ("b", d[0], d[1], "inserted", None), ("b", d[1], None, "changed", "y"), (None, d[2], d[3], "inserted", "z")}


def test_meanings(spark):
    df = spark.createDataFrame([(" Ver 2021.1 ", "Not-Yet-Effective"), ("V.2021.2-F1", " ACTIVE"), ("", " "), (None, None)], "v string, s string")
    got = df.select(canonical_version(F.col("v")), canonical_status(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("2021.1", "not_yet_effective"), ("2021.2-f1", "active"), (None, None), (None, None)]


def test_plan_of_report_history(spark):
    """What is compared is dealt by (key, period) once; the rest of the plan exchanges checks, events and one row a period."""
    rows = [("k", datetime(2024, 1, 1) + timedelta(days=i), i, str(i % 3), None, "", "") for i in range(60)]
    out = report_history(spark.createDataFrame(rows, SCHEMA), "id", "at", "seq", ["a", "b"], carry=["b"])
    assert out.count() == 60
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert 0 < plan.count("Exchange hashpartitioning") <= 10 and "ArrowEvalPython" not in plan


def test_running_in_buckets(spark):
    """Sums and numbers over a hot key are the same as over one sorted list, with nulls, ties of buckets and a null key."""
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 4 + ["x", None]), i if i % 50 else None, rng.choice([1, 2, None])) for i in rng.sample(range(2000), 900)]
    got = {}
    for r in running(spark.createDataFrame(rows, "k string, o int, v int"), ["k"], ["o"], F.col("v"), "s").collect():
        got.setdefault(r.k, []).append((r.o, r.s))
    for k, found in got.items():
        total = sum(v or 0 for kk, o, v in rows if kk == k and o is None)
        for o, s in sorted((x for x in found if x[0] is not None)):
            total += sum(v or 0 for kk, oo, v in rows if kk == k and oo == o)
            assert (s or 0) == total
    assert sum(map(len, got.values())) == len(rows)
