from datetime import date

from pyspark.sql import functions as F

from quillspark.operators import guidance as G
from quillspark.operators import observations as O

DAY = date(2024, 1, 1)


def test_history(spark):
    """Latest trusted and untrusted apart; a relation replaces one for one and leaves ambiguous rows."""
    rows = [
        (1, "s", "o1", "v0", True, "k", "t"), (2, "s", "o1", "v0", True, "k", "t"), (3, "s", "o1", "v0", False, "k", "t"), (4, "s", "o2", "v1", True, "k", "t"),
        (5, "s", "o3", "v0", True, "m", None), (6, "s", "o4", "v1", True, "m", None), (7, "s", "o5", "v1", True, "m", None), (8, "r", "o6", "v0", True, "k", "t"), (9, None, "o7", "v0", True, "k", "t"),
    ]
    rev = spark.createDataFrame(rows, "seq int, subject string, obs string, version string, trusted boolean, k string, t string")
    rel = spark.createDataFrame([("s", "v0", "v1", "revision_of")], "subject string, old_version string, new_version string, relation string")
    run = lambda a, b: {r.seq: (r.status, r.replaced_by) for r in O.history(a, b, "subject", "obs", "seq", "version", "trusted", ["k", "t"]).collect()}
    got = run(rev, rel)
    assert got == {1: ("revised", None), 2: ("revision_of", 4), 3: ("contextual", None), 4: ("current", None), 5: ("current", None), 6: ("current", None), 7: ("current", None), 8: ("current", None), 9: ("current", None)}
    assert run(rev, rel.limit(0))[2] == ("current", None) and run(rev.limit(0), rel) == {}
    both = O.version_conflicts(rev.where("seq in (2, 4, 5)"), "subject", ["k"], ["k", "t"], "version", "seq")
    assert sorted((r.seq, r.n_versions, r.n_revisions) for r in both.collect()) == [(2, 2, 2), (4, 2, 2)]


def test_comparison(spark):
    facts = "trusted boolean, current boolean, conflicting boolean, strict boolean, key string, mapping_status string, specimen string, unit string, kind string"
    good = (True, True, False, True, "k", "confirmed", "serum", "mg/L", "numeric_exact")
    rows = [(1, good), (2, good), (3, (*good[:7], "g/L", "numeric_exact")), (4, (*good[:6], None, "mg/L", "numeric_censored")), (5, (False, *good[1:3], False, *good[4:])), (6, (*good[:7], None, "no_result"))]
    df = spark.createDataFrame([("g", n, f) for n, f in rows], f"g string, n int, f struct<{facts.replace(' ', ':').replace(',:', ',')}>")
    got = {r.n: (r.category, r.reasons) for r in O.compared(df, ["g"], F.col("n"), F.col("f"), "n").collect()}
    assert got[1] == got[2] == ("included", []) and got[3] == ("excluded", ["unit_conversion_rule_not_supported"]) and got[4] == ("contextual", ["specimen_unknown"])
    assert got[5] == ("contextual", ["clinical_time_not_exact_collection_or_performance", "not_user_confirmed"]) and got[6] == ("excluded", ["different_result_scale", "no_result"])
    n = spark.createDataFrame([("a", 1, "0.1"), ("a", 2, None), ("a", 3, "0.3"), ("b", 1, "5"), ("c", 1, "0"), ("c", 2, "1")], "g string, n int, x string")
    assert sorted((r.g, r.n, r.delta, r.percent) for r in O.changes(n, ["g"], F.col("n"), "x").collect()) == [("a", 2, "0.2", "200"), ("c", 2, "1", None)]


def test_recommendations(spark):
    """An update replaces keys it holds; a successor counts once it has started; own jurisdictions come first."""
    docs = [("base", "s", DAY, None, None), ("update", "s", DAY, None, date(2024, 5, 1)), ("empty", "s", DAY, None, None), ("other", "z", DAY, None, None), ("next", "s", date(2030, 1, 1), None, None)]
    states = spark.createDataFrame([(*d, ["EU"]) for d in docs], "document_id string, series_id string, effective_from date, effective_until date, withdrawn_on date, jurisdictions array<string>")
    rel = [("update", "base", "amends", DAY, ["k1"]), ("empty", "base", "amends", DAY, ["k2"]), ("other", "base", "focused_update", DAY, ["k3"]), ("next", "base", "supersedes", DAY, [])]
    relations = spark.createDataFrame(rel, "source_document_id string, target_document_id string, relation_type string, effective_from date, affected_recommendation_keys array<string>")
    recs = [("base", k, None, None, None) for k in ("k1", "k2", "k3")] + [("base", "late", date(2024, 9, 1), None, None), ("base", "over", None, date(2024, 2, 1), None), ("base", "us", None, None, ["US"]), ("update", "k1", None, None, None), ("other", "k3", None, None, ["GLOBAL"])]
    recommendations = spark.createDataFrame(recs, "document_id string, recommendation_key string, applies_from date, applies_until date, jurisdictions array<string>")
    run = lambda day: sorted((r.document_id, r.recommendation_key) for r in G.recommendations_in_force(states, recommendations, relations, day, "EU").collect())
    assert run("2024-03-01") == [("base", "k2"), ("base", "k3"), ("other", "k3"), ("update", "k1")]
    assert run("2024-06-30") == [("base", "k2"), ("base", "k3"), ("other", "k3")]  # the shadow stays when the update is withdrawn
    assert {r.document_id: r.status for r in G.in_force(states, relations, "2024-06-30", "EU").collect()}["base"] == "active"
    assert G.recommendations_in_force(states.limit(0), recommendations, relations, "2024-06-30", "EU").count() == 0


def test_pages(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 0)], "t string, i int")
    first = G.page(df, ["t", "i"], None, 4).collect()
    assert [r.i for r in first] == [0, 1, 2, 3] and all(r.more for r in first)
    last = G.page(df, ["t", "i"], ("a", 3), 4).collect()
    assert [(r.t, r.i, r.more) for r in last] == [("a", 4, False), ("b", 0, False)] and G.page(df, ["t", "i"], ("b", 0), 4).count() == 0


def test_reused(spark):
    known = spark.createDataFrame([("s", "p1", "a"), ("s", "p1", "a"), ("s", "p2", "a"), ("s", "p2", "b"), ("s", None, "c")], "s string, place string, name string")
    drafts = spark.createDataFrame([(1, "s", "p1"), (2, "s", "p2"), (3, "s", "p3"), (4, "s", None)], "d int, s string, place string")
    got = {r.d: (r.name, r.status) for r in O.reused_identities(drafts, known, "s", "place", "d", "name").collect()}
    assert got == {1: ("a", "reused"), 2: (None, "ambiguous"), 3: (None, "new"), 4: (None, "new")}
