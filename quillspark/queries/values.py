"""Queries of the numeric, temporal, log, set and graph operators, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import guidance as G
from quillspark.operators import logs as L
from quillspark.operators import numbers as N
from quillspark.operators import periods as P
from quillspark.operators import sets as S
from quillspark.operators.graphs import cyclic_nodes, greedy_cover, superseded
from quillspark.operators.guidelines import canonical_status, canonical_version
from quillspark.operators.history import snapshot_history
from quillspark.session import table

AS_OF = "2024-06-30"


def day(c) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


# ---- numbers -----------------------------------------------------------------------------------------------------------------


def numeric_tokens(spark, d):
    token = N.numeric_token(F.col("value"))
    rows = table(spark, d, "ingest").select("row_id", N.comparator_name(token["comparator"]).alias("comparator"), token["number"].alias("number")).where("number is not null")
    return rows.select("row_id", F.coalesce("comparator", F.lit("")).alias("comparator"), "number")


def result_kinds(spark, d):
    return table(spark, d, "private_answers").select("seq", N.result_kind(F.col("result.raw")).alias("kind"))


def interval_relations(spark, d):
    limits = {"1-URGENT": (50_000.0, 250_000.0), "2-HIGH": (None, 200_000.0), "3-MEDIUM": (100_000.0, None)}
    of = lambda i: F.coalesce(*(F.when(F.col("o_orderpriority") == p, F.lit(v[i])) for p, v in limits.items() if v[i] is not None))
    rows = table(spark, d, "orders").select("o_orderkey", N.interval_relation(F.col("o_totalprice"), of(0), of(1), high_inclusive=False).alias("relation"))
    return rows.groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


def listed_conversion(spark, d):
    rules = spark.createDataFrame([(1, "dozen", "1"), (2, "piece", "12"), (3, "gross", "0.25")], "unit int, target_unit string, factor string").withColumn("factor", F.col("factor").cast("decimal(6,2)"))
    rows = table(spark, d, "lineitem").withColumn("quantity", F.col("l_quantity").cast("decimal(12,0)"))
    out = N.convert_listed(rows, "quantity", "l_linenumber", rules)
    return out.groupBy("l_linenumber", "conversion").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("converted") * 100).cast("bigint")), F.lit(0)).alias("hundredths"))


def first_to_last(spark, d):
    """Exact change from the first to the last order of each customer, in cents and thousandths of a percent."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    place = F.struct("o_orderdate", "o_orderkey")
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by(cents, place).alias("a"), F.max_by(cents, place).alias("b"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return rows.select("o_custkey", (F.col("b") - F.col("a")).alias("delta"), F.floor((F.col("b") - F.col("a")) * 100_000 / F.col("a")).cast("bigint").alias("percent_milli"))


def exact_percents(spark, d):
    rows = table(spark, d, "part").groupBy("p_brand").agg(F.min(F.col("p_retailprice").cast("decimal(12,2)")).cast("string").alias("a"), F.max(F.col("p_retailprice").cast("decimal(12,2)")).cast("string").alias("b"))
    return rows.select("p_brand", N.exact_delta("a", "b").alias("delta"), N.exact_percent("a", "b").alias("percent"))


# ---- time --------------------------------------------------------------------------------------------------------------------


def precise_orders(spark, d) -> DataFrame:
    """Orders whose date is known to the year, the month or the day, or not at all, by their key."""
    k = F.pmod("o_orderkey", F.lit(4))
    norm = F.when(k == 0, F.date_format("o_orderdate", "yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM")).when(k == 2, day("o_orderdate"))
    low, high = P.bounds(F.col("norm"))
    return table(spark, d, "orders").select("o_orderkey", norm.alias("norm")).withColumns({"low": low, "high": high})


def time_bounds(spark, d):
    return precise_orders(spark, d).select("o_orderkey", F.coalesce(day("low"), F.lit("")).alias("low"), F.coalesce(day("high"), F.lit("")).alias("high"))


def overlap_history(spark, d):
    kept, unknown = P.split_by_overlap(precise_orders(spark, d), "low", "high", F.to_date(F.lit("1996-03-10")), F.to_date(F.lit("1996-04-20")))
    return kept.select("o_orderkey", F.lit("kept").alias("part")).unionByName(unknown.select("o_orderkey", F.lit("unknown_time").alias("part")))


def check_freshness(spark, d):
    rows = table(spark, d, "guideline_documents").groupBy("document_id").agg(F.max("last_checked_at").alias("at"))
    f = P.freshness(F.col("at"), F.to_date(F.lit(AS_OF)), 180)
    return rows.select("document_id", f["age_days"], f["stale"].cast("int").alias("stale"))


def status_by_date(spark, d):
    status = P.status_on(F.to_date(F.lit(AS_OF)), F.col("published_on"), F.col("effective_until"), F.col("withdrawn_on"))
    return table(spark, d, "guideline_documents").select("seq", status.alias("status"))


def known_documents(spark, d):
    docs = table(spark, d, "guideline_documents")
    return G.known_on(docs, "document_id", "seq", "recorded_at", "2024-06-30 00:00:00", ["declared_status"]).select("document_id", "seq", F.coalesce(canonical_status(F.col("declared_status")), F.lit("")).alias("status"))


def daily_history(spark, d):
    """History of each user's last event type, from a snapshot a day of the events."""
    events = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    snapshots = events.groupBy("user_id", "day").agg(F.max_by("event_type", "event_id").alias("event_type"))
    rows = snapshot_history(snapshots, "user_id", "day", ["event_type"])
    return rows.select("user_id", day("valid_from").alias("valid_from"), F.coalesce(day("valid_to"), F.lit("")).alias("valid_to"), "event", "event_type")


# ---- logs --------------------------------------------------------------------------------------------------------------------


def latest_events(spark, d):
    return L.latest(table(spark, d, "events"), ["user_id"], "event_id", ["event_type"])


def latest_by_trust(spark, d):
    answers = table(spark, d, "private_answers").withColumn("trusted", (F.col("mapping_status") == "confirmed").cast("int"))
    return L.latest(answers, ["subject_id", "trusted"], "seq", ["claim_id"], F.col("recorded_at") <= F.to_timestamp(F.lit("2024-01-01 00:00:00")))


def document_versions(spark, d):
    docs = table(spark, d, "guideline_documents").withColumn("version", canonical_version(F.col("version")))
    return L.version_numbers(docs, "document_id", "version", "seq")


def chain_breaks(spark, d):
    """Lines of imports held against the line before: the last digit of the import is taken as the token handed on."""
    rows = table(spark, d, "ingest").groupBy("import_id", "line_no").agg(F.max("row_id").alias("row_id"))
    rows = rows.select("import_id", "line_no", F.pmod("row_id", F.lit(7)).alias("token"), F.when(F.col("line_no") > 1, F.pmod(F.col("row_id") - 1, F.lit(7))).alias("previous"))
    return L.chain_breaks(rows, "import_id", "line_no", "token", "previous")


def order_chronology(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), 20).alias("b"))
    return L.chronology(rows, "o_custkey", "a", "b").select("o_custkey", "n", F.col("ordered").cast("int").alias("ordered"))


def import_budget(spark, d):
    rows = table(spark, d, "ingest").select("import_id", "row_id", F.length(F.coalesce("value", F.lit(""))).alias("size"))
    out = L.over_budget(rows, "import_id", "row_id", "size", 120)
    return out.groupBy("import_id").agg(F.max("running").alias("total"), F.sum(F.col("over").cast("int")).alias("n_over"))


def one_to_one_pairs(spark, d):
    lines = table(spark, d, "lineitem")
    old, new = (lines.where(F.col("l_returnflag") == f).select("l_partkey", F.col("l_orderkey").alias(n)) for f, n in (("A", "old_id"), ("N", "new_id")))
    return L.one_to_one(old, new, ["l_partkey"], "old_id", "new_id")


def shared_sources(spark, d):
    return L.source_conflicts(table(spark, d, "ingest"), "site_id", "item", "import_id")


def opposed_groups(spark, d):
    rows = table(spark, d, "lineitem").withColumn("direction", F.when(F.col("l_returnflag") == "R", "against").when(F.col("l_returnflag") == "A", "for").otherwise("conditional"))
    return L.opposed(rows, ["l_partkey", "l_suppkey"], "direction", "l_linestatus")


def relative_days(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("on"))
    return L.relative_days(rows, "o_custkey", "on").select("o_orderkey", "relative_day")


def days_before_latest(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("on"))
    return L.relative_days(rows, "o_custkey", "on").select("o_orderkey", "days_before_latest")


def review_counts(spark, d):
    """States of users by their latest event, and whether they sum to all of them."""
    state = F.when(F.col("event_type") == "purchase", "reviewed").when(F.col("event_type") == "error", "rejected").otherwise("unreviewed")
    return latest_events(spark, d).groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


# ---- sets --------------------------------------------------------------------------------------------------------------------


def key_difference(spark, d):
    answers = table(spark, d, "private_answers")
    a, b = (answers.where(F.col("mapping_status") == s).select("analyte_key") for s in ("confirmed", "proposed"))
    return S.set_difference(a, b, ["analyte_key"])


def group_counts(spark, d):
    return S.group_digests(table(spark, d, "orders"), ["o_orderpriority"], ["o_orderkey", "o_custkey"]).select("o_orderpriority", "n")


def group_digests(spark, d):
    return S.group_digests(table(spark, d, "orders"), ["o_orderpriority"], ["o_orderkey", "o_custkey"])


def tree_changes(spark, d):
    orders = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    side = lambda y: orders.where(F.col("y") == y).groupBy("o_custkey").agg(F.max("o_orderpriority").alias("content"))
    return S.tree_changes(side(1996), side(1997), "o_custkey", "content").groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("keys"))


def manifest_status(spark, d):
    docs = table(spark, d, "guideline_documents").groupBy("document_id").agg(*(f("canonical_url", "seq").alias(n) for f, n in ((F.min_by, "path"), (F.max_by, "path2"))), F.min_by("version", "seq").alias("v"), F.max_by("version", "seq").alias("v2"))
    manifest = docs.select("document_id", "path", canonical_version(F.col("v")).alias("digest"))
    files = docs.select("document_id", F.col("path2").alias("path"), canonical_version(F.col("v2")).alias("digest"))
    return S.manifest_status(manifest, files, "document_id", "path", "digest")


def dangling_keys(spark, d):
    t = lambda n: table(spark, d, n)
    links = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("ingest", "site_id", "source_sites", "site_id"), ("private_answers", "analyte_key", "analyte_catalog", "analyte_key")]
    out = None
    for c, fk, p, pk in links:
        row = S.dangling(t(c), fk, t(p), pk, f"{c}.{fk}")
        out = row if out is None else out.unionByName(row)
    return out


def prefix_breaks(spark, d):
    events = table(spark, d, "events")
    changed = events.withColumn("event_type", F.when(F.pmod("event_id", F.lit(97)) == 0, "other").otherwise(F.col("event_type")))
    return S.prefix_breaks(events, changed, "event_id", ["user_id", "event_type"])


def broken_rules(spark, d):
    rules = {"unit_missing": F.trim(F.coalesce("unit", F.lit(""))) != "", "value_missing": F.trim(F.coalesce("value", F.lit(""))) != "", "item_missing": F.col("item").isNotNull(), "late": F.col("received_at") < F.to_timestamp(F.lit("2026-01-01 00:00:00"))}
    return table(spark, d, "ingest").select(F.array_join(S.violated(rules), ",").alias("rules")).groupBy("rules").agg(F.count(F.lit(1)).alias("n"))


# ---- guidance and ranking ------------------------------------------------------------------------------------------------------


def supersession(spark, d):
    edges = table(spark, d, "version_relations").select(F.col("source_document_id").alias("source"), F.col("target_document_id").alias("target"), F.col("relation_type").alias("relation"), "effective_from")
    edges = edges.where(F.col("effective_from") <= F.to_date(F.lit(AS_OF)))
    return superseded(edges, edges.where("relation = 'supersedes'").select("target"))


def cycles(spark, d):
    """Nodes on cycles among the relations and, for some of them, their reverse."""
    edges = table(spark, d, "version_relations").select(F.col("source_document_id").alias("source"), F.col("target_document_id").alias("target"))
    back = edges.where(F.col("source").endswith("7")).select(F.col("target").alias("source"), F.col("source").alias("target"))
    return cyclic_nodes(edges.unionByName(back))


def ranked_evidence(spark, d):
    return G.ranked_evidence(table(spark, d, "evidence_snapshot"), "evidence_id", F.coalesce("study_design", "source_type"), F.col("published_at"), 100)


def evidence_page(spark, d):
    return G.page_after(table(spark, d, "evidence_snapshot").select("snapshot_id", "evidence_id"), "snapshot_id", "es-00000100", 50)


def recent_orders(spark, d):
    """The last 20 orders of all, oldest first."""
    rows = table(spark, d, "orders").select("o_orderkey", day("o_orderdate").alias("order_day"))
    return rows.orderBy(F.desc("order_day"), F.desc("o_orderkey")).limit(20).orderBy("order_day", "o_orderkey")


def allowed_hosts(spark, d):
    ok = G.allowed_host(F.col("url"), ["taspama.example", "resolve.example"])
    return table(spark, d, "scientific_source").where("url is not null").groupBy(ok.cast("int").alias("allowed")).agg(F.count(F.lit(1)).alias("n"))


def jurisdiction_filter(spark, d):
    return table(spark, d, "guideline_documents").where(G.applies(F.col("jurisdictions"), "US")).select("seq")


def source_cover(spark, d):
    """Sites of laboratories chosen to cover all zones and decimal marks."""
    sites = table(spark, d, "source_sites").where("site_kind = 'laboratory'")
    scopes = sites.select("site_id", F.explode(F.array("timezone", F.concat_ws("/", "timezone", "decimal_mark"))).alias("scope"), F.substring("site_id", 6, 3).cast("int").alias("priority"))
    return spark.createDataFrame(greedy_cover(scopes, "site_id", "scope", "priority"), "site_id string, priority int")


QUERIES = {
    f.__name__: f
    for f in (
        numeric_tokens, result_kinds, interval_relations, listed_conversion, first_to_last, exact_percents, time_bounds, overlap_history, check_freshness, status_by_date, known_documents, daily_history,
        latest_events, latest_by_trust, document_versions, chain_breaks, order_chronology, import_budget, one_to_one_pairs, shared_sources, opposed_groups, relative_days, days_before_latest, review_counts,
        key_difference, group_counts, group_digests, tree_changes, manifest_status, dangling_keys, prefix_breaks, broken_rules,
        supersession, cycles, ranked_evidence, evidence_page, recent_orders, allowed_hosts, jurisdiction_filter, source_cover,
    )
}

_VERSION = r"nullif(regexp_replace(regexp_replace(lower({0}), '[\s ]+', '', 'g'), '^(version|vers|ver|v)[.:]?([0-9])', '\2'), '')"
_STATUS = r"nullif(replace(trim(regexp_replace(lower({0}), '[\s _-]+', ' ', 'g')), ' ', '_'), '')"
_ACTIVE = "CASE WHEN published_on > DATE '2024-06-30' THEN 'not_yet_effective' WHEN withdrawn_on <= DATE '2024-06-30' THEN 'withdrawn' WHEN effective_until < DATE '2024-06-30' THEN 'superseded' ELSE 'active' END"
_NORM = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') END"
_BOUNDS = f"""SELECT o_orderkey, CASE length({_NORM}) WHEN 4 THEN date_trunc('year', o_orderdate) WHEN 7 THEN date_trunc('month', o_orderdate) WHEN 10 THEN o_orderdate END::DATE AS low,
    CASE length({_NORM}) WHEN 4 THEN date_trunc('year', o_orderdate) + INTERVAL 1 YEAR - INTERVAL 1 DAY WHEN 7 THEN last_day(o_orderdate) WHEN 10 THEN o_orderdate END::DATE AS high FROM orders"""
_CLOSURE = """
    seed AS (SELECT DISTINCT target AS node FROM e WHERE relation = 'supersedes'),
    gone AS (SELECT node FROM seed UNION SELECT CASE WHEN e.source = g.node THEN e.target ELSE e.source END FROM gone g JOIN e ON e.source = g.node OR (e.target = g.node AND e.relation IN ('amends', 'focused_update')))"""
_EDGES = "SELECT source_document_id AS source, target_document_id AS target, relation_type AS relation FROM version_relations WHERE effective_from <= DATE '2024-06-30' AND source_document_id IS NOT NULL AND target_document_id IS NOT NULL"
_WEIGHT = """CASE WHEN k IN ('clinical_guideline', 'guideline') THEN 100 WHEN k IN ('systematic_review', 'systematic review', 'meta_analysis', 'meta-analysis') THEN 90
    WHEN k IN ('randomized_trial', 'randomised trial', 'randomized_controlled_trial', 'cluster trial', 'crossover trial') THEN 80 WHEN k IN ('cohort', 'cohort study', 'diagnostic_accuracy', 'diagnostic accuracy study', 'registry analysis') THEN 65
    WHEN k IN ('case_control', 'case-control study') THEN 55 WHEN k IN ('cross_sectional', 'cross-sectional survey') THEN 45 WHEN k IN ('narrative_review', 'narrative review') THEN 35 WHEN k = 'journal_article' THEN 30 ELSE 0 END"""

SQL = {
    "numeric_tokens": rf"""
        SELECT row_id, CASE regexp_extract(value, '{N.TOKEN}', 1) WHEN '<' THEN 'lt' WHEN '<=' THEN 'le' WHEN '≤' THEN 'le' WHEN '>' THEN 'gt' WHEN '>=' THEN 'ge' WHEN '≥' THEN 'ge' ELSE '' END AS comparator,
        replace(replace(regexp_extract(value, '{N.TOKEN}', 2), ',', '.'), '−', '-') AS number FROM ingest WHERE regexp_matches(value, '{N.TOKEN}')""",
    "result_kinds": r"""
        WITH t AS (SELECT seq, lower(trim(coalesce(result.raw, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')) AS t FROM private_answers),
        n AS (SELECT *, regexp_extract(t, '^(<=|>=|<|>|=|≤|≥)?\s*[-+−]?([0-9]+([.,][0-9]+)?|[.,][0-9]+)(e[-+]?[0-9]{1,3})?$', 1) AS sign, regexp_full_match(t, '(<=|>=|<|>|=|≤|≥)?\s*[-+−]?([0-9]+([.,][0-9]+)?|[.,][0-9]+)(e[-+]?[0-9]{1,3})?') AS numeric FROM t)
        SELECT seq, CASE WHEN t IN ('', 'материал непригоден', 'invalid specimen', 'отменён', 'отменен', 'cancelled') THEN 'no_result' WHEN numeric AND sign IN ('', '=') THEN 'numeric_exact' WHEN numeric THEN 'numeric_censored'
        WHEN t IN ('не обнаружено', 'обнаружено', 'положительный', 'отрицательный', 'positive', 'negative', 'detected', 'not detected') THEN 'qualitative' WHEN regexp_full_match(t, '\+{1,4}|[0-9]+:[0-9]+') THEN 'semiquantitative' ELSE 'text_unparsed' END AS kind FROM n""",
    "interval_relations": """
        WITH r AS (SELECT o_orderkey, o_totalprice AS v, CASE o_orderpriority WHEN '1-URGENT' THEN 50000 WHEN '3-MEDIUM' THEN 100000 END AS lo, CASE o_orderpriority WHEN '1-URGENT' THEN 250000 WHEN '2-HIGH' THEN 200000 END AS hi FROM orders),
        c AS (SELECT o_orderkey, CASE WHEN v IS NULL OR (lo IS NULL AND hi IS NULL) THEN 'indeterminate' WHEN v < lo THEN 'below' WHEN v >= hi THEN 'above' ELSE 'within' END AS relation FROM r)
        SELECT relation, count(*) AS n, sum(o_orderkey) AS keys FROM c GROUP BY relation""",
    "listed_conversion": """
        SELECT l_linenumber, CASE WHEN l_linenumber IN (1, 2, 3) THEN 'listed' ELSE 'not_listed' END AS conversion, count(*) AS n,
        coalesce(sum(CASE l_linenumber WHEN 1 THEN l_quantity * 100 WHEN 2 THEN l_quantity * 1200 WHEN 3 THEN l_quantity * 25 END), 0)::BIGINT AS hundredths FROM lineitem GROUP BY l_linenumber""",
    "first_to_last": """
        WITH c AS (SELECT o_custkey, first(round(o_totalprice * 100)::BIGINT ORDER BY o_orderdate, o_orderkey) AS a, last(round(o_totalprice * 100)::BIGINT ORDER BY o_orderdate, o_orderkey) AS b, count(*) AS n FROM orders GROUP BY o_custkey)
        SELECT o_custkey, b - a AS delta, floor((b - a) * 100000 / a)::BIGINT AS percent_milli FROM c WHERE n >= 2""",
    "time_bounds": f"SELECT o_orderkey, coalesce(strftime(low, '%Y-%m-%d'), '') AS low, coalesce(strftime(high, '%Y-%m-%d'), '') AS high FROM ({_BOUNDS})",
    "overlap_history": f"""
        SELECT o_orderkey, CASE WHEN low IS NULL THEN 'unknown_time' ELSE 'kept' END AS part FROM ({_BOUNDS}) WHERE low IS NULL OR (high >= DATE '1996-03-10' AND low <= DATE '1996-04-20')""",
    "check_freshness": """
        WITH a AS (SELECT document_id, date_diff('day', (max(last_checked_at) AT TIME ZONE 'UTC')::DATE, DATE '2024-06-30') AS age FROM guideline_documents GROUP BY document_id)
        SELECT document_id, greatest(age, 0) AS age_days, (age IS NULL OR age < 0 OR age > 180)::INT AS stale FROM a""",
    "status_by_date": f"SELECT seq, {_ACTIVE} AS status FROM guideline_documents",
    "known_documents": f"""
        WITH r AS (SELECT document_id, max(seq) AS seq, arg_max(coalesce(declared_status, ''), seq) AS s FROM guideline_documents WHERE recorded_at <= TIMESTAMPTZ '2024-06-30 00:00:00+00' GROUP BY document_id)
        SELECT document_id, seq, coalesce({_STATUS.format("s")}, '') AS status FROM r""",
    "daily_history": """
        WITH s AS (SELECT user_id, ts::DATE AS day, arg_max(event_type, event_id) AS event_type FROM events GROUP BY ALL),
        t AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM (SELECT DISTINCT day FROM s)),
        m AS (SELECT s.*, t.n FROM s JOIN t USING (day)),
        e AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, b.n + 1) AS n, CASE WHEN a.n IS NULL THEN 'deleted' WHEN b.n IS NULL THEN 'inserted' WHEN a.event_type IS DISTINCT FROM b.event_type THEN 'changed' END AS event, a.event_type
              FROM m a FULL JOIN m b ON a.user_id = b.user_id AND a.n = b.n + 1),
        v AS (SELECT user_id, t.day AS valid_from, event, event_type, lead(t.day) OVER (PARTITION BY user_id ORDER BY t.day) AS valid_to FROM e JOIN t USING (n) WHERE event IS NOT NULL)
        SELECT user_id, strftime(valid_from, '%Y-%m-%d') AS valid_from, coalesce(strftime(valid_to, '%Y-%m-%d'), '') AS valid_to, event, event_type FROM v WHERE event <> 'deleted'""",
    "latest_events": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "latest_by_trust": """
        SELECT subject_id, coalesce(mapping_status = 'confirmed', false)::INT AS trusted, max(seq) AS seq, arg_max(claim_id, seq) AS claim_id FROM private_answers WHERE recorded_at <= TIMESTAMPTZ '2024-01-01 00:00:00+00' GROUP BY ALL""",
    "document_versions": f"""
        WITH f AS (SELECT document_id, {_VERSION.format("version")} AS version, min(seq) AS first_seen FROM guideline_documents GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY first_seen) AS version_no FROM f""",
    "chain_breaks": """
        WITH r AS (SELECT import_id, line_no, max(row_id) AS row_id FROM ingest GROUP BY ALL), c AS (SELECT import_id, line_no, row_id % 7 AS token, CASE WHEN line_no > 1 THEN (row_id - 1) % 7 END AS previous FROM r),
        j AS (SELECT c.*, b.line_no AS s, b.token AS t FROM c LEFT JOIN c b ON c.import_id = b.import_id AND c.line_no = b.line_no + 1)
        SELECT * FROM (SELECT import_id, line_no, CASE WHEN line_no = 1 AND previous IS NOT NULL THEN 'first_has_predecessor' WHEN line_no > 1 AND s IS NULL THEN 'gap' WHEN line_no > 1 AND previous IS DISTINCT FROM t THEN 'wrong_predecessor' END AS reason FROM j) WHERE reason IS NOT NULL""",
    "order_chronology": """
        WITH p AS (SELECT o_custkey, o_orderdate::DATE AS a, o_orderdate::DATE + 20 AS b FROM orders), l AS (SELECT *, lag(b) OVER (PARTITION BY o_custkey ORDER BY a, b) AS last FROM p)
        SELECT o_custkey, count(*) AS n, (NOT bool_or(coalesce(last >= a, false)))::INT AS ordered FROM l GROUP BY o_custkey""",
    "import_budget": """
        WITH r AS (SELECT import_id, sum(length(coalesce(value, ''))) OVER (PARTITION BY import_id ORDER BY row_id) AS running FROM ingest)
        SELECT import_id, max(running)::BIGINT AS total, sum((running > 120)::INT)::BIGINT AS n_over FROM r GROUP BY import_id""",
    "one_to_one_pairs": """
        SELECT l_partkey, a.id AS old_id, b.id AS new_id FROM (SELECT l_partkey, min(l_orderkey) AS id FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_partkey HAVING count(*) = 1) a
        JOIN (SELECT l_partkey, min(l_orderkey) AS id FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_partkey HAVING count(*) = 1) b USING (l_partkey)""",
    "shared_sources": "SELECT site_id, item, count(DISTINCT coalesce(import_id, '~')) AS n_sources FROM ingest GROUP BY ALL HAVING count(DISTINCT coalesce(import_id, '~')) >= 2",
    "opposed_groups": """
        WITH g AS (SELECT l_partkey, l_suppkey, count(*) AS n, bool_or(l_returnflag = 'R') AS a, bool_or(l_returnflag <> 'R') AS f, count(DISTINCT l_linestatus) AS p FROM lineitem GROUP BY ALL HAVING count(*) >= 2)
        SELECT l_partkey, l_suppkey, 'direction' AS kind, n FROM g WHERE a AND f UNION ALL SELECT l_partkey, l_suppkey, 'position', n FROM g WHERE p > 1""",
    "relative_days": "SELECT o_orderkey, -date_diff('day', o_orderdate::DATE, max(o_orderdate::DATE) OVER (PARTITION BY o_custkey)) AS relative_day FROM orders",
    "days_before_latest": "SELECT o_orderkey, date_diff('day', o_orderdate::DATE, max(o_orderdate::DATE) OVER (PARTITION BY o_custkey)) AS days_before_latest FROM orders",
    "review_counts": """
        WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS e FROM events GROUP BY user_id)
        SELECT CASE e WHEN 'purchase' THEN 'reviewed' WHEN 'error' THEN 'rejected' ELSE 'unreviewed' END AS state, count(*) AS n FROM l GROUP BY 1""",
    "key_difference": """
        WITH a AS (SELECT analyte_key AS k, count(*) AS n FROM private_answers WHERE mapping_status = 'confirmed' GROUP BY 1), b AS (SELECT analyte_key AS k, count(*) AS n FROM private_answers WHERE mapping_status = 'proposed' GROUP BY 1)
        SELECT coalesce(a.k, b.k) AS analyte_key, CASE WHEN b.n IS NULL THEN 'only_left' WHEN a.n IS NULL THEN 'only_right' ELSE 'unequal' END AS side, coalesce(a.n, b.n) AS n FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k WHERE a.n IS DISTINCT FROM b.n""",
    "group_counts": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1",
    "tree_changes": """
        WITH a AS (SELECT o_custkey AS k, max(o_orderpriority) AS c FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_orderpriority) AS c FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1),
        j AS (SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'insert' WHEN b.k IS NULL THEN 'tombstone' WHEN a.c IS NOT DISTINCT FROM b.c THEN 'unchanged' ELSE 'new_version' END AS action FROM a FULL JOIN b ON a.k = b.k)
        SELECT action, count(*) AS n, sum(k)::BIGINT AS keys FROM j GROUP BY 1""",
    "manifest_status": f"""
        WITH g AS (SELECT document_id, arg_min(canonical_url, seq) AS p, arg_max(canonical_url, seq) AS p2, arg_min(version, seq) AS v, arg_max(version, seq) AS v2 FROM guideline_documents GROUP BY 1)
        SELECT document_id, CASE WHEN {_VERSION.format("v2")} IS NULL THEN 'unsafe_or_missing' WHEN {_VERSION.format("v")} <> {_VERSION.format("v2")} THEN 'modified' WHEN p <> p2 THEN 'path_changed' ELSE 'ok' END AS status FROM g""",
    "dangling_keys": " UNION ALL ".join(
        f"SELECT '{c}.{fk}' AS link, count({fk}) AS n_rows, count(*) FILTER ({fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} p WHERE p.{pk} = c.{fk})) AS n_dangling FROM {c} c"
        for c, fk, p, pk in [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("ingest", "site_id", "source_sites", "site_id"), ("private_answers", "analyte_key", "analyte_catalog", "analyte_key")]
    ),
    "prefix_breaks": "SELECT event_id FROM events WHERE event_id % 97 = 0 AND event_type IS DISTINCT FROM 'other'",
    "broken_rules": """
        WITH r AS (SELECT array_to_string(list_filter([CASE WHEN item IS NULL THEN 'item_missing' END, CASE WHEN NOT coalesce(received_at < TIMESTAMPTZ '2026-01-01 00:00:00+00', false) THEN 'late' END, CASE WHEN trim(coalesce(unit, ''), ' ') = '' THEN 'unit_missing' END, CASE WHEN trim(coalesce(value, ''), ' ') = '' THEN 'value_missing' END], lambda x: x IS NOT NULL), ',') AS rules FROM ingest)
        SELECT rules, count(*) AS n FROM r GROUP BY rules""",
    "supersession": f"WITH RECURSIVE e AS ({_EDGES}), {_CLOSURE} SELECT node FROM gone",
    "cycles": """
        WITH RECURSIVE v AS (SELECT DISTINCT source_document_id AS s, target_document_id AS t FROM version_relations WHERE source_document_id IS NOT NULL AND target_document_id IS NOT NULL), e AS (SELECT s, t FROM v UNION SELECT t, s FROM v WHERE s LIKE '%7'),
        reach AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM reach r JOIN e ON r.t = e.s), c AS (SELECT s AS node FROM reach WHERE s = t),
        before AS (SELECT DISTINCT r.s AS node FROM reach r JOIN c ON r.t = c.node), after AS (SELECT DISTINCT r.t AS node FROM reach r JOIN c ON r.s = c.node)
        SELECT node FROM before INTERSECT SELECT node FROM after""",
    "ranked_evidence": f"""
        SELECT DISTINCT evidence_id, {_WEIGHT} AS weight, CASE WHEN regexp_full_match(published_at[1:4], '[0-9]{{4}}') THEN published_at[1:4]::INT ELSE 0 END AS year FROM (SELECT *, lower(coalesce(study_design, source_type)) AS k FROM evidence_snapshot) ORDER BY weight DESC, year DESC, evidence_id LIMIT 100""",
    "evidence_page": "SELECT snapshot_id, evidence_id FROM evidence_snapshot WHERE snapshot_id > 'es-00000100' ORDER BY snapshot_id LIMIT 51",
    "recent_orders": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_day FROM orders ORDER BY o_orderdate::DATE DESC, o_orderkey DESC LIMIT 20",
    "allowed_hosts": r"""
        WITH h AS (SELECT lower(regexp_extract(url, '^https://([^/:?#@\s]+)(?:[/?#]|$)', 1)) AS h FROM scientific_source WHERE url IS NOT NULL)
        SELECT (h IN ('taspama.example', 'resolve.example') OR h LIKE '%.taspama.example' OR h LIKE '%.resolve.example')::INT AS allowed, count(*) AS n FROM h GROUP BY 1""",
    "jurisdiction_filter": "SELECT seq FROM guideline_documents WHERE list_has_any(jurisdictions, ['US', 'GLOBAL'])",
}
