"""Queries of histories of observations and of recommendations in force, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import guidance as G
from quillspark.operators import logs as L
from quillspark.operators import observations as O
from quillspark.operators import periods as P
from quillspark.operators.guidelines import canonical_status, canonical_withdrawal
from quillspark.operators.times import normal_time
from quillspark.queries import times_sql
from quillspark.session import table

AS_OF = "2024-06-30"
KEY = ["identity", "at"]


def revisions(spark: SparkSession, d: str) -> DataFrame:
    """Typed answers as revisions: a claim delivered in an odd and an even row comes from two versions of a document."""
    a = table(spark, d, "private_answers")
    odd = F.pmod("seq", F.lit(2)).cast("string")
    return a.select(
        "seq", "subject_id", F.concat_ws("/", "claim_id", odd).alias("observation"), F.concat(F.lit("v"), odd).alias("version"), (F.col("mapping_status") == "confirmed").alias("trusted"),
        O.identity(F.col("mapping_status"), F.col("analyte_key"), F.col("analyte_raw")).alias("identity"), F.col("clinical_time.raw").alias("at"), "mapping_status", "analyte_key", "specimen",
        "unit_raw", F.col("result.kind").alias("kind"), F.col("clinical_time.role").alias("role"), F.col("clinical_time.precision").alias("precision"), F.col("clinical_time.value").alias("value"), "site_id", "recorded_at",
    ).withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def relations(spark: SparkSession, d: str) -> DataFrame:
    """For every second subject, the odd version replaces the even one."""
    subjects = table(spark, d, "private_answers").select("subject_id").where("subject_id is not null").distinct().where(F.pmod(F.ascii(F.substring("subject_id", -1, 1)), F.lit(2)) == 0)
    return subjects.select("subject_id", F.lit("v0").alias("old_version"), F.lit("v1").alias("new_version"), F.lit("replaces").alias("relation"))


def _history(spark, d) -> DataFrame:
    return O.history(revisions(spark, d), relations(spark, d), "subject_id", "observation", "seq", "version", "trusted", KEY)


def history_rows(spark, d):
    return _history(spark, d).select("seq", "status", F.coalesce("replaced_by", F.lit(0)).alias("replaced_by"))


def _current(spark, d) -> DataFrame:
    return revisions(spark, d).join(_history(spark, d).where("status = 'current'").select("seq"), "seq", "left_semi")


def history_conflicts(spark, d):
    rows = _current(spark, d).withColumn("document", F.lit("d"))
    return O.version_conflicts(rows, "subject_id", ["document", "site_id"], KEY, "version", "seq")


def comparisons(spark, d):
    """Each subject's answers on a confirmed analyte held against the first recorded one."""
    rows = revisions(spark, d).where("trusted").join(_history(spark, d).select("seq", "status"), "seq")
    known = O.field_known(F.col("value"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("trusted"))
    facts = F.struct(
        "trusted", (F.col("status") == "current").alias("current"), F.lit(False).alias("conflicting"), O.strict_time(known, F.col("role"), F.col("precision")).alias("strict"),
        F.col("analyte_key").alias("key"), "mapping_status", "specimen", F.col("unit_raw").alias("unit"), "kind",
    )
    out = O.compared(rows, ["subject_id", "analyte_key"], F.struct("recorded_at", "seq"), facts, "seq")
    return out.select("seq", "category", F.array_join("reasons", ",").alias("reasons"))


def value_changes(spark, d):
    """Exact change of the largest to the smallest order of a day's first and last for each customer, as decimal texts."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.col("o_totalprice").cast("decimal(14,2)").cast("string").alias("price"))
    return O.changes(rows, ["o_custkey"], F.struct("o_orderdate", "o_orderkey"), "price").select("o_custkey", "n", F.col("delta").cast("decimal(14,2)").cast("string").alias("delta"))


def history_page(spark, d):
    """The first 200 answers of all in the order of a history: unknown clinical times last."""
    norm = F.when(F.col("precision") == "date", F.col("value"))
    low, high = P.bounds(norm)
    rows = revisions(spark, d).select("seq", O.history_order(low, high, F.col("recorded_at"), F.col("seq")).alias("place"))
    return rows.orderBy("place").limit(200).select("seq", F.col("place.low").alias("low"), F.col("place.high").alias("high"))


def reused_claims(spark, d):
    """Claims of the rows recorded later taken over from the earlier ones with the same text in the same place."""
    a = table(spark, d, "private_answers").where("subject_id is not null").withColumn("place", F.concat_ws("|", "site_id", "analyte_raw", "clinical_time.raw"))
    return O.reused_identities(a.where("seq % 5 = 0"), a.where("seq % 5 > 0"), "subject_id", "place", "seq", "claim_id").select("seq", F.coalesce("claim_id", F.lit("")).alias("claim_id"), "status")


# ---- guidance ------------------------------------------------------------------------------------------------------------------


def states(spark: SparkSession, d: str) -> DataFrame:
    """The latest report of each document with the first day of its effective_from (else of publication) as a date."""
    rows = L.latest(table(spark, d, "guideline_documents"), ["document_id"], "seq", ["series_id", "issuer", "published_on", "effective_from", "effective_until", "withdrawn_on", "declared_status", "last_checked_at", "jurisdictions"])
    sites = table(spark, d, "source_sites").groupBy(F.col("site_name").alias("issuer")).agg(F.min("timezone").alias("_zone"), F.min("date_order").alias("_order"))
    rows = rows.join(sites, "issuer", "left").withColumn("_norm", normal_time(F.col("effective_from"), F.col("_zone"), F.col("_order"))["norm"])
    low, _ = P.bounds(F.col("_norm"))
    return rows.select(
        "document_id", "series_id", F.coalesce(low, "published_on").alias("effective_from"), "effective_until", canonical_withdrawal(F.col("withdrawn_on")).alias("withdrawn_on"),
        canonical_status(F.col("declared_status")).alias("declared_status"), F.to_date("last_checked_at").alias("status_changed_on"), "jurisdictions",
    )


def guidance_in_force(spark, d):
    return G.in_force(states(spark, d), table(spark, d, "version_relations"), AS_OF, "EU")


def recommendations(spark: SparkSession, d: str) -> DataFrame:
    """Recommendations for every key that a relation names, on both of its documents; days and direction by the key's number."""
    r = table(spark, d, "version_relations")
    keys = r.select(F.explode(F.array("source_document_id", "target_document_id")).alias("document_id"), F.explode("affected_recommendation_keys").alias("recommendation_key")).where("document_id is not null").distinct()
    n = F.substring("recommendation_key", 4, 3).cast("int")
    k = F.substring("document_id", -1, 1).cast("int")
    return keys.select(
        "document_id", "recommendation_key", F.concat_ws("/", "document_id", "recommendation_key").alias("recommendation_id"), F.pmod(n, F.lit(20)).alias("decision_key"),
        F.when(n % 4 == 0, F.to_date(F.lit("2023-06-01"))).alias("applies_from"), F.when(n % 9 == 0, F.to_date(F.lit("2024-01-31"))).alias("applies_until"),
        F.when(n % 5 == 0, F.array(F.lit("EU"))).when(n % 7 == 0, F.array(F.lit("US"))).alias("jurisdictions"),
        F.when(k % 3 == 0, "against").when(k % 3 == 1, "for").otherwise("conditional").alias("direction"), F.when(k % 2 == 0, "low").otherwise("high").alias("position_key"),
    )


def _in_force(spark, d) -> DataFrame:
    return G.recommendations_in_force(states(spark, d), recommendations(spark, d), table(spark, d, "version_relations"), AS_OF, "EU")


def recommendations_in_force(spark, d):
    return _in_force(spark, d).select("document_id", "recommendation_key")


def recommendation_conflicts(spark, d):
    return G.contradictions(_in_force(spark, d), ["decision_key"], "recommendation_id", "direction", "position_key").select("decision_key", "kind", "recommendation_id")


def evidence_pages(spark, d):
    """A page of evidence after a cursor of two keys, with whether more follows."""
    rows = table(spark, d, "evidence_snapshot").where("source_type is not null").select("source_type", "snapshot_id")
    return G.page(rows, ["source_type", "snapshot_id"], ("guideline", "es-00000300"), 40).select("source_type", "snapshot_id", F.col("more").cast("int").alias("more"))


QUERIES = {
    f.__name__: f
    for f in (history_rows, history_conflicts, comparisons, value_changes, history_page, reused_claims, guidance_in_force, recommendations_in_force, recommendation_conflicts, evidence_pages)
}

_REV = """
    a AS (SELECT seq, subject_id, claim_id || '/' || (seq % 2) AS obs, 'v' || (seq % 2) AS version, coalesce(mapping_status = 'confirmed', false) AS trusted,
          CASE WHEN mapping_status = 'confirmed' AND analyte_key <> '' THEN analyte_key ELSE 'raw:' || analyte_raw END AS identity, clinical_time.raw AS tm, * EXCLUDE (seq, subject_id) FROM private_answers),
    k AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY subject_id, obs, trusted ORDER BY seq DESC) = 1),
    c AS (SELECT * FROM k WHERE trusted),
    g AS (SELECT subject_id, identity, tm, count(*) FILTER (version = 'v0') AS n0, count(*) FILTER (version = 'v1') AS n1, min(seq) FILTER (version = 'v0') AS q0, min(seq) FILTER (version = 'v1') AS q1
          FROM c WHERE subject_id IS NOT NULL AND ascii(right(subject_id, 1)) % 2 = 0 GROUP BY ALL HAVING n0 = 1 AND n1 = 1),
    h AS (SELECT a.seq, CASE WHEN g.q0 IS NOT NULL THEN 'replaces' WHEN k.trusted THEN 'current' WHEN k.seq IS NOT NULL THEN 'contextual' ELSE 'revised' END AS status, coalesce(g.q1, 0) AS replaced_by
          FROM a LEFT JOIN k ON a.seq = k.seq LEFT JOIN g ON a.seq = g.q0)"""

_GUIDE = f"""
    tt AS ({times_sql.P4}),
    l AS (SELECT * FROM guideline_documents QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY seq DESC) = 1),
    st AS (SELECT document_id, series_id, jurisdictions, effective_until, CASE WHEN year(withdrawn_on) < 9999 THEN withdrawn_on END AS withdrawn_on,
           replace(trim(regexp_replace(lower(declared_status), '[\\s\\x{{00a0}}_-]+', ' ', 'g')), ' ', '_') AS declared, (last_checked_at AT TIME ZONE 'UTC')::DATE AS changed,
           coalesce(CASE length(time_norm) WHEN 4 THEN (time_norm || '-01-01')::DATE WHEN 7 THEN (time_norm || '-01')::DATE ELSE time_norm[1:10]::DATE END, published_on) AS eff
           FROM l LEFT JOIN (SELECT seq, time_norm FROM tt WHERE table_name = 'guideline_documents') t USING (seq)),
    d AS (SELECT *, CASE WHEN eff > DATE '2024-06-30' THEN 'not_yet_effective' WHEN withdrawn_on <= DATE '2024-06-30' THEN 'withdrawn' WHEN effective_until < DATE '2024-06-30' THEN 'superseded'
          WHEN changed <= DATE '2024-06-30' AND declared IN ('superseded', 'withdrawn') THEN declared ELSE 'active' END AS status FROM st WHERE list_has_any(jurisdictions, ['EU', 'GLOBAL'])),
    e AS (SELECT source_document_id AS source, target_document_id AS target, relation_type AS relation FROM version_relations
          WHERE effective_from <= DATE '2024-06-30' AND source_document_id IN (SELECT document_id FROM d) AND target_document_id IN (SELECT document_id FROM d)),
    seed AS (SELECT DISTINCT target AS node FROM e JOIN d ON e.source = d.document_id WHERE relation = 'supersedes' AND eff <= DATE '2024-06-30'),
    gone AS (SELECT node FROM seed UNION SELECT CASE WHEN e.source = g.node THEN e.target ELSE e.source END FROM gone g JOIN e ON e.source = g.node OR (e.target = g.node AND e.relation IN ('amends', 'focused_update'))),
    s AS (SELECT document_id, CASE WHEN status = 'active' AND document_id IN (SELECT node FROM gone) THEN 'superseded' ELSE status END AS status FROM d)"""
_REC = f"""{_GUIDE},
    p AS (SELECT DISTINCT unnest([source_document_id, target_document_id]) AS document_id, k AS recommendation_key FROM version_relations, unnest(affected_recommendation_keys) x(k)),
    r AS (SELECT *, recommendation_key[4:6]::INT AS n, right(document_id, 1)::INT AS m FROM p WHERE document_id IS NOT NULL),
    q AS (SELECT r.*, CASE WHEN n % 4 = 0 THEN DATE '2023-06-01' END AS a0, CASE WHEN n % 9 = 0 THEN DATE '2024-01-31' END AS a1, d.eff, d.series_id, d.effective_until, d.withdrawn_on FROM r JOIN d USING (document_id) WHERE NOT (n % 7 = 0 AND n % 5 <> 0)),
    v AS (SELECT target_document_id AS document_id, q.recommendation_key FROM (SELECT *, unnest(affected_recommendation_keys) AS k FROM version_relations WHERE relation_type IN ('amends', 'focused_update') AND effective_from <= DATE '2024-06-30') u
          JOIN q ON u.source_document_id = q.document_id AND u.k = q.recommendation_key JOIN d t ON u.target_document_id = t.document_id AND t.series_id = q.series_id
          WHERE q.eff <= DATE '2024-06-30' AND greatest(u.effective_from, q.eff, a0) <= DATE '2024-06-30' AND NOT coalesce(greatest(u.effective_from, q.eff, a0) > a1, false)
          AND NOT coalesce(greatest(u.effective_from, q.eff, a0) > q.effective_until, false) AND NOT coalesce(greatest(u.effective_from, q.eff, a0) >= q.withdrawn_on, false)),
    f AS (SELECT q.* FROM q JOIN s ON q.document_id = s.document_id AND s.status = 'active' WHERE (a0 IS NULL OR a0 <= DATE '2024-06-30') AND (a1 IS NULL OR a1 >= DATE '2024-06-30')
          AND NOT EXISTS (SELECT 1 FROM v WHERE v.document_id = q.document_id AND v.recommendation_key = q.recommendation_key))"""

SQL = {
    "history_rows": f"WITH {_REV} SELECT seq, status, replaced_by FROM h",
    "history_conflicts": f"""
        WITH {_REV}, u AS (SELECT c.* FROM c JOIN h USING (seq) WHERE status = 'current'),
        b AS (SELECT seq, subject_id, identity, tm, version, 'document' AS binding, 'd' AS place FROM u UNION ALL SELECT seq, subject_id, identity, tm, version, 'site_id', site_id FROM u WHERE site_id IS NOT NULL),
        n AS (SELECT subject_id, binding, place, identity, tm, count(DISTINCT version) AS n_versions, count(*) AS n_revisions FROM b GROUP BY ALL HAVING count(DISTINCT version) >= 2)
        SELECT seq, b.binding, n_versions, n_revisions FROM b JOIN n ON b.binding = n.binding AND b.place = n.place AND b.subject_id = n.subject_id AND b.identity = n.identity AND b.tm IS NOT DISTINCT FROM n.tm""",
    "comparisons": f"""
        WITH {_REV}, t AS (SELECT a.*, h.status, result.kind AS kind, coalesce(clinical_time.value IS NOT NULL AND clinical_time.role IN ('collected', 'performed') AND clinical_time.precision IN ('date', 'datetime'), false) AS strict FROM a JOIN h USING (seq) WHERE trusted),
        w AS (SELECT *, first_value(specimen) OVER o AS fs, first_value(unit_raw) OVER o AS fu, first_value(kind) OVER o AS fk FROM t WINDOW o AS (PARTITION BY subject_id, analyte_key ORDER BY recorded_at, seq)),
        x AS (SELECT seq, list_filter([CASE WHEN (fk LIKE 'numeric%') <> (kind LIKE 'numeric%') OR (fk NOT LIKE 'numeric%' AND kind <> fk) THEN 'different_result_scale' END, CASE WHEN specimen <> fs THEN 'different_specimen' END,
              CASE WHEN status <> 'current' THEN 'historical_or_clinically_replaced' END, CASE WHEN kind = 'no_result' THEN 'no_result' END, CASE WHEN kind = 'text_unparsed' THEN 'result_unparsed' END,
              CASE WHEN unit_raw <> fu THEN 'unit_conversion_rule_not_supported' END], lambda y: y IS NOT NULL) AS no,
              list_filter([CASE WHEN analyte_key IS NULL THEN 'analyte_identity_not_confirmed' END, CASE WHEN NOT strict THEN 'clinical_time_not_exact_collection_or_performance' END, CASE WHEN specimen IS NULL OR fs IS NULL THEN 'specimen_unknown' END,
              CASE WHEN (unit_raw IS NULL OR fu IS NULL) AND kind LIKE 'numeric%' THEN 'unit_unknown' END], lambda y: y IS NOT NULL) AS ctx FROM w)
        SELECT seq, CASE WHEN len(no) > 0 THEN 'excluded' WHEN len(ctx) > 0 THEN 'contextual' ELSE 'included' END AS category, array_to_string(CASE WHEN len(no) > 0 THEN no ELSE ctx END, ',') AS reasons FROM x""",
    "value_changes": """
        WITH c AS (SELECT o_custkey, count(*) AS n, first(o_totalprice::DECIMAL(14,2) ORDER BY o_orderdate, o_orderkey) AS a, last(o_totalprice::DECIMAL(14,2) ORDER BY o_orderdate, o_orderkey) AS b FROM orders GROUP BY 1)
        SELECT o_custkey, n, (b - a)::DECIMAL(14,2)::VARCHAR AS delta FROM c WHERE n >= 2""",
    "history_page": """
        WITH o AS (SELECT seq, CASE WHEN clinical_time.precision = 'date' THEN clinical_time.value END AS v, recorded_at FROM private_answers)
        SELECT seq, coalesce(v, '9999-99-99') AS low, coalesce(v, '9999-99-99') AS high FROM o ORDER BY low, high, recorded_at NULLS FIRST, seq LIMIT 200""",
    "reused_claims": """
        WITH a AS (SELECT seq, subject_id, claim_id, concat_ws('|', site_id, analyte_raw, clinical_time.raw) AS place FROM private_answers WHERE subject_id IS NOT NULL),
        k AS (SELECT subject_id, place, count(DISTINCT claim_id) AS n, min(claim_id) AS id FROM a WHERE seq % 5 > 0 GROUP BY ALL), f AS (SELECT *, count(*) OVER (PARTITION BY subject_id, place) AS m FROM a WHERE seq % 5 = 0)
        SELECT seq, CASE WHEN n = 1 AND m = 1 THEN id ELSE '' END AS claim_id, CASE WHEN n IS NULL THEN 'new' WHEN n > 1 OR m > 1 THEN 'ambiguous' ELSE 'reused' END AS status FROM f LEFT JOIN k USING (subject_id, place)""",
    "guidance_in_force": f"WITH RECURSIVE {_GUIDE} SELECT document_id, status FROM s",
    "recommendations_in_force": f"WITH RECURSIVE {_REC} SELECT document_id, recommendation_key FROM f",
    "recommendation_conflicts": f"""
        WITH RECURSIVE {_REC}, z AS (SELECT n % 20 AS decision_key, document_id || '/' || recommendation_key AS recommendation_id, m % 3 = 0 AS against, m % 2 AS pos FROM f),
        y AS (SELECT decision_key, bool_or(against) AND bool_or(NOT against) AS dir, count(DISTINCT pos) > 1 AS poss FROM z GROUP BY 1 HAVING count(*) >= 2)
        SELECT decision_key, 'direction' AS kind, recommendation_id FROM z JOIN y USING (decision_key) WHERE dir UNION ALL SELECT decision_key, 'position', recommendation_id FROM z JOIN y USING (decision_key) WHERE poss""",
    "evidence_pages": """
        WITH r AS (SELECT source_type, snapshot_id, row_number() OVER (ORDER BY source_type, snapshot_id) AS n, count(*) OVER () AS m FROM evidence_snapshot WHERE source_type IS NOT NULL AND (source_type, snapshot_id) > ('guideline', 'es-00000300'))
        SELECT source_type, snapshot_id, (m > 40)::INT AS more FROM r WHERE n <= 40""",
}
