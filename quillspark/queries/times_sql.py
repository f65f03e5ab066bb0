"""SQL that reads the same notations of time as operators.times, written from the notations, not from the operator."""

from __future__ import annotations

# Month names as they occur in the tables, by number.
NAMES = {
    "01": "january|januar|jan|enero|января", "02": "february|februar|feb|febrero|февраля", "03": "march|märz|mar(?:zo)?|марта", "04": "april|apr|abril|апреля", "05": "mayo|may|mai|мая", "06": "june|junio|juni|jun|июня",
    "07": "july|julio|juli|jul|июля", "08": "august|aug|agosto|августа", "09": "september|sep(?:tiembre)?|сентября", "10": "october|oktober|octubre|oct|октября", "11": "november|nov(?:iembre)?|ноября", "12": "december|dezember|diciembre|dec|декабря",
}
# Zone abbreviations as they occur in the tables, in minutes.
ABBREVIATIONS = {"utc": 0, "gmt": 0, "wet": 0, "west": 60, "cet": 60, "cest": 120, "sast": 120, "eet": 120, "eest": 180, "jst": 540, "aest": 600, "aedt": 660, "est": -300, "edt": -240, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420}


def _numbered(text: str) -> str:
    for number, names in sorted(NAMES.items(), key=lambda x: -max(map(len, x[1].split("|")))):
        text = f"regexp_replace({text}, '(^|[^a-zа-яä])({names})([^a-zа-яä]|$)', '\\1M{number}\\3')"
    return text


def read_times(source: str) -> str:
    """A query over source (table_name, seq, text, zone, ord) that adds norm and the epoch at, with the precision p."""
    day = {
        "y": r"^([0-9]{4})$", "my": r"^([0-9]{2})/([0-9]{4})$", "ym": r"^([0-9]{4})-([0-9]{2})$", "Mny": r"^M([0-9]{2}) ([0-9]{4})$", "yMn": r"^([0-9]{4}) M([0-9]{2})$",
    }
    dates = [
        (r"([0-9]{4})[-/]([0-9]{2})[-/]([0-9]{2})", ("1", "2", "3")), (r"([0-9]{4})([0-9]{2})([0-9]{2})", ("1", "2", "3")), (r"([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})", ("3", "2", "1")), (r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", "slash"),
        (r"([0-9]{1,2})[-. ]{1,2}(?:de )?M([0-9]{2})[- ](?:de )?([0-9]{4})(?: г\.)?", ("3", "2", "1")), (r"(?:[a-z]{3}, )?([0-9]{2}) M([0-9]{2}) ([0-9]{4})", ("3", "2", "1")), (r"M([0-9]{2}) ([0-9]{1,2}), ([0-9]{4})", ("3", "1", "2")), (r"([0-9]{2})-M([0-9]{2})-([0-9]{2})", "short"),
    ]
    clock = r"(?:t| |, | at )([0-9]{1,2}):?([0-9]{2})(?::?([0-9]{2}))?(?:\.[0-9]+)?(?: ?(am|pm))?(?: uhr)?(?: ?(z|[a-z]{3,4}))?(?: ?([-+])([0-9]{2}):?([0-9]{2}))?"
    whens = []
    for n, (pattern, order) in enumerate(dates):
        get = lambda i, p=pattern: f"regexp_extract(t, '^{p}', {i})"
        if order == "slash":
            parts = f"[{get(3)}, CASE ord WHEN 'DMY' THEN {get(2)} WHEN 'MDY' THEN {get(1)} END, CASE ord WHEN 'DMY' THEN {get(1)} WHEN 'MDY' THEN {get(2)} END]"
        elif order == "short":
            parts = f"[CASE WHEN {get(3)} < '70' THEN '20' ELSE '19' END || {get(3)}, {get(2)}, {get(1)}]"
        else:
            parts = "[" + ", ".join(get(i) for i in order) + "]"
        whens.append(f"WHEN regexp_matches(t, '^{pattern}(?:{clock})?$') THEN struct_pack(d := {parts}, rest := regexp_replace(t, '^{pattern}', ''))")
    c = lambda i: f"regexp_extract(v.rest, '^{clock}$', {i})"
    abbreviation = "CASE z " + " ".join(f"WHEN '{k}' THEN {m}" for k, m in ABBREVIATIONS.items()) + " WHEN 'z' THEN 0 END"
    ordinal = "try_cast(t[1:4] || '-01-01' AS DATE) + (t[6:8]::INT - 1)"
    monday = "date_trunc('week', make_date(t[1:4]::INT, 1, 4))::DATE"
    return f"""
    a AS (SELECT *, {_numbered("lower(regexp_replace(trim(text, ' '), ' +', ' ', 'g'))")} AS t FROM ({source})),
    b AS (SELECT *, CASE {" ".join(whens)} END AS v FROM a),
    c AS (SELECT *, try_cast(v.d[1] || '-' || lpad(v.d[2], 2, '0') || '-' || lpad(v.d[3], 2, '0') AS DATE) AS day, v.rest <> '' AS timed, try_cast({c(1)} AS INT) AS h, try_cast({c(2)} AS INT) AS mi, coalesce(try_cast({c(3)} AS INT), 0) AS s, {c(4)} AS half, {c(5)} AS z, {c(6)} AS sign, {c(7)} AS oh, {c(8)} AS om FROM b),
    d AS (SELECT *, CASE WHEN half = '' AND h <= 23 THEN h WHEN half <> '' AND h BETWEEN 1 AND 12 THEN h % 12 + CASE half WHEN 'pm' THEN 12 ELSE 0 END END AS hour FROM c),
    e AS (SELECT *, CASE WHEN timed AND mi <= 59 AND s <= 59 AND hour IS NOT NULL THEN day + to_seconds(hour * 3600 + mi * 60 + s) END AS local, coalesce({abbreviation}, CASE WHEN z = '' THEN 0 END) * 60 + CASE sign WHEN '+' THEN 1 WHEN '-' THEN -1 ELSE 0 END * coalesce(try_cast(oh AS INT) * 3600 + try_cast(om AS INT) * 60, 0) AS off FROM d),
    f AS (SELECT *, CASE WHEN z <> '' OR sign <> '' THEN local - to_seconds(off) WHEN zone IS NOT NULL AND local IS NOT NULL THEN (timezone(zone, local)) AT TIME ZONE 'UTC' END AS utc FROM e),
    g AS (SELECT *, CASE WHEN z <> '' OR sign <> '' THEN true ELSE timezone(zone, utc AT TIME ZONE 'UTC') = local AND timezone(zone, (utc - INTERVAL 1 HOUR) AT TIME ZONE 'UTC') <> local AND timezone(zone, (utc + INTERVAL 1 HOUR) AT TIME ZONE 'UTC') <> local END AS sure FROM f),
    times AS (SELECT table_name, seq, zone, CASE
        WHEN regexp_full_match(t, '[0-9]{{10}}') THEN strftime(make_timestamp(t::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%SZ')
        WHEN regexp_full_match(t, '[0-9]{{13}}') THEN strftime(make_timestamp(t::BIGINT // 1000 * 1000000), '%Y-%m-%dT%H:%M:%SZ')
        WHEN regexp_matches(t, '{day["y"]}') AND t > '1599' THEN t
        WHEN regexp_matches(t, '{day["my"]}') AND t[1:2] BETWEEN '01' AND '12' THEN t[4:7] || '-' || t[1:2]
        WHEN regexp_matches(t, '{day["ym"]}') AND t[6:7] BETWEEN '01' AND '12' THEN t
        WHEN regexp_matches(t, '{day["Mny"]}') THEN t[5:8] || '-' || t[2:3]
        WHEN regexp_matches(t, '{day["yMn"]}') THEN t[1:4] || '-' || t[7:8]
        WHEN regexp_full_match(t, '[0-9]{{4}}-[0-9]{{3}}') THEN CASE WHEN year({ordinal}) = t[1:4]::INT AND t[6:8] > '000' THEN strftime({ordinal}, '%Y-%m-%d') END
        WHEN regexp_full_match(t, '[0-9]{{4}}-w[0-9]{{2}}-[1-7]') THEN CASE WHEN t[7:8] BETWEEN '01' AND '53' AND isoyear({monday} + 7 * (t[7:8]::INT - 1)) = t[1:4]::INT THEN strftime({monday} + 7 * (t[7:8]::INT - 1) + (t[10:10]::INT - 1), '%Y-%m-%d') END
        WHEN NOT timed THEN strftime(day, '%Y-%m-%d') WHEN sure THEN strftime(utc, '%Y-%m-%dT%H:%M:%SZ') END AS norm FROM g)"""


_BY_NAME = "(SELECT site_name, min(timezone) AS timezone, min(date_order) AS date_order FROM source_sites GROUP BY 1)"
P4 = f"""
    WITH {read_times(f'''
        SELECT 'private_answers' AS table_name, seq, clinical_time.raw AS text, coalesce(nullif(trim(clinical_time.timezone), ''), s.timezone) AS zone, s.date_order AS ord FROM private_answers LEFT JOIN source_sites s USING (site_id)
        UNION ALL SELECT 'guideline_documents', seq, effective_from, s.timezone, s.date_order FROM guideline_documents LEFT JOIN {_BY_NAME} s ON issuer = s.site_name
        UNION ALL SELECT 'evidence_snapshot', seq, published_at, s.timezone, s.date_order FROM evidence_snapshot LEFT JOIN {_BY_NAME} s ON organization = s.site_name''')}
    SELECT table_name, seq, norm AS time_norm FROM times WHERE norm IS NOT NULL"""


def p1(version: str, status: str) -> str:
    """The history of guideline documents; version and status are SQL for the canonical forms of those columns."""
    stamp = lambda c: f"strftime({c} AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ')"
    return f"""
    WITH {read_times(f"SELECT 'guideline_documents' AS table_name, seq, effective_from AS text, s.timezone AS zone, s.date_order AS ord FROM guideline_documents LEFT JOIN {_BY_NAME} s ON issuer = s.site_name")},
    r AS (SELECT document_id, last_checked_at AS chk, g.seq, {version} AS version, CASE WHEN length(norm) > 10 THEN strftime(timezone(zone, norm::TIMESTAMPTZ), '%Y-%m-%d') ELSE coalesce(norm, lower(trim(effective_from))) END AS effective_from,
          CASE WHEN year(withdrawn_on) < 9999 THEN withdrawn_on END AS withdrawn_on, {status} AS status FROM guideline_documents g JOIN times USING (seq)),
    k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY document_id, chk ORDER BY seq DESC) = 1),
    l AS (SELECT document_id, chk, version, effective_from, withdrawn_on, last_value(status IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY chk ROWS UNBOUNDED PRECEDING) AS status FROM k),
    m AS (SELECT *, struct_pack(a := version, b := effective_from, c := withdrawn_on, d := status) AS state FROM l),
    n AS (SELECT *, lag(state) OVER w AS was, row_number() OVER w AS n FROM m WINDOW w AS (PARTITION BY document_id ORDER BY chk)),
    o AS (SELECT document_id, chk, lead(chk) OVER (PARTITION BY document_id ORDER BY chk) AS until FROM n WHERE n = 1 OR state IS DISTINCT FROM was)
    SELECT document_id, {stamp("chk")} AS valid_from, coalesce({stamp("until")}, '') AS valid_to FROM o"""
