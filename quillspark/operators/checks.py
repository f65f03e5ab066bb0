"""Contract checks and keys as expressions: every check gives the sorted names of the rules that a value breaks."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.sets import violated

DECIMAL = r"^[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
# Kinds of results, of reasons without one, of intervals, of times and their roles.
RESULT_KINDS = ["numeric_exact", "numeric_censored", "qualitative", "semiquantitative", "no_result", "text_unparsed"]
NO_RESULT_REASONS = ["not_reported", "cancelled", "invalid_specimen", "not_performed", "unknown"]
INTERVAL_KINDS = ["laboratory_reference", "diagnostic_decision_limit", "therapeutic_target"]
ROLES = ["collected", "performed", "reported", "unknown"]
PRECISIONS = {"datetime": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}", "date": r"^\d{4}-\d{2}-\d{2}$", "month": r"^\d{4}-\d{2}$", "year": r"^\d{4}$"}


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def result_rules(kind: Column, raw: Column, decimal: Column, operator: Column, reason: Column) -> Column:
    """The rules that a result breaks: its kind is known, its number is the one printed, its sign and its reason are stated."""
    bare = F.when(kind == "numeric_censored", F.trim(F.substring(F.trim(raw), F.length(operator) + 1, F.length(raw)))).otherwise(F.trim(raw))
    number = F.translate(bare, ",", ".")
    numeric = kind.isin("numeric_exact", "numeric_censored")
    same = number.rlike(DECIMAL) & (number.try_cast("decimal(38,12)") == decimal.try_cast("decimal(38,12)"))
    return violated({
        "kind_unknown": kind.isin(*RESULT_KINDS), "raw_missing": (F.trim(F.coalesce(raw, F.lit(""))) != "") | _no(kind == "no_result"),
        "number_differs": ~_no(numeric) | _no(same), "sign_missing": ~_no(kind == "numeric_censored") | _no(operator.isin("<", "<=", ">", ">=", "≤", "≥") & F.startswith(F.trim(raw), operator)),
        "reason_missing": ~_no(kind == "no_result") | _no(reason.isin(*NO_RESULT_REASONS)),
    })


def time_rules(role: Column, precision: Column, value: Column, raw: Column) -> Column:
    """The rules that a clinical time breaks: role and precision are known, a value exists, has that precision and is a real day."""
    known = F.coalesce(precision, F.lit("")) != "unknown"
    shaped = F.coalesce(*(F.when(precision == p, value.rlike(shape)) for p, shape in PRECISIONS.items()), F.lit(False))
    n = F.length(value)
    day = F.when(n == 4, F.concat(value, F.lit("-01-01"))).when(n == 7, F.concat(value, F.lit("-01"))).otherwise(F.substring(value, 1, 10))
    return violated({
        "role_unknown": role.isin(*ROLES), "precision_unknown": precision.isin(*PRECISIONS, "unknown"), "value_made_up": known | value.isNull(),
        "value_of_other_precision": ~known | _no(shaped), "no_such_day": ~known | value.isNull() | F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).isNotNull(), "raw_missing": ~known | _no(F.trim(raw) != ""),
    })


def interval_rules(kind: Column, low: Column, high: Column, low_inclusive: Column, high_inclusive: Column) -> Column:
    """The rules that a reference interval breaks: known kind, decimal bounds in order, inclusive or not stated for each."""
    number = lambda c: c.isNull() | c.rlike(DECIMAL)
    order = low.isNull() | high.isNull() | _no(low.try_cast("decimal(38,12)") <= high.try_cast("decimal(38,12)"))
    return violated({
        "kind_unknown": kind.isin(*INTERVAL_KINDS), "low_no_number": number(low), "high_no_number": number(high), "bounds_reversed": order,
        "low_inclusive_missing": low.isNull() | low_inclusive.isNotNull(), "high_inclusive_missing": high.isNull() | high_inclusive.isNotNull(),
    })


def observed_at_rules(value: Column) -> Column:
    """The rules that a time of observation breaks: null, a real ISO date, or an ISO date and time with its offset."""
    dated = value.rlike(r"^\d{4}-\d{2}-\d{2}$")
    timed = value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?$")
    real = F.try_to_timestamp(F.substring(value, 1, 10), F.lit("yyyy-MM-dd")).isNotNull()
    zoned = value.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$")
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(violated({"no_iso_time": dated | timed, "no_such_day": ~(dated | timed) | real, "zone_missing": ~timed | zoned}))


def month_window_rules(start: Column, end: Column) -> Column:
    """The rules that a window of publication breaks: whole months, both ends or none, in order."""
    return violated({
        "not_first_of_month": start.isNull() | (F.dayofmonth(start) == 1), "not_last_of_month": end.isNull() | (F.last_day(end) == end),
        "one_end_only": start.isNull() == end.isNull(), "reversed": start.isNull() | end.isNull() | (start <= end),
    })


def date_shaped(text: Column) -> Column:
    """Whether a text has the shape of a date, which says nothing of its year."""
    return F.trim(text).rlike(r"^\d{1,2}[./-]\d{1,2}(?:[./-]\d{2,4})?(?:[ T]\d{1,2}:\d{2}(?::\d{2})?)?$|^\d{4}(?:-\d{2}){0,2}$|^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}")


def portal_matches(domains: Column, jurisdictions: Column, wanted_domains: list[str], wanted_jurisdictions: list[str]) -> Column:
    """Whether a source covers a domain and a jurisdiction that are wanted; all and GLOBAL cover any."""
    lit = lambda xs, more: F.array(*map(F.lit, [*xs, more]))
    return F.arrays_overlap(domains, lit(wanted_domains, "all")) & F.arrays_overlap(jurisdictions, lit(wanted_jurisdictions, "GLOBAL"))


def bound_host(url: Column, hosts: Column) -> Column:
    """Whether an address is https without user, port and fragment and its host is one of a source's own."""
    host = F.lower(F.regexp_extract(url, r"^https://([^/:?#@\s]+)(?:[/?][^#\s]*)?$", 1))
    return _no((host != "") & F.array_contains(hosts, host))


@F.pandas_udf(T.BooleanType())
def public_url(url: pd.Series) -> pd.Series:
    """Whether an address is http or https, without a user, and its host is public: no local name, private or numeric one."""

    def public(u) -> bool | None:
        if u is None:
            return None
        try:
            parts = urlsplit(u)
            host, _ = parts.hostname, parts.port
        except ValueError:
            return False
        if parts.scheme not in ("http", "https") or not host or parts.username or parts.password or host in ("localhost", "localhost.localdomain") or host.endswith((".local", ".localhost", ".internal")):
            return False
        try:
            return ipaddress.ip_address(host).is_global
        except ValueError:
            return not re.fullmatch(r"[0-9.]+|0x[0-9a-f]+", host)

    return pd.Series([public(u) for u in url], dtype=object)


@F.pandas_udf(T.StringType())
def folded_unit(unit: pd.Series) -> pd.Series:
    """A unit's letters without blanks, case and compatibility forms, micro signs as u."""
    return pd.Series([None if u is None else "".join(unicodedata.normalize("NFKC", u).replace("µ", "u").replace("μ", "u").split()).casefold() for u in unit], dtype=object)


@F.pandas_udf(T.StringType())
def typed_unit(unit: pd.Series) -> pd.Series:
    """A unit's letters with their case, without blanks, superscripts as powers and one micro sign."""
    digits = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")
    power = lambda u: re.sub("[⁰¹²³⁴⁵⁶⁷⁸⁹]+", lambda m: "^" + m[0].translate(digits), u)
    return pd.Series([None if u is None else re.sub(r"\s+", "", unicodedata.normalize("NFKC", power(u)).replace("μ", "µ")) for u in unit], dtype=object)


def source_identity(doi: Column, pmid: Column, url: Column) -> Column:
    """What identifies a work: its DOI in lower case without an address before it, else its PubMed number, else its address."""
    bare = F.lower(F.regexp_replace(F.trim(doi), r"(?i)^https://doi\.org/", ""))
    return F.when(bare.rlike(r"^10\.\d{4,9}/\S+$"), F.concat(F.lit("doi:"), bare)).when(pmid.rlike(r"^\d+$"), F.concat(F.lit("pmid:"), pmid)).otherwise(F.concat(F.lit("url:"), url))


def reference_relation(df: DataFrame, key: str, value: str, unit: str, intervals: DataFrame) -> DataFrame:
    """Rows (key, relation): a value against the laboratory's own interval in its unit.

    intervals (key, kind, unit, low, high): only laboratory_reference counts. None is not_available, several are
    indeterminate; else below, within or above.
    """
    from quillspark.operators.numbers import interval_relation

    own = intervals.where("kind = 'laboratory_reference'").groupBy(F.col(key).alias("_k"), F.col("unit").alias("_u")).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("low", "high")).alias("_i"))
    joined = df.select(key, value, unit).join(own, (F.col(key) == F.col("_k")) & (F.col(unit) == F.col("_u")), "left")
    relation = F.when(F.col("_n").isNull(), "not_available").when(F.col("_n") > 1, "indeterminate").otherwise(interval_relation(F.col(value), F.col("_i.low"), F.col("_i.high")))
    return joined.select(key, relation.alias("relation"))


def byte_pieces(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Rows (key, piece_no, piece): a text cut into pieces of at most size bytes of UTF-8, never inside a character.

    Together in order they are the text. Null and empty texts have none; size is 4 at least.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(s: pd.Series) -> pd.Series:
        out = []
        for t in s:
            b, at, pieces = t.encode(), 0, []
            while at < len(b):
                end = min(at + max(4, size), len(b))
                while end < len(b) and b[end] & 0xC0 == 0x80:
                    end -= 1
                pieces.append(b[at:end].decode())
                at = end
            out.append(pieces)
        return pd.Series(out, dtype=object)

    pieces = df.where(F.length(text) > 0).select(key, F.posexplode(cut(F.col(text))).alias("_at", "piece"))
    return pieces.select(key, (F.col("_at") + 1).alias("piece_no"), "piece")
