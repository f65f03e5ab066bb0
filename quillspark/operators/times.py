"""Mixed timestamp notations and zones, normalised to one unambiguous form.

Each text is cut into character classes (digits, letters, the rest). All texts of one shape mask have
every field at the same position, so a mask is mapped to a parser once and its fields are then read for
all rows at a time with numpy. Local times go through zone transition tables that carry the version of
the zone data: a local time that does not exist or occurs twice has no determined meaning.

Everything runs in one Arrow-batched pass without a shuffle; the only join is a broadcast of the table of
sites, whose size is checked by the caller.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Month names (English, German, Spanish, Russian), by number.
MONTHS = {
    1: ["jan", "january", "januar", "jänner", "enero", "ene", "января", "январь"],
    2: ["feb", "february", "februar", "febrero", "февраля", "февраль"],
    3: ["mar", "march", "märz", "maerz", "mär", "marzo", "марта", "март"],
    4: ["apr", "april", "abril", "abr", "апреля", "апрель"],
    5: ["may", "mai", "mayo", "мая", "май"],
    6: ["jun", "june", "juni", "junio", "июня", "июнь"],
    7: ["jul", "july", "juli", "julio", "июля", "июль"],
    8: ["aug", "august", "agosto", "ago", "августа", "август"],
    9: ["sep", "sept", "september", "septiembre", "setiembre", "сентября", "сентябрь"],
    10: ["oct", "october", "oktober", "okt", "octubre", "октября", "октябрь"],
    11: ["nov", "november", "noviembre", "ноября", "ноябрь"],
    12: ["dec", "december", "dezember", "dez", "diciembre", "dic", "декабря", "декабрь"],
}
# Zone abbreviations with one offset from UTC, in minutes.
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120, "sast": 120,
    "eet": 120, "eest": 180, "msk": 180, "npt": 345, "jst": 540, "aest": 600, "aedt": 660,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "cot": -300,
}
WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]

_MONTH_OF = {w: m for m, ws in MONTHS.items() for w in ws}
_WORDS = {"at": "@", "t": "T", "uhr": "U", "de": "L", "del": "L", "г": "G", "w": "W", "am": "P", "pm": "P"}
_EPOCH = datetime(1970, 1, 1)
FIRST_YEAR, LAST_YEAR = 1600, 2199

# The shape of a date and of a time of day, one character a token: a digit stands for a run of so many digits,
# M a month's name, D a weekday, Z a zone, P am or pm; the others stand for themselves.
_DATES = [
    ("ymd", re.compile(r"(4)[-/.](2)[-/.](2)")),
    ("ymd8", re.compile(r"(8)")),
    ("ordinal", re.compile(r"(4)-(3)")),
    ("week", re.compile(r"(4)-?W(2)-?(1)")),
    ("slashed", re.compile(r"([12])/([12])/(4)")),
    ("dmy", re.compile(r"([12])\.([12])\.(4)")),
    ("dmy_name", re.compile(r"(?:D,? )?([12])(?:\.? |-|\. ?|/)(?:L )?(M)\.?(?:,? |-|/)(?:L )?([24])(?: G\.?)?")),
    ("mdy_name", re.compile(r"(?:D,? )?(M)\.? ([12]),? (4)")),
    ("ymd_name", re.compile(r"(4)[- ](M)[- ]([12])")),
    ("ym", re.compile(r"(4)[-/](2)")),
    ("my", re.compile(r"(2)[/.](4)")),
    ("my_name", re.compile(r"(M)\.?,?[ -](?:L )?(4)(?: G\.?)?")),
    ("ym_name", re.compile(r"(4)[ -](M)\.?")),
    ("y", re.compile(r"(4)")),
]
_CLOCK = re.compile(r"([12])[:.]?(2)(?:[:.](2)(?:[.,][0-9A])?)?(?: ?(P))?(?: ?U)?|(6)(?:[.,][0-9A])?|(4)")
_OFFSET = re.compile(r" ?(?:(Z)\.?(?:([-+])([12])(?::?(2))?)?|([-+])(?:(2)(?::(2))?|(4)))?")
_JOINT = re.compile(r",? ?@ |, ?|T| ")
_CANON = {"−": "-", "–": "-", " ": " ", " ": " ", " ": " ", "　": " ", "\t": " ", "，": ","}


class _Shapes(dict):
    """Character classes for str.translate: 9 a digit, a a letter, the rest as it is."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = "9" if c.isascii() and c.isdigit() else "a" if c.isalpha() else c
        return out


_SHAPES = _Shapes()
_TOKENS = re.compile(r"9+|a+|\s+|.", re.S)


def shape_mask(text: str) -> str:
    """The shape of a text, one character each: 9 for a digit, a for a letter, others kept."""
    return text.translate(_SHAPES)


def _word_class(word: str) -> str:
    w = word.lower()
    if w in _MONTH_OF:
        return "M"
    if w in _WORDS:
        return _WORDS[w]
    if w[:3] in WEEKDAYS and len(w) in (3, 6, 7, 8, 9) and (len(w) == 3 or w.endswith("day")):
        return "D"
    return "Z" if w in ZONES else "?"


@lru_cache(4096)
def _plan(mask: str, words: tuple[str, ...]) -> tuple | None:
    """The parser of a mask whose words are of the given classes: (kind, date fields, clock fields, offset fields).

    A field is the (start, end) of its token. None where the mask means no time.
    """
    spans, chars, k = [], [], 0
    for m in _TOKENS.finditer(mask):
        t = m[0]
        if t[0] == "9":
            c = str(len(t)) if len(t) <= 9 else {10: "t", 13: "m"}.get(len(t), "?")
        elif t[0] == "a":
            c, k = words[k], k + 1
        else:
            c = " " if t.isspace() else t
        spans.append(m.span())
        chars.append(c)
    text = "".join(chars)
    if text in ("t", "m"):
        return ("epoch_s" if text == "t" else "epoch_ms", [spans[0]], None, None)

    def fields(m: re.Match, at: int = 0) -> list:
        return [spans[m.start(i)] if m.group(i) is not None else None for i in range(1, (m.re.groups or 0) + 1)]

    for kind, pattern in _DATES:
        if not (d := pattern.match(text)):
            continue
        if d.end() == len(text):
            return (kind, fields(d), None, None)
        if kind in ("ym", "my", "y", "my_name", "ym_name"):
            continue
        if not (j := _JOINT.match(text, d.end())):
            continue
        joints = [j.end()]
        for at in joints:
            if (c := _CLOCK.match(text, at)) and (o := _OFFSET.fullmatch(text, c.end())):
                return (kind, fields(d), fields(c), fields(o))
    return None


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 of civil dates, and where such a date exists."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    ok = (y >= FIRST_YEAR) & (y <= LAST_YEAR) & (m >= 1) & (m <= 12)
    mm = np.clip(m, 1, 12)
    length = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[mm - 1] + (leap & (mm == 2))
    ok &= (d >= 1) & (d <= length)
    yy = np.clip(y, FIRST_YEAR, LAST_YEAR)
    start = ((yy - 1970).astype("datetime64[Y]").astype("datetime64[M]") + (mm - 1)).astype("datetime64[D]").astype(np.int64)
    return start + d - 1, ok


def zone_version() -> str:
    """The version of the zone data in use."""
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "system"


def _stated_transitions(zone: str) -> tuple[int, ...]:
    """The instants (seconds, UTC) of changes that the data file of a known zone lists."""
    from importlib.resources import files
    from zoneinfo import TZPATH

    places = [Path(p, zone) for p in TZPATH]
    data = next((p.read_bytes() for p in places if p.is_file()), None)
    if data is None:
        data = files("tzdata").joinpath("zoneinfo", *zone.split("/")).read_bytes()
    head = ">4sc15x6l"
    at, width = 0, 4
    _, version, isut, isstd, leap, times, types, chars = struct.unpack_from(head, data)
    if version >= b"2":  # the same again with instants of 8 bytes
        at, width = 44 + times * 5 + types * 6 + chars + leap * 8 + isstd + isut, 8
        times = struct.unpack_from(head, data, at)[5]
    return struct.unpack_from(f">{times}{'q' if width == 8 else 'l'}", data, at + 44)


@lru_cache(1024)
def zone_transitions(zone: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The instants (seconds, UTC) from which an offset (seconds) holds in a zone; None for an unknown zone.

    Offsets are read at every listed change, however close it is to the next, and every 14 days for the yearly rule that
    follows the last one.
    """
    from zoneinfo import ZoneInfo

    try:
        z = ZoneInfo(zone)
    except (KeyError, ValueError, OSError):
        return None
    offset = lambda t: int((_EPOCH + timedelta(seconds=t)).replace(tzinfo=timezone.utc).astimezone(z).utcoffset().total_seconds())
    lo = int((datetime(1900, 1, 1) - _EPOCH).total_seconds())
    hi = int((datetime(2100, 1, 1) - _EPOCH).total_seconds())
    at, off, step = [lo], [offset(lo)], 14 * 86400
    stated = {x for t in _stated_transitions(zone) for x in (t - 1, t) if lo < x <= hi}
    points = sorted(stated | set(range(lo, hi + step, step)))
    for a, b in zip(points, points[1:], strict=False):
        if (new := offset(b)) != off[-1]:
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if offset(mid) == off[-1] else (a, mid)
            at.append(b)
            off.append(new)
    return np.array(at, np.int64), np.array(off, np.int64)


def zone_table(spark, zones: list[str]) -> DataFrame:
    """The transition tables of some zones as rows, with the version of the zone data."""
    rows = []
    for zone in sorted(set(zones)):
        known = zone_transitions(zone)
        for a, o in zip(*known, strict=True) if known else ():
            rows.append((zone_version(), zone, int(a), int(o)))
    return spark.createDataFrame(rows, "version string, zone string, from_epoch bigint, offset_s int")


def _offset_at(table: tuple[np.ndarray, np.ndarray], t: np.ndarray) -> np.ndarray:
    return table[1][np.clip(np.searchsorted(table[0], t, side="right") - 1, 0, None)]


def local_to_utc(local: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """UTC seconds of local seconds, and where exactly one instant has that local time."""
    before, after = local - _offset_at(table, local - 86400), local - _offset_at(table, local + 86400)
    ok1, ok2 = before + _offset_at(table, before) == local, after + _offset_at(table, after) == local
    one = np.where(ok1, before, after)
    return one, (ok1 | ok2) & ~(ok1 & ok2 & (before != after))


def _number(chars: np.ndarray, span: tuple[int, int] | None, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    if span:
        for i in range(*span):
            out = out * 10 + (chars[:, i] - 48)
    return out


def _words_at(texts: list[str], span: tuple[int, int], meaning: dict[str, int]) -> np.ndarray:
    a, b = span
    return np.array([meaning.get(t[a:b].lower(), -10**6) for t in texts], np.int64)


def _group(kind: str, dates: list, clock: list | None, offset: list | None, texts: list[str], zones: np.ndarray, orders: np.ndarray) -> tuple:
    """Parse the texts of one mask: the normal form, and seconds since 1970 (UTC for times of day, local midnight else)."""
    n = len(texts)
    chars = np.array(texts, dtype=f"U{max(1, len(texts[0]))}").view(np.uint32).reshape(n, -1).astype(np.int64)
    num = lambda span: _number(chars, span, n)
    ok = np.ones(n, bool)
    if kind in ("epoch_s", "epoch_ms"):
        s = num(dates[0]) // (1000 if kind == "epoch_ms" else 1)
        ok = s <= 4_102_444_800
        return _stamp(s, ok), s, ok, np.full(n, 4)
    precision = 3
    if kind in ("ym", "my", "ym_name", "my_name", "y"):
        year = num(dates[1 if kind in ("my", "my_name") else 0])
        month = np.ones(n, np.int64)
        if kind != "y":
            slot = dates[0 if kind in ("my", "my_name") else 1]
            month = _words_at(texts, slot, _MONTH_OF) if kind.endswith("name") else num(slot)
        day, precision = np.ones(n, np.int64), 1 if kind == "y" else 2
    elif kind == "ymd":
        year, month, day = map(num, dates)
    elif kind == "ymd8":
        a = dates[0][0]
        year, month, day = num((a, a + 4)), num((a + 4, a + 6)), num((a + 6, a + 8))
    elif kind == "dmy":
        day, month, year = map(num, dates)
    elif kind == "slashed":
        one, two, year = map(num, dates)
        us = orders == "MDY"
        ok &= us | (orders == "DMY")
        day, month = np.where(us, two, one), np.where(us, one, two)
    elif kind == "dmy_name":
        day, month, year = num(dates[0]), _words_at(texts, dates[1], _MONTH_OF), num(dates[2])
        if dates[2][1] - dates[2][0] == 2:
            year = year + np.where(year < 70, 2000, 1900)
    elif kind == "mdy_name":
        day, month, year = num(dates[1]), _words_at(texts, dates[0], _MONTH_OF), num(dates[2])
    elif kind == "ymd_name":
        year, month, day = num(dates[0]), _words_at(texts, dates[1], _MONTH_OF), num(dates[2])
    else:
        year, month, day = num(dates[0]), np.ones(n, np.int64), np.ones(n, np.int64)
    if kind == "ordinal":
        start, good = _days(year, month, day)
        at = num(dates[1])
        leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
        days, ok = start + at - 1, ok & good & (at >= 1) & (at <= 365 + leap)
    elif kind == "week":
        fourth, good = _days(year, month, np.full(n, 4))
        monday = lambda d: d - (d + 3) % 7
        week, weekday = num(dates[1]), num(dates[2])
        days = monday(fourth) + 7 * (week - 1) + weekday - 1
        last = monday(_days(year + 1, month, np.full(n, 4))[0])
        ok &= good & (week >= 1) & (weekday >= 1) & (weekday <= 7) & (days < last)
    else:
        days, good = _days(year, month, day)
        ok &= good
    if clock is None:
        text = np.datetime_as_string(np.where(ok, days, 0).astype("datetime64[D]"), unit={1: "Y", 2: "M", 3: "D"}[precision])
        return text, days * 86400, ok, np.full(n, precision)
    h, mi, s, half, six, four = clock
    if six or four:
        a = (six or four)[0]
        hour, minute, second = num((a, a + 2)), num((a + 2, a + 4)), num((a + 4, a + 6)) if six else np.zeros(n, np.int64)
    else:
        hour, minute, second = num(h), num(mi), num(s)
    if half:
        pm = _words_at(texts, half, {"am": 0, "pm": 1})
        ok &= (hour >= 1) & (hour <= 12)
        hour = hour % 12 + 12 * pm
    ok &= (hour <= 23) & (minute <= 59) & (second <= 59)
    local = days * 86400 + hour * 3600 + minute * 60 + second
    name, sign1, h1, m1, sign2, h2, m2, hm = offset
    sign, oh, om = (sign1, h1, m1) if sign1 else (sign2, h2, m2)
    if sign1 or sign2:
        flip = np.where(chars[:, sign[0]] == ord("+"), 1, -1)
        if hm:
            oh, om = (hm[0], hm[0] + 2), (hm[0] + 2, hm[1])
        hours, minutes = num(oh), num(om)
        ok &= (hours <= 14) & (minutes <= 59)
        utc = local - flip * (hours * 3600 + minutes * 60)
        if name:
            utc = utc - 60 * _words_at(texts, name, ZONES)
    elif name:
        utc = local - 60 * _words_at(texts, name, ZONES)
    else:
        utc = np.zeros(n, np.int64)
        codes, known = pd.factorize(zones)
        ok &= codes >= 0
        for i, zone in enumerate(known):
            rows = codes == i
            table = zone_transitions(zone) if isinstance(zone, str) else None
            if table is None:
                ok &= ~rows
            else:
                utc[rows], sure = local_to_utc(local[rows], table)
                ok[rows] &= sure
    return _stamp(utc, ok), utc, ok, np.full(n, 4)


def _stamp(s: np.ndarray, ok: np.ndarray) -> np.ndarray:
    return np.char.add(np.datetime_as_string(np.where(ok, s, 0).astype("datetime64[s]"), unit="s"), "Z")


def parse_times(text: pd.Series, zone: pd.Series, order: pd.Series) -> pd.DataFrame:
    """Normal form, precision (1 year, 2 month, 3 day, 4 time of day) and epoch of many texts; nulls where undetermined."""
    n = len(text)
    norm, epoch, precision = np.full(n, None, object), np.zeros(n, np.int64), np.zeros(n, np.int64)
    raw = text.to_numpy(object)
    known = [i for i in range(n) if isinstance(raw[i], str) and raw[i]]
    if known:
        table = str.maketrans(_CANON)
        tidy = [" ".join(t.split()) if ("  " in t or t[0] == " " or t[-1] == " ") else t for t in (raw[i].translate(table) for i in known)]
        masks = [t.translate(_SHAPES) for t in tidy]
        zones, orders = zone.to_numpy(object), order.to_numpy(object)
        groups: dict[tuple, list[int]] = {}
        spots: dict[str, list] = {}
        classes: dict[str, str] = {}
        for j, (t, m) in enumerate(zip(tidy, masks, strict=True)):
            if (at := spots.get(m)) is None:
                at = spots[m] = [x.span() for x in re.finditer("a+", m)]
            words = []
            for a, b in at:
                w = t[a:b]
                if (c := classes.get(w)) is None:
                    c = classes[w] = _word_class(w)
                words.append(c)
            groups.setdefault((m, tuple(words)), []).append(j)
        for (mask, words), members in groups.items():
            if "?" in words or not (plan := _plan(mask, words)):
                continue
            rows = np.array([known[j] for j in members])
            out, seconds, ok, kind = _group(*plan, [tidy[j] for j in members], zones[rows], orders[rows])
            good = rows[ok]
            norm[good], epoch[good], precision[good] = out[ok].astype(object), seconds[ok], kind[ok]
    none = precision == 0
    return pd.DataFrame(
        {"norm": norm, "precision": pd.array(np.where(none, 0, precision), "Int32"), "epoch": pd.array(epoch, "Int64")}
    ).mask(pd.Series(none), None)


NORMAL = T.StructType([T.StructField("norm", T.StringType()), T.StructField("precision", T.IntegerType()), T.StructField("epoch", T.LongType())])


@F.pandas_udf(NORMAL)
def _normalise(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for text, zone, order in batches:
        yield parse_times(text, zone, order)


def normal_time(text: Column, zone: Column, date_order: Column) -> Column:
    """A struct (norm, precision, epoch) for a text with a time in some notation.

    zone is the IANA zone that holds where the text names none; date_order (DMY or MDY) reads slashed days.
    Null, empty and very long texts, impossible dates, local times in a gap or an overlap, and texts without one
    determined meaning give a struct of nulls. Equal texts give equal results; row order and repeated rows don't matter.
    """
    return _normalise(text, zone, date_order)


@F.pandas_udf(T.StringType())
def _day_in_zone(epoch: pd.Series, zone: pd.Series) -> pd.Series:
    out = np.full(len(epoch), None, object)
    codes, known = pd.factorize(zone)
    seconds = epoch.fillna(0).astype("int64").to_numpy()
    for i, z in enumerate(known):
        table = zone_transitions(z)
        rows = (codes == i) & epoch.notna().to_numpy()
        if table is not None and rows.any():
            local = seconds[rows] + _offset_at(table, seconds[rows])
            out[rows] = np.datetime_as_string((local // 86400).astype("datetime64[D]"), unit="D").astype(object)
    return pd.Series(out)


def day_in_zone(time: Column, zone: Column) -> Column:
    """The day of a normal_time struct: its own for a date, else the day of the instant in the zone; null for coarser ones."""
    return F.when(time["precision"] == 4, _day_in_zone(time["epoch"], zone)).when(time["precision"] == 3, time["norm"])


def with_normal_time(
    df: DataFrame, text: Column, zone: Column, date_order: Column, out: str = "time_norm"
) -> DataFrame:
    """df with the normal form of a text of time in a new column (null where it has no determined meaning)."""
    return df.withColumn(out, normal_time(text, zone, date_order)["norm"])
