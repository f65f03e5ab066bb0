"""Quantities in different units and notations, converted to one unit each.

Numbers and unit expressions are read by small grammars. A unit is a vector of exponents over base dimensions with a
scale and, for temperatures, an offset; two units convert where their vectors agree, or where they differ only by mass
in the place of amount and the molar mass is known. A spelling with several readings (G/L: giga a litre, grams a litre)
keeps them all, and the reading that converts is taken. Scales are exact fractions.

One Arrow-batched pass converts the rows; distinct unit texts and pairs of units are parsed once a process.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A dimension: exponents of mass (g), amount (mol), length (m), time (s) and temperature (K).
NONE, MASS, AMOUNT, LENGTH, TIME, HEAT = (0,) * 5, (1, 0, 0, 0, 0), (0, 1, 0, 0, 0), (0, 0, 1, 0, 0), (0, 0, 0, 1, 0), (0, 0, 0, 0, 1)
VOLUME, CATALYSIS, MOLARITY = (0, 0, 3, 0, 0), (0, 1, 0, -1, 0), (0, 1, -3, 0, 0)
_LITRE, _ENZYME = Fraction(1, 1000), Fraction(1, 60_000_000)

# Units (a scale to the base units) and prefixes, by their spellings.
UNITS = {
    "g": (MASS, Fraction(1)), "gm": (MASS, Fraction(1)), "gram": (MASS, Fraction(1)), "grams": (MASS, Fraction(1)), "г": (MASS, Fraction(1)),
    "mol": (AMOUNT, Fraction(1)), "mole": (AMOUNT, Fraction(1)), "moles": (AMOUNT, Fraction(1)), "mols": (AMOUNT, Fraction(1)), "моль": (AMOUNT, Fraction(1)),
    "L": (VOLUME, _LITRE), "l": (VOLUME, _LITRE), "liter": (VOLUME, _LITRE), "litre": (VOLUME, _LITRE), "liters": (VOLUME, _LITRE), "litres": (VOLUME, _LITRE), "л": (VOLUME, _LITRE),
    "m": (LENGTH, Fraction(1)), "м": (LENGTH, Fraction(1)),
    "s": (TIME, Fraction(1)), "sec": (TIME, Fraction(1)), "secs": (TIME, Fraction(1)), "second": (TIME, Fraction(1)), "seconds": (TIME, Fraction(1)), "с": (TIME, Fraction(1)), "сек": (TIME, Fraction(1)),
    "U": (CATALYSIS, _ENZYME), "unit": (CATALYSIS, _ENZYME), "units": (CATALYSIS, _ENZYME), "Ед": (CATALYSIS, _ENZYME), "ед": (CATALYSIS, _ENZYME),
    "kat": (CATALYSIS, Fraction(1)), "кат": (CATALYSIS, Fraction(1)), "M": (MOLARITY, 1 / _LITRE),
}
WHOLE = {
    "min": (TIME, Fraction(60)), "mins": (TIME, Fraction(60)), "minute": (TIME, Fraction(60)), "minutes": (TIME, Fraction(60)), "мин": (TIME, Fraction(60)),
    "h": (TIME, Fraction(3600)), "hr": (TIME, Fraction(3600)), "hour": (TIME, Fraction(3600)), "hours": (TIME, Fraction(3600)), "ч": (TIME, Fraction(3600)),
    "%": (NONE, Fraction(1, 100)), "pct": (NONE, Fraction(1, 100)), "percent": (NONE, Fraction(1, 100)), "проц": (NONE, Fraction(1, 100)), "‰": (NONE, Fraction(1, 1000)), "promille": (NONE, Fraction(1, 1000)), "permille": (NONE, Fraction(1, 1000)),
    "fraction": (NONE, Fraction(1)), "ratio": (NONE, Fraction(1)),
}
# Words that only count or multiply.
FACTORS = {
    "cells": (NONE, Fraction(1)), "cell": (NONE, Fraction(1)), "thou": (NONE, Fraction(10**3)), "mill": (NONE, Fraction(10**6)), "mio": (NONE, Fraction(10**6)), "K": (NONE, Fraction(10**3)), "M": (NONE, Fraction(10**6)), "G": (NONE, Fraction(10**9)), "T": (NONE, Fraction(10**12)),
}
PREFIXES = {
    "p": -12, "pico": -12, "п": -12, "n": -9, "nano": -9, "н": -9, "u": -6, "mc": -6, "micro": -6, "мк": -6,
    "m": -3, "milli": -3, "м": -3, "c": -2, "d": -1, "deci": -1, "д": -1, "k": 3, "kilo": 3, "к": 3,
}
# Temperatures, as scale and offset to kelvin.
HEATS = {
    "cel": (Fraction(1), Fraction(27315, 100)), "°c": (Fraction(1), Fraction(27315, 100)), "degc": (Fraction(1), Fraction(27315, 100)), "celsius": (Fraction(1), Fraction(27315, 100)), "c": (Fraction(1), Fraction(27315, 100)),
    "degreescelsius": (Fraction(1), Fraction(27315, 100)), "[degf]": (Fraction(5, 9), Fraction(45967, 180)), "°f": (Fraction(5, 9), Fraction(45967, 180)), "degf": (Fraction(5, 9), Fraction(45967, 180)), "fahrenheit": (Fraction(5, 9), Fraction(45967, 180)), "f": (Fraction(5, 9), Fraction(45967, 180)),
    "k": (Fraction(1), Fraction(0)), "kelvin": (Fraction(1), Fraction(0)),
}
_SUPER = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")
_GLYPHS = str.maketrans({"µ": "u", "μ": "u", "×": "x", "⋅": "·", "∙": "·", "•": "·", "−": "-", "–": "-", "\xa0": " ", " ": " ", " ": " ", "\xad": None, "℃": "°C", "℉": "°F", "º": "°"})
_NOTES = re.compile(r"\((?:calc\.?|auto|lab|est\.?)\)\s*$", re.I)
_LEAD = re.compile(r"^(?:units?\s*[:=]|in\b|einheit\s*[:=])\s*", re.I)
_POWER = re.compile(r"(?:x\s*)?10\s*(?:\*\*?|\^|[eE])\s*([-+]?\d+)")
_PLAIN = re.compile(r"(?:x\s*)?(1(?:[ ,]?0)+)(?![\d*^])")
_WORD = re.compile(r"([^\W\d_]+|%|‰)\.?(?:\^?([-+]?\d+))?")

Reading = tuple[tuple[int, ...], Fraction, Fraction]


def _times(a: tuple, b: tuple, n: int = 1) -> tuple:
    return tuple(x + n * y for x, y in zip(a, b, strict=True))


def _word_readings(word: str) -> list[tuple[tuple, Fraction, bool]]:
    """All readings of one symbol, and whether it is a unit by itself: as it is written first, then in lower case."""
    found = []
    for w in dict.fromkeys((word, word.lower(), *(("U",) if word == "u" else ()))):
        if w in FACTORS:
            found.append((*FACTORS[w], False))
        if w in WHOLE:
            found.append((*WHOLE[w], True))
        if w in UNITS:
            found.append((*UNITS[w], True))
        for k in range(1, min(6, len(w))):
            if w[:k] in PREFIXES:
                rest = UNITS.get(w[k:]) or (UNITS["U"] if w[k:] == "u" and w is not word else None)
                if rest:
                    found.append((rest[0], rest[1] * Fraction(10) ** PREFIXES[w[:k]], True))
    return list(dict.fromkeys(found))


def tidy_unit(text: str) -> str:
    """A unit text without brackets, lead-ins, notes and look-alike glyphs."""
    t = text.translate(_GLYPHS).strip()
    t = re.sub(r"[⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺]+", lambda m: "^" + m[0].translate(_SUPER), t)
    for _ in range(3):
        t = _LEAD.sub("", _NOTES.sub("", t)).strip()
        if len(t) > 2 and (t[0], t[-1]) in (("(", ")"), ("[", "]")) and t.lower() != "[degf]":
            t = t[1:-1].strip()
    return t


@lru_cache(65536)
def read_unit(text: str) -> tuple[Reading, ...]:
    """All readings (dimension, scale, offset) of a unit text; none where it is no unit expression."""
    if not text or not (t := tidy_unit(text)):
        return ()
    found: list[Reading] = []
    if (heat := HEATS.get(re.sub(r"[\s.]+", "", t.lower()))) is not None:
        found.append((HEAT, *heat))
    t = re.sub(r"\bper mille\b|\bпромилле\b", "‰", t)
    t = re.sub(r"\bcubic (\w+)", r"\1^3", t)
    t = re.sub(r"\s*\bper\b\s*", "/", t)
    t = re.sub(r"^([^\W\d_]+)%$", r"\1/100mL", t)
    parts, sign, at, bare = [], 1, 0, False
    while at < len(t):
        c = t[at]
        if c in "·* .":
            at += 1
        elif c == "/":
            if sign < 0:
                return tuple(found)
            sign, at, bare = -1, at + 1, True
        elif (m := _POWER.match(t, at)) and len(m[1]) <= 4:
            parts.append([(NONE, Fraction(10) ** (sign * int(m[1])), False)])
            at, bare = m.end(), False
        elif m := _PLAIN.match(t, at):
            parts.append([(NONE, Fraction(int(re.sub(r"\D", "", m[1]))) ** sign, False)])
            at = m.end()
        elif m := _WORD.match(t, at):
            if not (readings := _word_readings(m[1])):
                return tuple(found)
            if len(m[2] or "") > 4 or abs(n := sign * int(m[2] or 1)) > 4:
                return tuple(found)
            parts.append([(tuple(n * x for x in d), s**n, real) for d, s, real in readings])
            at, bare = m.end(), False
        else:
            return tuple(found)
    if bare:
        return tuple(found)
    combos = [(NONE, Fraction(1), False)]
    for part in parts:  # equal products are kept once, so their number doesn't grow with the power of the factors
        combos = list(dict.fromkeys((_times(d, x), s * y, is_unit or real) for d, s, is_unit in combos for x, y, real in part))
    found += [(d, s, Fraction(0)) for d, s, is_unit in combos if is_unit]
    return tuple(dict.fromkeys(found))


@lru_cache(65536)
def conversion(text: str, target: str, molar_mass: float | None) -> tuple[Fraction, Fraction] | None:
    """Scale and offset that carry a number in a unit text to the target unit; None where it doesn't convert."""
    goals = read_unit(target)
    for goal in goals[:1]:
        for d, s, o in read_unit(text):
            if d == goal[0]:
                return s / goal[1], (o - goal[2]) / goal[1]
            if molar_mass and d[2:] == goal[0][2:] and d[3] == 0:
                grams = Fraction(str(molar_mass))
                if _times(d, MASS) == _times(goal[0], AMOUNT):
                    return s * grams / goal[1], Fraction(0)
                if _times(d, AMOUNT) == _times(goal[0], MASS):
                    return s / grams / goal[1], Fraction(0)
    return None


# A number: a sign of comparison, digits (perhaps grouped), a power of ten.
_SIGN = r"\s*(?:<=|>=|=<|=>|[<>≤≥≦≧⩽⩾~≈=])?\s*"
_TAIL = r"(?:\s*(?:[eE]([-+]?\d{1,3})(?![\d.,])|[x×·*]\s*10\s*(?:\^|\*\*|\*)\s*([-+]?\d{1,3})(?!\d)(?!\s*/)))?"
_FLAG = re.compile(r"^\s*(?:\*+|(?:\(?\s*(?:[HLhl]{1,2}|high|low)\s*\)?))?\s*$")
_FLAGGED = re.compile(r"\s*(?:\*+|\((?:HH?|LL?)\)|(?<=[\s\d])HH?|(?<=\s)LL?)\s*$")


@lru_cache(8)
def _number(mark: str) -> re.Pattern:
    other = "," if mark == "." else "."
    groups = "|".join(rf"\d{{1,3}}(?:{g}\d{{3}})+(?!\d)" for g in (re.escape(other), r"[    ]", "['’]"))
    return re.compile(rf"^{_SIGN}([-+]?(?:(?:{groups}|\d+)(?:{re.escape(mark)}\d+)?|{re.escape(mark)}\d+)){_TAIL}(.*)$", re.S)


_SUPERSCRIPT = re.compile(r"(10)([⁰¹²³⁴⁵⁶⁷⁸⁹⁻]+)(?=\s|$|\*|H)")


def read_number(text: str, mark: str) -> tuple[Fraction, str] | None:
    """The one number at the head of a text and what follows it; None for a range, words or broken notation.

    mark is the decimal mark; the other of point and comma, a blank or an apostrophe may group thousands.
    """
    t = text.replace("−", "-").strip()
    if not t or not (m := _number(mark).match(t)):
        return None
    digits = re.sub(r"[^\d.+-]", "", m[1].replace(mark, "\0").replace(".", "").replace("\0", "."))
    rest, power = m[4], int(m[2] or m[3] or 0)
    if rest and (rest[0].isdigit() or rest[0] in ".,'’" and rest[1:2].isdigit()):
        return None
    if re.match(r"\s*(?:[-–—…]|\.\.|to\b|bis\b|±|\+/-)\s*\d", rest):
        return None
    return Fraction(Decimal(digits)) * Fraction(10) ** power, rest


def convert(text: str | None, mark: str | None, places: list[str | None], target: str | None, molar_mass: float | None) -> Fraction | None:
    """The value of a text in the target unit, its unit being looked for behind the number, then in the other places."""
    if not text or not target or not (read := read_number(text, mark if mark in (".", ",") else ".")):
        return None
    number, rest = read
    if rest.strip() and not _FLAG.match(rest):
        own = conversion(rest.strip(), target, molar_mass) or conversion(_FLAGGED.sub("", rest).strip(), target, molar_mass)
        if own:
            return number * own[0] + own[1]
        if not read_unit(_FLAGGED.sub("", rest).strip()) and re.search(r"\d", rest):
            return None
    for place in places:
        if place and place.strip() and (known := conversion(place.strip(), target, molar_mass)):
            return number * known[0] + known[1]
    return None


@F.pandas_udf(T.LongType())
def _milli(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for text, mark, target, mass, *places in batches:
        out = np.full(len(text), None, object)
        masses = [None if m is None or m != m else m for m in mass.tolist()]
        for i, (t, k, u, m, *p) in enumerate(zip(text, mark, target, masses, *places, strict=True)):
            if (v := convert(t, k, p, u, m)) is not None and abs(r := round(v * 1000)) < 2**63:
                out[i] = r
        yield pd.Series(out, dtype="Int64")


def value_milli(text: Column, mark: Column, target: Column, molar_mass: Column, *places: Column) -> Column:
    """A thousandth-unit integer: the text's number in the target unit times 1,000, rounded to the nearest integer.

    Null where the text gives no single number or no place names a unit that converts. A sign of comparison is ignored.
    Null inputs and empty texts give null, texts of any length are read whole; an unknown mark is read as a point.
    """
    return _milli(text, mark, target, molar_mass.cast("double"), *places)


#: A unit at the end of a label is sought within so many characters of its end.
LONGEST_UNIT = 300
_CUTS = re.compile(r"\s+in\s+|,\s*|\s*[\[(]\s*|:\s*|\s+")


@lru_cache(65536)
def split_label(label: str) -> tuple[str, str | None]:
    """A label such as "Name, free [mg/L]" cut into the name and the unit at its end, if one stands there."""
    t = label.strip()
    for m in _CUTS.finditer(t, max(0, len(t) - LONGEST_UNIT)):
        head, tail = t[: m.start()].rstrip(" ,:-"), t[m.end() :].strip()
        if head and tail and read_unit(tail if tail[-1:] not in "])" or tail.count("(") + tail.count("[") else tail[:-1]):
            return head, tail[:-1] if tail[-1:] in "])" and not tail.count("(") + tail.count("[") else tail
    return t, None


LABEL = T.StructType([T.StructField("name", T.StringType()), T.StructField("unit", T.StringType())])


@F.pandas_udf(LABEL)
def _label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        yield pd.DataFrame([split_label(x) if isinstance(x, str) else (x, None) for x in s], columns=["name", "unit"])


def label_parts(label: Column) -> Column:
    """A struct (name, unit) of a label of any length; a null label gives nulls."""
    return _label(label)
