"""Freely typed names mapped to a canonical list, or reported as unmatched.

A reference name is stored under all strings that arise from it by deleting up to two characters (symmetric deletion);
a typed name probes with its own deletions, so every entry within two edits is found without comparing all pairs. The
candidates are ranked by a weighted Damerau-Levenshtein distance, in which usual slips are cheap, and then by how often
an entry is used. The dictionary is broadcast while the list has at most broadcast_limit entries; beyond it, the same
strings of both sides meet in a join.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.session import bounded_rows

EDITS = 2
BROADCAST_LIMIT = 20_000
#: Names of more letters than this match without edits only: their deletions would grow with the square of their length.
MOST_LETTERS = 200

# Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "і": "i", "ј": "j", "ѕ": "s", "ο": "o", "α": "a"}
# Short forms of qualifiers.
QUALIFIERS = {
    "free": ["free", "fr", "fre"], "total": ["total", "tot", "ttl"], "bound": ["bound", "bd", "bnd"], "acid": ["acid", "ac"],
    "beta": ["beta", "β", "b"], "alpha": ["alpha", "α", "a"], "antibody": ["antibody", "antib", "ab", "abs"],
}
# Words around a name that say nothing of which entry is meant.
NOISE = {"test", "level", "of", "conc", "concentration", "fasting", "repeat", "method", "mass", "vol", "subst", "measured", "serum", "plasma", "urine", "blood", "whole"}
METHODS = re.compile(r"[,;]?\s*\b\w+\s+method\b", re.I)
SPECIMEN = re.compile(r"^\s*(?:f?[sp]|[ubf]|wb|csf)-(?=\w)", re.I)
COMPUTED = re.compile(r"\bratio\b|\bindex\b|\bquotient\b|\bgap\b|\bsum of\b|\bdifference\b|\w\s*[/:]\s*\w", re.I)
# Characters that scanners and typists confuse.
CONFUSED = [("0", "o"), ("1", "l"), ("1", "i"), ("i", "l"), ("5", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("2", "z")]
_CHEAP = {frozenset(p) for p in CONFUSED}
_SHORT_FORM = {s: q for q, forms in QUALIFIERS.items() for s in forms}


_ALIKE = {v: k for k, v in reversed(LOOKALIKES.items()) if k in "аеорсхукмтнвіјѕ"}


def _one_script(word: str) -> str:
    """A word in one script: the one of its unmistakable letters, or Cyrillic where a single letter of it is Latin."""
    latin = [c for c in word if "a" <= c <= "z"]
    cyrillic = [c for c in word if "а" <= c <= "ё"]
    sure_latin, sure_cyrillic = sum(c not in _ALIKE or c in "ijs" for c in latin), sum(c not in LOOKALIKES for c in cyrillic)
    if sure_cyrillic > sure_latin or len(latin) == 1 and len(cyrillic) >= 4:
        return "".join(_ALIKE.get(c, c) for c in word)
    return "".join(LOOKALIKES.get(c, c) for c in word) if latin or not sure_cyrillic and len(word) <= 4 else word


def fold(text: str) -> str:
    """Lower case without marks that are not seen, each word in one script."""
    t = unicodedata.normalize("NFKC", text).casefold()
    t = "".join(c for c in t if unicodedata.category(c) != "Cf")
    t = re.sub(r"[^\W\d_]+", lambda m: m[0] if m[0].isascii() or m[0] in "αβ" else _one_script(m[0]), t)
    return re.sub(r"\s+", " ", t).strip()


def plain(name: str) -> str:
    """A name's letters, digits read as the letters they look like."""
    return re.sub(r"[\W_]+", "", name).replace("0", "o").replace("1", "l").replace("5", "s")


def shape(name: str) -> str:
    """plain, with rn read as m: what two spellings are compared by first."""
    return plain(name).replace("rn", "m")


@dataclass(frozen=True)
class Typed:
    """A typed text: its letters, its qualifier, whether it ends in an abbreviation point, its letters as a code."""

    letters: str
    qualifier: str
    short: bool
    code: str


def read_typed(text: str) -> Typed | None:
    """The parts of a typed text; None where it is blank or names something computed."""
    t = fold(text)
    t = re.sub(r"\[[^\]]*\]|\((?:serum|plasma|urine|whole blood|blood)\)", " ", t)
    t = METHODS.sub(" ", re.sub(r"^\s*test\s*:\s*", "", t))
    if COMPUTED.search(t):
        return None
    t = SPECIMEN.sub("", t.strip(" *"))
    if re.fullmatch(r"(?:\w\.){2,}\w?\.?", t):
        return Typed("", "", False, t.replace(".", ""))
    qualifier, words, points = "", [], []
    for m in re.finditer(r"([^\s,;()\-*.]+)(\.*)", t):
        w = m[1]
        if w in NOISE:
            continue
        if w in _SHORT_FORM and not qualifier and (len(w) > 1 or w in "βα" or m[2]):
            qualifier = _SHORT_FORM[w]
            continue
        words.append(w)
        points.append(bool(m[2]))
    letters = "".join(words)
    return Typed(letters, qualifier, bool(points) and points[-1], letters) if letters else None


def deletions(word: str, edits: int = EDITS) -> set[str]:
    """A word and all words that arise from it by deleting up to so many characters."""
    found, last = {word}, {word}
    for _ in range(min(edits, max(0, len(word) - 2))):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        found |= last
    return found


def allowed(length: int) -> int:
    """The edits that a name of so many letters may have."""
    return 0 if length < 4 or length > MOST_LETTERS else 1 if length < 6 else EDITS


def stored(name: str) -> set[str]:
    """The strings under which a reference name's letters are stored: deletions, and beginnings for abbreviations."""
    out = set()
    for s in {shape(name), plain(name)}:
        out |= {"=" + x for x in deletions(s, allowed(len(s)))}
        for k in range(4, min(len(s), MOST_LETTERS + 1)):
            out |= {"<" + x for x in deletions(s[:k], 1 if k >= 6 else 0)}
    return out


def probed(typed: Typed) -> set[str]:
    """The strings by which a typed name looks."""
    out = set()
    for s in {shape(typed.letters), plain(typed.letters)} - {""}:
        out |= {"=" + x for x in deletions(s, allowed(len(s)))}
        if typed.short and 4 <= len(s) <= MOST_LETTERS:
            out |= {"<" + x for x in deletions(s, 1 if len(s) >= 6 else 0)}
    return out


def distance(a: str, b: str, most: float = EDITS + 0.5) -> float:
    """Weighted Damerau-Levenshtein distance (adjacent transpositions), above most where it is larger.

    Confusable characters cost 0.3, a doubled or undoubled letter 0.6, swapped neighbours 0.8, one vowel for another 0.9.
    """
    if abs(len(a) - len(b)) > EDITS:
        return most + 1
    vowels = "aeiouy"
    rows = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                rows[i][j] = float(i + j)
                continue
            x, y = a[i - 1], b[j - 1]
            swap = 0.0 if x == y else 0.3 if frozenset((x, y)) in _CHEAP else 0.9 if x in vowels and y in vowels else 1.0
            best = min(
                rows[i - 1][j - 1] + swap,
                rows[i - 1][j] + (0.6 if i > 1 and a[i - 2] == x else 1.0),
                rows[i][j - 1] + (0.6 if j > 1 and b[j - 2] == y else 1.0),
            )
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                best = min(best, rows[i - 2][j - 2] + 0.8)
            if i > 2 and j > 1 and x == b[j - 2] and a[i - 3] == y and x != y:
                best = min(best, rows[i - 3][j - 2] + 1.8)
            if i > 1 and j > 2 and x == b[j - 3] and a[i - 2] == y and x != y:
                best = min(best, rows[i - 2][j - 3] + 1.8)
            rows[i][j] = best
    return rows[-1][-1]


def cost(typed: Typed, name: str) -> float | None:
    """How far a typed name is from a reference name; None where they are not the same."""
    raw, ref = plain(typed.letters), plain(name)
    s, r = shape(raw), shape(ref)
    if s == r:
        return 0.0
    best, most = None, min(allowed(len(raw)), allowed(len(ref)))
    if most and (d := min(distance(s, r), distance(raw, ref))) <= most:
        best = d
    if typed.short and len(s) <= MOST_LETTERS and 4 <= len(s) < len(r):
        d = min(distance(x, y[:k]) for x, y in {(s, r), (raw, ref)} for k in range(max(4, len(x) - 1), min(len(y), len(x) + 1) + 1))
        if d == 0 or d <= 1 and len(s) >= 6:
            best = min(0.5 + 1.2 * d, best if best is not None else 9.0)
    return best


@dataclass
class Dictionary:
    """The reference list: names of each base, keys by base and qualifier, codes, and how often a key is used."""

    bases: dict[str, list[str]] = field(default_factory=lambda: defaultdict(list))
    keys: dict[tuple[str, str], str] = field(default_factory=dict)
    codes: dict[str, str] = field(default_factory=dict)
    often: dict[str, int] = field(default_factory=dict)
    index: dict[str, list[tuple[str, str]]] = field(default_factory=lambda: defaultdict(list))

    def build(self) -> Dictionary:
        for base, names in self.bases.items():
            for name in dict.fromkeys(names):
                for s in stored(name):
                    self.index[s].append((base, name))
        return self

    def look(self, text: str) -> str | None:
        """The key that a text means, or None."""
        typed = read_typed(text)
        if typed is None:
            return None
        if (code := self.codes.get(typed.code)) and not typed.qualifier:
            return code
        pairs = {pair for s in probed(typed) for pair in self.index.get(s, ())} if typed.letters else set()
        ranked = []
        for base, name in pairs:
            if (c := cost(typed, name)) is not None:
                key = self.keys.get((base, typed.qualifier))
                ranked.append((round(c, 3), -self.often.get(key or "", 0), base, key))
        return min(ranked)[3] if ranked else None


def split_reference(name: str) -> tuple[str, str]:
    """A reference name cut into its base and its qualifier."""
    base, _, rest = fold(name).partition(",")
    return base.strip(), _SHORT_FORM.get(rest.strip(), rest.strip())


def reference_rows(catalog: DataFrame, key: str, name: str, code: str, synonyms: str) -> DataFrame:
    """The columns of a reference list that the dictionary is built from; rows without a key or a name are left out."""
    return catalog.select(F.col(key).alias("key"), F.col(name).alias("name"), F.col(code).alias("code"), F.col(synonyms).alias("synonyms")).where("key is not null and name is not null")


def _dictionary(rows: Iterable, often: dict[str, int]) -> Dictionary:
    out = Dictionary(often=often)
    for r in sorted(rows, key=lambda r: r["key"]):
        base, qualifier = split_reference(r["name"])
        out.keys.setdefault((base, qualifier), r["key"])
        out.bases[base] += [base, *(fold(s) for s in r["synonyms"] or [] if s)]
        if r["code"]:
            out.codes.setdefault(fold(r["code"]), r["key"])
    return out


ENTRY = T.StructType([T.StructField("key", T.StringType())])


def map_names(
    typed: DataFrame, text: str, reference: DataFrame, usage: DataFrame, out: str = "mapped_key", broadcast_limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """typed with the reference key that each text means in a new column, null where it means none.

    reference comes from reference_rows; usage has (key, n), how often a key is used, for ties. Null and
    blank texts and texts that name something computed give null; texts of any length are read whole. Every row is kept, repeated
    rows alike; an empty list gives nulls. Ties go to the more often used key, then to the first base in order.
    """
    spark = typed.sparkSession
    # a name of n letters has some n * n deletions
    letters = F.aggregate(F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>"))), F.lit(0).cast("bigint"), lambda n, x: n + F.coalesce(F.length(x), F.lit(0)) * F.least(F.coalesce(F.length(x), F.lit(0)), F.lit(MOST_LETTERS)))
    rows = bounded_rows(reference, broadcast_limit, "reference", letters)
    if rows is None:
        return _map_by_join(typed, text, reference, usage, out)
    counts = {r["key"]: r["n"] for r in usage.join(F.broadcast(reference.select("key").distinct()), "key").collect()}
    shared = spark.sparkContext.broadcast(_dictionary(rows, counts).build())

    @F.pandas_udf(T.StringType())
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str | None] = {}
        for texts in batches:
            if len(known) > 500_000:
                known.clear()
            for t in texts.unique():
                if isinstance(t, str) and t not in known:
                    known[t] = shared.value.look(t)
            yield texts.map(known).astype(object).where(texts.notna(), None)

    return typed.withColumn(out, look(F.col(text)))


TYPED = T.StructType(
    [T.StructField("letters", T.StringType()), T.StructField("qualifier", T.StringType()), T.StructField("code", T.StringType()), T.StructField("probes", T.ArrayType(T.StringType()))]
)
NAME = T.StructType([T.StructField("base", T.StringType()), T.StructField("qualifier", T.StringType()), T.StructField("names", T.ArrayType(T.StringType())), T.StructField("code", T.StringType())])


@F.pandas_udf(TYPED)
def _typed_parts(s: pd.Series) -> pd.DataFrame:
    parts = [read_typed(x) if isinstance(x, str) else None for x in s]
    return pd.DataFrame([(p.letters, p.qualifier, p.code, sorted(probed(p))) if p else (None, None, None, []) for p in parts], columns=TYPED.names)


@F.pandas_udf(NAME)
def _reference_parts(name: pd.Series, synonyms: pd.Series, code: pd.Series) -> pd.DataFrame:
    out = []
    for n, s, c in zip(name, synonyms, code, strict=True):
        base, qualifier = split_reference(n)
        out.append((base, qualifier, [base, *(fold(x) for x in (s if s is not None else []) if x)], fold(c) if c else None))
    return pd.DataFrame(out, columns=NAME.names)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stored(name: pd.Series) -> pd.Series:
    return pd.Series([sorted(stored(n)) for n in name])


@F.pandas_udf(T.DoubleType())
def _cost(text: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([cost(read_typed(t), n) for t, n in zip(text, name, strict=True)], dtype="float64")


def _map_by_join(typed: DataFrame, text: str, reference: DataFrame, usage: DataFrame, out: str) -> DataFrame:
    """map_names for a list of any size: each distinct text once, its deletions joined with those of the names."""
    texts = typed.select(F.col(text).alias("_text")).where("_text is not null").distinct().withColumn("_p", _typed_parts(F.col("_text"))).select("_text", "_p.*")
    parts = reference.withColumn("_r", _reference_parts("name", "synonyms", "code")).select("key", "_r.*")
    keys = parts.groupBy("base", "qualifier").agg(F.min("key").alias("key"))
    codes = parts.where("code is not null").groupBy("code").agg(F.min("key").alias("key"))
    names = parts.select("base", F.explode("names").alias("name")).distinct().withColumn("probe", F.explode(_stored("name")))
    found = texts.where("letters != ''").select("_text", "qualifier", F.explode("probes").alias("probe")).join(names, "probe")
    found = found.select("_text", "qualifier", "base", "name").distinct().withColumn("_cost", F.round(_cost("_text", "name"), 3)).where("_cost is not null")
    found = found.join(keys, ["base", "qualifier"], "left").join(usage, "key", "left")
    best = found.groupBy("_text").agg(F.min_by("key", F.struct("_cost", -F.coalesce("n", F.lit(0)), "base")).alias("_best"))
    coded = texts.where("qualifier = ''").join(codes, "code").select("_text", F.col("key").alias("_coded"))
    answer = best.join(coded, "_text", "full_outer").select(F.col("_text").alias("__typed_text__"), F.coalesce("_coded", "_best").alias("__mapped_key__"))
    joined = typed.join(answer, F.col(text) == F.col("__typed_text__"), "left").withColumn(out, F.col("__mapped_key__"))
    return joined.drop("__typed_text__", "__mapped_key__")
