"""Passages of held-out test items found in a corpus.

The normalised word windows (n-grams) of all test items form a hash set that is broadcast; every window of every
document is looked up in it, in one pass over the corpus without a shuffle. A document that shares enough windows which
only few items have is verified at once: the share of the item's case that the document repeats, wherever and in
whatever order, and the share of the item's own names and figures. Where the windows are too many to broadcast, the
same windows of both sides meet in a join.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.session import bounded_rows, cut

N = 3
#: A window that more cases have than this is a turn of phrase, not a passage.
FEW = 2
#: Windows of few items that a document has to share with an item before it is verified.
HITS = 4
#: A case of fewer words than this is found only where it stands whole and in order: any part of it is a short quote.
SHORT = 10
#: The share of a case's words that must be repeated; a little under two fifths, for words that were retouched.
SHARE = 0.36
#: The share of a case's own words (names, figures) that must be repeated.
OWN = 0.35
#: Else the share of the own words in and next to the repeated part that stand in it, and how many words are next to it.
OWN_PART, NEXT_TO = 0.5, 3
#: A sentence that stands in so many items is an instruction.
INSTRUCTION = 5
#: Own words of a case at least; where fewer are held by few items, the rarest are taken.
LEAST_OWN = 5
BROADCAST_ITEMS = 20_000

# Letters of other scripts that look like Latin ones.
_ALIKE = str.maketrans("аеорсухіјѕкмтнвАЕОРСУХІЈЅКМТНВΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "aeopcyxijskmthbAEOPCYXIJSKMTHBABEZHIKMNOPTYXo")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_MARKUP = re.compile(r"<[^>]{1,200}>|&nbsp;|&#160;")
_BROKEN = re.compile(r"(?<=\w)-\s*\n\s*(?=\w)")
_WORD = re.compile(r"[^\W_]+")
_NEXT = "␞"
_ODD = re.compile("[Ѐ-ӿͰ-Ͽ！-｠̀-ͯ]|[ﬀ-ﬆ]")
_OPTIONS = re.compile(r"\s*(?:\(A\)|\bA[.)]|\(a\))\s.*?(?:\(B\)|\bB[.)]|\(b\))\s.*$", re.S)


def _tidy(text: str) -> str:
    """A text without markup, hidden characters, look-alike letters and line-end hyphens."""
    if not text.isascii():
        text = _HIDDEN.sub("", text)
        if _ODD.search(text):
            text = unicodedata.normalize("NFKC", text).translate(_ALIKE)
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text).replace("&amp;", "&")
    if "-\n" in text:
        text = _BROKEN.sub("", text)
    return text


def words(text: str) -> list[str]:
    """The words of a tidied text in lower case."""
    return _WORD.findall(_tidy(text).lower())


def windows(ws: list[str]) -> Iterator[tuple[str, ...]]:
    return zip(*(ws[i:] for i in range(N)), strict=False)


def _sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.?!;:])\s+", text.strip()) if s]


def usual(sentences: list[str], often: list[int]) -> str | None:
    """The sentence in the middle of a text's words, when sentences are ordered by how many items have them."""
    ranked = sorted((n, s, len(words(s))) for s, n in zip(sentences, often, strict=True))
    total, half = sum(k for *_, k in ranked), 0
    for _, s, k in ranked:
        half += k
        if 2 * half >= total:
            return s
    return None


def instructions(said: dict[int, list[str]]) -> set[str]:
    """Sentences (in lower case) that many items share: most items that have one share it with many items of another case.

    Copies and variants of a case share its sentences too, so items that have the same usual sentence don't count.
    """
    holders = defaultdict(set)
    for i, ss in said.items():
        for s in ss:
            holders[s].add(i)
    apart, middle = Counter(), {i: usual(ss, [len(holders[s]) for s in ss]) for i, ss in said.items()}
    common = {}
    for i, ss in said.items():
        for s in set(ss):
            if len(holders[s]) >= INSTRUCTION:
                if (at := (s, middle[i])) not in common:
                    common[at] = len(holders[s] & holders[middle[i]])
                apart[s] += len(holders[s]) - common[at] >= INSTRUCTION - 1
    return {s for s, n in apart.items() if 2 * n >= len(holders[s])}


def case_texts(items: list[tuple[int, str]]) -> dict[int, str]:
    """Each item's case: its text without sentences that many items share (instructions) and without lettered options."""
    said = {i: _sentences(_OPTIONS.sub("", t)) for i, t in items}
    shared = instructions({i: [s.lower() for s in ss] for i, ss in said.items()})
    return {i: " ".join([s for s in ss if s.lower() not in shared] or ss) for i, ss in said.items()}


def indexed(grams: list, held: list[int], n: int) -> list:
    """The windows by which a case of n words is looked up: the ones of few cases, or all of them where some stretch
    that is long enough to be found has too few of those."""
    seen, rare = set(), []
    for g, h in zip(grams, held, strict=True):
        rare.append(h <= FEW and g not in seen)
        seen.add(g)
    size = min(len(rare), max(1, int(np.ceil(SHARE * n)) - N + 1))
    sums = np.concatenate([[0], np.cumsum(rare)])
    if n < SHORT or len(rare) and (sums[size:] - sums[: len(sums) - size]).min() < HITS:
        return list(seen)
    return [g for g, r in zip(grams, rare, strict=True) if r]


@dataclass
class Items:
    """The different cases of all items, which items have each, and the windows by which they are looked up."""

    cases: dict[int, list[str]]
    own: dict[int, frozenset[str]]
    index: dict[tuple[str, ...], tuple[int, ...]]
    members: dict[int, tuple[int, ...]]

    def least(self, item: int) -> int:
        """The windows that a text has to share with a case before it is verified."""
        return min(HITS, max(1, len(set(windows(self.cases[item])))))

    @staticmethod
    def build(items: list[tuple[int, str]]) -> Items:
        classes, held, words_in = defaultdict(list), Counter(), Counter()
        for i, t in case_texts(items).items():
            if case := tuple(words(t)):
                classes[case].append(i)
        for case in classes:
            words_in.update(set(case))
            held.update(set(windows(case)))
        cases, own, index = dict(enumerate(map(list, classes))), {}, defaultdict(list)
        for c, ws in cases.items():
            counts = sorted(words_in[w] for w in set(ws))
            most = max(FEW, counts[min(LEAST_OWN, len(counts)) - 1])
            own[c] = frozenset(w for w in ws if words_in[w] <= most)
            grams = list(windows(ws))
            for g in indexed(grams, [held[g] for g in grams], len(ws)):
                index[g].append(c)
        return Items(cases, own, {g: tuple(h) for g, h in index.items()}, {c: tuple(sorted(m)) for c, m in enumerate(classes.values())})

    def verify(self, item: int, ws: list[str]) -> bool:
        """Whether a document's words repeat enough of an item's case.

        A whole passage may hold few of the case's own words, so those in and next to what is repeated may be enough: in
        a similar case with other names and figures, they stand next to it and are not repeated.
        """
        case, own = self.cases[item], self.own[item]
        if not case:
            return False
        if len(case) < SHORT:
            return any(ws[k : k + len(case)] == case for k, w in enumerate(ws) if w == case[0])
        have, near = set(windows(ws)), set(zip(ws, ws[2:], strict=False)) | set(zip(ws, ws[1:], strict=False))
        n = len(case)
        covered = bytearray(n)
        for k in range(n - N + 1):
            if tuple(case[k : k + N]) in have:
                covered[k : k + N] = b"\1" * N
        for k in range(n - 2):  # one word changed between two that stand: both sides must be next to repeated text
            if not covered[k + 1] and (covered[k] or covered[k + 2]) and (case[k], case[k + 2]) in near:
                covered[k + 1] = 1
        seen = set(ws)
        if sum(covered) < SHARE * n:
            return False
        if sum(w in seen for w in own) >= OWN * len(own):
            return True
        told = {w for w, c in zip(case, covered, strict=True) if c and w in own and w in seen}
        close = {w for k, w in enumerate(case) if w in own and any(covered[max(0, k - NEXT_TO) : k + NEXT_TO + 1])}
        return bool(told) and len(told) >= OWN_PART * len(close)


class Scanner:
    """Looks every window of many texts up at once: pieces between white space become numbers of item words.

    A piece is read once and kept; words that no item has are 0, and no window with a 0 is an item's.
    """

    def __init__(self, items: Items, limit: int = 300_000):
        self.items, self.limit = items, limit
        self.number = {w: n for n, w in enumerate(sorted({w for ws in items.cases.values() for w in ws}), 1)}
        self.base = len(self.number) + 1
        codes = sorted((self._code([self.number[w] for w in g]), h) for g, h in items.index.items())
        self.codes, self.holders = np.array([c for c, _ in codes], np.int64), [h for _, h in codes]
        self._reset()

    def _reset(self) -> None:
        self.known, self.runs = _Pieces(self), [[0]]

    def _code(self, numbers) -> int:
        code = 0
        for n in numbers:
            code = code * self.base + int(n)
        return code

    def read(self, piece: str) -> int:
        ws = _WORD.findall(piece.lower())
        if len(ws) == 1 and ws[0] not in self.number:
            return 0
        self.runs.append([self.number.get(w, 0) for w in ws])
        return len(self.runs) - 1

    def hits(self, texts: list[str]) -> dict[int, Counter]:
        """For each text with a window of some item, how many such windows it shares with which items."""
        pieces = f" {_NEXT} ".join([*(_tidy(t).replace(_NEXT, " ") for t in texts), ""]).split()
        if len(self.known) > self.limit:
            self._reset()
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        text = np.cumsum(at < 0)
        at = np.maximum(at, 0)
        sizes = np.array([len(r) for r in self.runs])
        flat, first = np.concatenate([np.array(r, np.int64) for r in self.runs]), np.cumsum(sizes) - sizes
        n = sizes[at]
        ends = np.cumsum(n)
        numbers = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[at] - ends + n, n)]
        text = np.repeat(text, n)
        if len(numbers) < N or not len(self.codes):
            return {}
        code, whole = np.zeros(len(numbers) - N + 1, np.int64), np.ones(len(numbers) - N + 1, bool)
        for k in range(N):
            part = numbers[k : len(numbers) - N + 1 + k]
            code, whole = code * self.base + part, whole & (part > 0)
        spots = np.flatnonzero(whole & (text[: len(code)] == text[N - 1 :]))
        place = np.searchsorted(self.codes, code[spots])
        place[place == len(self.codes)] = 0
        good = self.codes[place] == code[spots]
        found: dict[int, Counter] = defaultdict(Counter)
        for t, c in sorted(set(zip(text[spots[good]].tolist(), place[good].tolist(), strict=True))):
            found[t].update(self.holders[c])
        return found

    def leaked(self, texts: list[str]) -> list[list[int]]:
        """The items that each text repeats."""
        out: list[list[int]] = [[] for _ in texts]
        for t, counts in self.hits(texts).items():
            if among := [c for c, n in counts.items() if n >= self.items.least(c)]:
                ws = words(texts[t])
                out[t] = sorted({i for c in among if self.items.verify(c, ws) for i in self.items.members[c]})
        return out


class _Pieces(dict):
    def __init__(self, scanner: Scanner):
        super().__init__({_NEXT: -1})
        self.scanner = scanner

    def __missing__(self, piece: str) -> int:
        self[piece] = n = self.scanner.read(piece)
        return n


FOUND = T.ArrayType(T.LongType())


def leaks(documents: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, broadcast_items: int = BROADCAST_ITEMS) -> DataFrame:
    """Rows (key, item_key), one for each document and each item whose case it repeats.

    A case of under ten words (SHORT) counts where it stands whole; one of under three words has no window and is no passage.
    Null and empty texts on either side give nothing; repeated rows of a key count once; an empty table on either side
    gives an empty result; texts of any length are read whole. Further columns are ignored.
    """
    spark = documents.sparkSession
    usable = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_key).cast("bigint").alias("i"), F.col(item_text).alias("t")).groupBy("i").agg(F.min("t").alias("t"))
    rows = bounded_rows(usable, broadcast_items, "items", F.length("t"))
    texts = documents.where(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("_t"))
    if rows is None:
        return _leaks_by_join(texts, usable, key, item_key)
    shared = spark.sparkContext.broadcast(Items.build([(r["i"], r["t"]) for r in rows]))

    @F.pandas_udf(FOUND)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(shared.value)
        for batch in batches:
            texts = batch.tolist()
            yield pd.Series([x for i in range(0, len(texts), 500) for x in scanner.leaked(texts[i : i + 500])])

    found = texts.select(key, F.explode(scan("_t")).alias(item_key))
    return found.distinct()


def without_leaks(documents: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The documents that no item was found in; found comes from leaks(). Whole documents go: a passage may be retouched
    or rearranged, so that its ends in the text are not sure. All rows of a key that was found go, a null key too."""
    gone = found.select(F.col(key).alias("_gone")).distinct()
    return documents.join(gone, F.col(key).eqNullSafe(F.col("_gone")), "left_anti")


#: Words in a row that a stretch of a text shares with an item at least, to be cut out.
SPAN = 5
_PIECE = re.compile(r"<[^>]{1,200}>|&\w{2,8};|[^\W_](?:[^\W_]|[\u00ad\u200b-\u200d\u2060\ufeff]|-\s*\n\s*(?=\w))*")
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def shared_spans(text: str, item: str) -> list[tuple[int, int]]:
    """The stretches (start, end in characters) of a text of at least SPAN words in a row whose windows all stand in an item."""
    told = set(windows(words(item)))
    at = [(m.start(), m.end(), w[0]) for m in _PIECE.finditer(text) if m[0][0] not in "<&" and (w := words(m[0]))]
    ws, out, k = [w for *_, w in at], [], 0
    while k + N <= len(ws):
        e = k
        while e + N <= len(ws) and tuple(ws[e : e + N]) in told:
            e += 1
        if e > k and e - k + N - 1 >= SPAN:
            out.append((at[k][0], at[e + N - 2][1]))
        k = max(e + N - 1, k + 1) if e > k else k + 1
    return out


@F.pandas_udf(SPANS)
def _spans(text: pd.Series, item: pd.Series) -> pd.Series:
    return pd.Series([shared_spans(t, i) for t, i in zip(text, item, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, found in zip(text, spans, strict=True):
        kept, at = [], 0
        for a, b in sorted((s["start"], s["end"]) for s in found) if t is not None and found is not None else ():
            kept, at = [*kept, t[at : max(at, a)]], max(at, b)
        out.append(None if t is None else "".join([*kept, t[at:]]))
    return pd.Series(out, dtype=object)


def leaked_spans(documents: DataFrame, found: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str) -> DataFrame:
    """Rows (key, item_key, start, end): where in the documents found (see leaks) the item stands, in characters.

    Only stretches of SPAN words in a row are given, so single words that were changed lie between two of them. Only the
    documents found are read; only their texts and the items' meet. Null and empty texts have no spans.
    """
    pairs = found.join(items.select(F.col(item_key), F.col(item_text).alias("_item")), item_key)
    texts = documents.where(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("_t")).join(found.select(key).distinct(), key, "left_semi")
    return texts.join(pairs, key).where(F.col("_item").isNotNull()).select(key, item_key, F.inline(_spans("_t", "_item"))).distinct()


def without_spans(documents: DataFrame, spans: DataFrame, key: str, text: str) -> DataFrame:
    """documents with the spans (key, start, end) cut out of their texts; all other texts and columns stay as they are."""
    per_text = spans.groupBy(F.col(key).alias("_gone")).agg(F.collect_set(F.struct("start", "end")).alias("_spans"))
    joined = documents.join(per_text, F.col(key) == F.col("_gone"), "left")
    cut_out = F.when(F.col("_spans").isNull(), F.col(text)).otherwise(_without(F.col(text), F.coalesce("_spans", F.array().cast(SPANS))))
    return joined.withColumn(text, cut_out).select(*documents.columns)


def _hashes(ws: list[str]) -> list[int]:
    import xxhash

    return [xxhash.xxh3_64_intdigest("\x1f".join(g)) - 2**63 for g in windows(ws)]


@F.pandas_udf(T.ArrayType(T.LongType()))
def _window_hashes(batch: pd.Series) -> pd.Series:
    return pd.Series([list(set(_hashes(words(t)))) for t in batch])


@F.pandas_udf(T.ArrayType(T.LongType()))
def _case_hashes(batch: pd.Series) -> pd.Series:
    return pd.Series([_hashes(list(ws)) for ws in batch])


@F.pandas_udf(T.ArrayType(T.LongType()))
def _indexed(grams: pd.Series, held: pd.Series) -> pd.Series:
    return pd.Series([[int(g) for g in indexed(list(g), list(h), len(g) + N - 1)] for g, h in zip(grams, held, strict=True)])


@F.pandas_udf(T.BooleanType())
def _verified(text: pd.Series, case: pd.Series, own: pd.Series) -> pd.Series:
    out = []
    for t, c, o in zip(text, case, own, strict=True):
        out.append(Items({0: list(c)}, {0: frozenset(o)}, {}, {}).verify(0, words(t)))
    return pd.Series(out)


@F.pandas_udf(T.StringType())
def _usual(sentences: pd.Series, often: pd.Series) -> pd.Series:
    return pd.Series([usual(list(s), list(n)) for s, n in zip(sentences, often, strict=True)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words(batch: pd.Series) -> pd.Series:
    return pd.Series([words(t) for t in batch])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _item_sentences(batch: pd.Series) -> pd.Series:
    return pd.Series([_sentences(_OPTIONS.sub("", t)) for t in batch])


def _leaks_by_join(texts: DataFrame, items: DataFrame, key: str, item_key: str) -> DataFrame:
    """leaks for any number of items: the windows that cases are looked up by meet those of the documents in a join."""
    in_order = lambda *c: F.sort_array(F.collect_list(F.struct("at", *c)))
    said = cut(items.select("i", F.posexplode(_item_sentences("t")).alias("at", "s")).withColumn("l", F.lower("s")))
    has = said.select("i", "l").distinct()
    often = has.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    middle = cut(said.join(often, "l").groupBy("i").agg(in_order("l", "n").alias("x")).select("i", _usual("x.l", "x.n").alias("u")))
    alike = has.join(middle.select("u").distinct(), F.col("l") == F.col("u")).select("i", "u").join(has, "i").groupBy("u", "l").agg(F.count(F.lit(1)).alias("m"))
    apart = has.join(often.where(F.col("n") >= INSTRUCTION), "l").join(middle, "i").join(alike, ["u", "l"], "left")
    apart = apart.groupBy("l").agg(F.avg((F.col("n") - F.coalesce("m", F.lit(0)) >= INSTRUCTION - 1).cast("int")).alias("share")).where("share >= 0.5").select("l", F.lit(True).alias("shared"))
    text = lambda x: F.array_join(F.transform(x, lambda y: y["s"]), " ")
    read = said.join(apart, "l", "left").groupBy("i").agg(in_order("s", "shared").alias("x")).withColumn("own", F.filter("x", lambda y: y["shared"].isNull()))
    read = read.select("i", _words(text(F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("x")))).alias("case"))
    read = cut(read.where(F.size("case") > 0).withColumn("c", F.sha2(F.array_join("case", " "), 256)))
    classes = read.groupBy("c").agg(F.first("case").alias("case"))
    said_in = classes.select("c", F.explode(F.array_distinct("case")).alias("w"))
    words_in = said_in.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    ranked = said_in.join(words_in, "w").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("n", "w"))).alias("x"))
    ranked = ranked.withColumn("most", F.greatest(F.lit(FEW), F.get("x", F.least(F.lit(LEAST_OWN), F.size("x")) - 1)["n"]))
    own = ranked.select("c", F.transform(F.filter("x", lambda x: x["n"] <= F.col("most")), lambda x: x["w"]).alias("own"))
    grams = classes.select("c", F.posexplode(_case_hashes("case")).alias("at", "g"))
    held = grams.select("c", "g").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    kept = grams.join(held, "g").groupBy("c").agg(in_order("g", "n").alias("x")).select("c", F.explode(_indexed("x.g", "x.n")).alias("g"))
    keyed = texts.select(key, F.xxhash64("_t").alias("_v"), "_t")
    hits = keyed.select(key, "_v", F.explode(_window_hashes("_t")).alias("g")).join(kept, "g").select(key, "_v", "g", "c").distinct()
    least = classes.select("c", F.least(F.lit(HITS), F.size(F.array_distinct(_case_hashes("case")))).alias("least"))
    pairs = hits.groupBy(key, "_v", "c").agg(F.count(F.lit(1)).alias("n")).join(least, "c").where(F.col("n") >= F.col("least")).drop("least")
    checked = pairs.join(keyed.dropDuplicates([key, "_v"]), [key, "_v"]).join(classes.join(own, "c"), "c").where(_verified("_t", "case", "own"))
    return checked.select(key, "c").distinct().join(read.select("c", "i"), "c").select(key, F.col("i").alias(item_key)).distinct()
