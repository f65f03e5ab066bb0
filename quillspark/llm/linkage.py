"""Records of the same things matched across two sources without a common key, each pair with a confidence.

Candidates share a blocking key: a rare word of the title, a group of its words that few things have together, or the
publisher's number in the address. Heuristic functions vote on each candidate (1 same, -1 different, 0 no opinion). A
generative label model is fitted to the counts of vote patterns alone, without any known pairs: expectation-maximisation
over two classes, in which each function's accuracy is learnt together with its dependence on one other function (a tree of
the strongest conditional dependencies). Functions that vote on what makes a work another one by definition are vetoes: the
model holds that they hardly ever vote against a pair of the same thing. A pair's confidence is the posterior of its
pattern, and nothing else decides. There are at most 3^7 patterns, so what reaches the driver does not grow with the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.periods import bounds
from quillspark.session import cut

VOTES = ["v_words", "v_rare", "v_marker", "v_url", "v_date", "v_overlap", "v_doubt"]
#: Functions that vote against pairs of different things only: other words on both sides, another part, a title that is
#: cut off and not borne out by its date.
VETOES = ("v_words", "v_marker", "v_doubt")
#: The probability that a veto is wrong.
WRONG_VETO = 1e-9
#: A block of more pairs than this is dealt to cells of about so many pairs.
BLOCK_PAIRS = 20_000
#: A word in the titles of so many things is taken as spelt right: it is not a slip of another one.
ESTABLISHED = 4
#: A word that is so many times rarer than another may be a slip of it all the same.
RATIO = 25
#: A word of at most so many things is a blocking key by itself; groups of other words are, where no more are expected to
#: have all of them.
RARE = 50
#: So many groups of words that each record has at most; each holds the rarest word that is no key by itself.
GROUPS = 3
#: Words whose counts differ by less than this share are taken for one phrase, which selects once.
PHRASE = 0.02
#: Words of at least this share of all things are counted by a broadcast table; a title of k words adds k / HOT at most.
HOT, HOT_ROWS = 0.001, 100_000
#: Dates further apart than this speak against the same thing.
FAR_DAYS = 150
#: Nats that one vote must tell about another within the classes to be modelled as its parent.
DEPENDENT = 0.02
# Remarks that catalogues add to a title.
REMARKS = r"\(abstract\)|\bfull text\b|\boriginal article\b|\bepub ahead of print\b|\[abstract\]"
# What makes a part, follow-up or correction of a work another work.
MARKERS = [
    (r"\bwave\s+(\d+|[ivx]+)\b", "wave"), (r"\bpart\s+(\d+|[ivx]+)\b", "part"), (r"\b(first|second|third|fourth|final|interim)\s+report\b", "report"), (r"\breport\s+(\d+|[ivx]+)\b", "report"),
    (r"\b(\w+)[- ]year\s+follow[- ]?up\b", "follow"), (r"()\bfollow[- ]?up\b", "follow"), (r"()\bprotocol\b", "protocol"), (r"()\b(?:erratum|corrigendum|correction)\b", "erratum"),
]
# Spellings of the same word or phrase.
PHRASES = [(r"\brct\b|\brandomi[sz]ed controlled trial\b", "randomised trial"), (r"\bpa?ediatric cohort\b", "children")]
SPELLINGS = {"prophylaxis": "prevention", "stdy": "study", "adult": "adults", "randomized": "randomised", "pts": "patients"}
# Words without weight in a comparison.
LIGHT = "a an the of for in on at with and to by from as add add-on therapy course prevention placebo usual care i ii patients clinical v vs versus compared".split()


def with_title_parts(df: DataFrame, title: str) -> DataFrame:
    """df with the columns words (distinct, sorted, without light ones), marker and cut (whether it was cut off) of a title.

    Each text is tidied once; the patterns of markers run only over titles that have any.
    """
    t = F.lower(F.regexp_replace(title, r"<[^>]*>", " "))
    t = F.regexp_replace(F.replace(F.replace(t, F.lit("&amp;"), F.lit(" and ")), F.lit("&#8211;"), F.lit("-")), r"[‐‑–—]|&#8212;|&[mn]dash;", "-")
    any_marker = "|".join(p.replace("()", "").replace("(\\d+|[ivx]+)", "(?:\\d+|[ivx]+)") for p, _ in MARKERS)
    out = df.withColumn("_t", F.regexp_replace(t, rf"&\w+;|&#\d+;|{REMARKS}", " "))
    out = out.withColumn("cut", F.coalesce(F.col("_t").rlike(r"(?:\.\.\.|…)\W*$"), F.lit(False)))
    names = F.array(*(F.when(F.col("_t").rlike(p), F.concat(F.lit(name), F.regexp_extract("_t", p, 1))) for p, name in MARKERS))
    out = out.withColumn("_m", F.coalesce(F.col("_t").rlike(any_marker), F.lit(False)))
    out = out.withColumn("marker", F.when(F.col("_m"), F.coalesce(F.get(F.array_compact(names), F.lit(0)), F.lit(""))).otherwise(""))
    bare = F.when(F.col("_m"), F.regexp_replace("_t", any_marker, " ")).otherwise(F.col("_t"))
    for p, to in PHRASES:
        bare = F.regexp_replace(bare, p, to)
    spelt = F.create_map(*(F.lit(x) for pair in SPELLINGS.items() for x in pair))
    words = F.transform(F.split(bare, r"[^\p{L}\p{N}]+"), lambda w: F.coalesce(F.try_element_at(spelt, w), w))
    words = F.array_sort(F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(LIGHT))))
    return out.withColumn("words", F.coalesce(words, F.array().cast("array<string>"))).drop("_t", "_m")


def resolver_id(url: Column) -> Column:
    """The short id of a publisher in a resolver's address, or an empty string."""
    return F.regexp_extract(F.lower(url), r"^https?://[^/]+/(site-\d+)/\d", 1)


def address_key(url: Column, publisher: Column) -> Column:
    """A publisher and number from an address, whatever its form; null where it has none.

    publisher is the host name that belongs to the address's resolver_id, null where it has none.
    """
    u = F.lower(F.trim(url))
    host = F.regexp_replace(F.regexp_extract(u, r"^https?://([^/:?#]+)", 1), r"^(?:www|m|mirror|mobile|amp)\.", "")
    path = F.regexp_replace(F.regexp_replace(u, r"^https?://[^/]+", ""), r"[?&](?:utm_\w+|ref)=[^&]*", "")
    number = F.regexp_extract(path, r"(?:^|\D)(\d{4,})(?:\D|$)", 1)
    inner = resolver_id(u)
    place = F.when(inner != "", F.coalesce(publisher, inner)).otherwise(host)
    return F.when((number != "") & (place != "") & ~((inner == "") & path.rlike(r"^/w/[0-9a-f]+")), F.concat_ws("/", place, number))


@lru_cache(500_000)
def _letters(word: str) -> int:
    """The letters of a word as bits; one edit changes two of them at most."""
    bits = 0
    for x in word:
        bits |= 1 << (ord(x) % 61)
    return bits


def _near(a: str, b: str, most: int) -> bool:
    """Whether two words are within so many edits (insertion, deletion, change, swap of neighbours)."""
    if abs(len(a) - len(b)) > most or (_letters(a) ^ _letters(b)).bit_count() > 2 * most:
        return False
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        before, last = last, row
    return last[-1] <= most


def _slip(a: str, b: str) -> bool:
    n = min(len(a), len(b))
    return n >= 3 and _near(a, b, 1 if n < 5 else 2)


def _may_slip(c: int, y: int) -> bool:
    return min(c, y) < ESTABLISHED or min(c, y) * RATIO <= max(c, y)


def _drop(words: list[tuple[str, int]], others: list[tuple[str, int]]) -> bool:
    """Takes away a word and two of the others that are the same written as one word or parted elsewhere."""
    for i, (w, c) in enumerate(words):
        for j, (x, y) in enumerate(others):
            for k, (z, u) in enumerate(others):
                if j != k and _may_slip(c, min(y, u)) and abs(len(w) - len(x) - len(z)) <= 1 and _slip(w, x + z):
                    del words[i]
                    for n in sorted((j, k), reverse=True):
                        del others[n]
                    return True
    return False


def _part(a: list[tuple[str, int]], b: list[tuple[str, int]]) -> bool:
    """Takes away two words of each side that are the same letters parted at another place."""
    for (i, (v, c)), (j, (w, d)) in combinations(enumerate(a), 2):
        for (k, (x, y)), (m, (z, u)) in combinations(enumerate(b), 2):
            if len(v) + len(w) == len(x) + len(z) and _may_slip(min(c, d), min(y, u)) and {v + w, w + v} & {x + z, z + x}:
                del a[j], a[i], b[m], b[k]
                return True
    return False


def pairing(only_a: list[tuple[str, int]], only_b: list[tuple[str, int]]) -> tuple[int, int, int]:
    """How many words of each side have no partner on the other, and how many are slips of each other.

    Each side comes as the words (and how many things have them) that the other side lacks, rarest first. A blank that is
    missing, too much or misplaced is a slip as well, and so is a rare word that is a slip of a light one.
    """
    slips, left, only_a, right = 0, [], list(only_a), list(only_b)
    while _part(only_a, right):
        slips += 1
    for w, c in only_a:
        for i, (x, y) in enumerate(right):
            if _may_slip(c, y) and _slip(w, x):
                slips += 1
                del right[i]
                break
        else:
            left.append((w, c))
    while len(left) + len(right) > 2 and left and right and (_drop(left, right) or _drop(right, left)):
        slips += 1
    if left and right:
        left, right = ([(w, c) for w, c in side if not (c < ESTABLISHED and any(_slip(w, x) for x in _LONG_LIGHT))] for side in (left, right))
    return len(left), len(right), slips


_LONG_LIGHT = [w for w in LIGHT if len(w) >= 4]
LEFT = T.StructType([T.StructField(c, T.IntegerType()) for c in ("a", "b", "slips")])


@F.pandas_udf(LEFT)
def _pairings(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for only_a, only_b in batches:
        out = np.zeros((len(only_a), 3), np.int32)
        for i in np.flatnonzero(only_a.notna()):
            sides = ([(w, int(c)) for w, _, c in (x.rpartition(":") for x in t.split(" "))] for t in (only_a[i], only_b[i]))
            out[i] = pairing(*sides)
        yield pd.DataFrame(out, columns=LEFT.names)


def date_vote(a: Column, b: Column) -> Column:
    """The vote on two normal forms of dates: 1 the same as far as both go (a day for zones), -1 far apart, 0 for nulls."""
    n = F.least(F.length(a), F.length(b), F.lit(10))
    (a0, a1), (b0, b1) = bounds(a), bounds(b)
    gap = F.greatest(F.datediff(b0, a1), F.datediff(a0, b1), F.lit(0))
    same = F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n)
    vote = F.when(same, F.when(n > 4, 1).otherwise(0)).when((n == 10) & (gap <= 1), 1).when(gap > FAR_DAYS, -1).otherwise(0)
    return F.when(a.isNull() | b.isNull(), 0).otherwise(vote)


# ---- label model -------------------------------------------------------------------------------------------------------------


class LabelModel:
    """Two classes and a tree of votes: P(class) times P(root vote | class) times P(vote | parent's vote, class)."""

    def __init__(self, rounds: int = 200, smoothing: float = 0.5, vetoes: tuple[int, ...] = ()):
        """vetoes: the places of votes that say different of the same thing with probability WRONG_VETO only."""
        self.rounds, self.smoothing, self.vetoes = rounds, smoothing, vetoes

    def fit(self, patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
        """patterns: rows of votes in -1, 0, 1; counts: how many pairs show each."""
        x, n = patterns + 1, counts.astype(float)
        score = patterns.mean(axis=1)
        q = 1 / (1 + np.exp(-6 * (score - 0.25)))  # the votes are better than chance: where the classes start from
        self.parent = [-1] * x.shape[1]
        for i in range(self.rounds):
            if i in (60, 120):  # first as if the votes were independent, so that the classes explain what they can
                self._tree(x, n, q)
            self._maximise(x, n, q)
            new = self.posterior(patterns)
            if i > 125 and np.abs(new - q).max() < 1e-7:
                break
            q = new
        return self

    def _tree(self, x: np.ndarray, n: np.ndarray, q: np.ndarray) -> None:
        m = x.shape[1]
        info = np.zeros((m, m))
        for a in range(m):
            for b in range(a + 1, m):
                for w in (n * q, n * (1 - q)):
                    joint = np.zeros((3, 3)) + 1e-9
                    np.add.at(joint, (x[:, a], x[:, b]), w)
                    joint /= joint.sum()
                    info[a, b] += w.sum() / n.sum() * (joint * np.log(joint / joint.sum(1, keepdims=True) / joint.sum(0, keepdims=True))).sum()
        info += info.T
        inside, self.parent = [0], [-1] * m
        while len(inside) < m:
            gain, a, b = max((info[a, b], a, b) for a in inside for b in range(m) if b not in inside)
            self.parent[b] = a if gain > DEPENDENT else -1
            inside.append(b)

    def _maximise(self, x: np.ndarray, n: np.ndarray, q: np.ndarray) -> None:
        self.prior = np.array([(n * (1 - q)).sum(), (n * q).sum()]) / n.sum()
        self.tables = []
        for j, p in enumerate(self.parent):
            t = np.full((2, 3, 3), self.smoothing)
            for k, w in enumerate((n * (1 - q), n * q)):
                np.add.at(t[k], (x[:, p] if p >= 0 else np.zeros(len(x), int), x[:, j]), w)
            t /= t.sum(axis=2, keepdims=True)
            if j in self.vetoes:
                t[1, :, 0] = WRONG_VETO
                t[1] /= t[1].sum(axis=1, keepdims=True)
            self.tables.append(t)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        x = patterns + 1
        log = np.log(np.maximum(self.prior, 1e-12))[None, :].repeat(len(x), 0)
        for j, p in enumerate(self.parent):
            at = x[:, p] if p >= 0 else np.zeros(len(x), int)
            for k in (0, 1):
                log[:, k] += np.log(self.tables[j][k][at, x[:, j]])
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60)))


# ---- candidates ----------------------------------------------------------------------------------------------------------------


def records(df: DataFrame, key: str, title: str, url: Column, date: Column, side: str) -> DataFrame:
    """The records of one side ('l' or 'r') for link(): key, title, an address key and a normal form of a date."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(title).alias("title"), url.alias("url"), date.alias("date"))
    out = with_title_parts(rows, "title").drop("title").distinct()
    return out.withColumn("side", F.lit(side)).withColumn("rid", F.xxhash64("side", "words", "marker", "cut", "url", "date"))


def cells(blocks: DataFrame) -> DataFrame:
    """Blocks (rid, side, key), the big ones dealt to a grid of cells with a key each.

    A record of a big block falls in one row (left side) or column (right side) by its hash and goes to all cells of it,
    so every pair of the block meets in exactly one cell, whatever else the two share. Where no block is big, nothing is dealt.
    """
    wide = max(1, int(BLOCK_PAIRS**0.5))
    sizes = blocks.groupBy("key").agg(F.count(F.when(F.col("side") == "l", 1)).alias("nl"), F.count(F.when(F.col("side") == "r", 1)).alias("nr"))
    big = cut(sizes.where(F.col("nl") * F.col("nr") > BLOCK_PAIRS))
    if big.isEmpty():
        return blocks
    left, parts = F.col("side") == "l", lambda n: F.ceil(F.col(n) / wide)
    sized = blocks.join(big, "key", "left").withColumn("mine", F.pmod(F.xxhash64("rid", "key"), F.when(left, parts("nl")).otherwise(parts("nr"))))
    others = F.sequence(F.lit(0).cast("bigint"), F.when(left, parts("nr")).otherwise(parts("nl")) - 1)
    dealt = F.transform(others, lambda x: F.concat_ws("|", "key", F.when(left, F.col("mine")).otherwise(x).cast("string"), F.when(left, x).otherwise(F.col("mine")).cast("string")))
    return sized.select("rid", "side", F.explode(F.when(F.col("nl").isNotNull(), dealt).otherwise(F.array("key"))).alias("key"))


def ranked(members: DataFrame) -> tuple[DataFrame, int]:
    """The classes of records (rid, side) with words and counts, rarest first, and the number of things.

    How many things have a word is counted over ids. The few words that many things have are counted by a broadcast table,
    so no task of the join with the other counts holds a hot word.
    """
    classes = members.groupBy("rid", "side").agg(*(F.first(c).alias(c) for c in ("words", "marker", "cut", "url", "date")))
    things = members.groupBy("side", "id").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))
    n = members.select("side", "id").distinct().count()
    counts = cut(things.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    hot = counts.where(F.col("n") > n * HOT)
    spoken = classes.select("rid", "side", F.explode("words").alias("word"))
    few = hot.limit(HOT_ROWS + 1).count() <= HOT_ROWS
    listed = lambda df: df.groupBy("rid", "side").agg(F.collect_list(F.struct("n", "word")).alias("w"))
    rest = counts.where(F.col("n") <= n * HOT) if few else counts
    usual = listed(spoken.join(F.broadcast(hot), "word")).withColumnRenamed("w", "h") if few else None
    out = classes.join(listed(spoken.join(rest, "word")), ["rid", "side"], "left")
    out = out.join(usual, ["rid", "side"], "left") if few else out.withColumn("h", F.lit(None).cast("array<struct<n:bigint,word:string>>"))
    none = F.array().cast("array<struct<n:bigint,word:string>>")
    out = out.withColumn("w", F.array_sort(F.concat(F.coalesce("w", none), F.coalesce("h", none))))
    return out.select("rid", "side", "marker", "cut", "url", "date", F.transform("w", lambda x: x["word"]).alias("words"), F.transform("w", lambda x: x["n"]).alias("counts")), n


def _group(words: Column, start: int, things: int) -> Column:
    """The rarest of some words with the ones from a place on, until no more than RARE things are expected to have them all."""
    state = lambda k, e, c: F.struct(k.alias("k"), e.cast("double").alias("e"), c.cast("bigint").alias("c"))
    first = F.get(words, F.lit(0))

    def add(at: Column, x: Column) -> Column:
        enough = (F.size(at["k"]) > 1) & (at["e"] <= RARE)
        expected = at["e"] * F.when(x["counts"] > at["c"] * (1 + PHRASE), x["counts"] / things).otherwise(1.0)
        return F.when(enough, at).otherwise(state(F.concat(at["k"], F.array(x["words"])), expected, x["counts"]))

    rest = F.slice(words, start + 1, F.greatest(F.size(words), F.lit(1)))
    key = F.aggregate(rest, state(F.array(first["words"]), first["counts"], first["counts"]), add)["k"]
    return F.when(F.size(words) > start, F.concat_ws("+", F.array_sort(key)))


def blocking(rows: DataFrame, things: int) -> DataFrame:
    """Rows (rid, side, key): the blocking keys of each class of records.

    A word of 2 to RARE things is a key, and so is the address. Groups of other words are keys for pairs of which one is
    open: it has a word so rare that it may be a slip, or no rare word that is established. A pair that is not open on
    either side has no slip in its rare words, so that it meets at one of these if they are the same.
    """
    zipped = F.arrays_zip("words", "counts")
    usual = F.filter(zipped, lambda x: x["counts"] > RARE)
    single = F.transform(F.filter(zipped, lambda x: x["counts"].between(2, RARE)), lambda x: F.concat(F.lit("1:"), x["words"]))
    sure = F.exists("counts", lambda c: c.between(ESTABLISHED, RARE)) & ~F.exists("counts", lambda c: c < ESTABLISHED)
    groups = F.array_distinct(F.array_compact(F.array(*(_group(F.col("usual"), j, things) for j in range(1, GROUPS + 1)))))
    mark = lambda name, of: F.transform(of, lambda k: F.concat(F.lit(name), k))
    left, right = F.col("side") == "l", F.col("side") == "r"
    out = rows.select("rid", "side", "url", single.alias("single"), usual.alias("usual"), (~sure).alias("open")).withColumn("groups", groups)
    none = F.array().cast("array<string>")
    keys = F.concat(
        "single", F.array_compact(F.array(F.concat(F.lit("u:"), "url"))),
        F.when(right | F.col("open"), mark("a:", F.col("groups"))).otherwise(none), F.when((left & ~F.col("open")) | (right & F.col("open")), mark("b:", F.col("groups"))).otherwise(none),
    )
    return out.select("rid", "side", F.explode(F.array_distinct(keys)).alias("key"))


def candidates(members: DataFrame) -> DataFrame:
    """Pairs of classes (l, r structs, with ranked words and counts) that share a blocking key; big blocks are dealt to
    cells, which loses no pair.

    members are the records of both sides. Records that are alike but for their id are one class (rid), so copies make no
    further pairs; how many things have a word is counted over ids.
    """
    rows, things = ranked(members)
    rows = cut(rows)
    fine = cells(blocking(rows, things))
    ids = fine.where("side = 'l'").select("key", F.col("rid").alias("lrid")).join(fine.where("side = 'r'").select("key", F.col("rid").alias("rrid")), "key")
    ids = ids.select("lrid", "rrid").repartition("lrid").distinct()
    pack = lambda side, name: rows.where(F.col("side") == side).select(F.col("rid").alias(f"{name}rid"), F.struct("rid", "words", "counts", "marker", "cut", "url", "date").alias(name))
    return ids.join(pack("l", "l"), "lrid").join(pack("r", "r"), "rrid").select("l", "r")


def votes(pairs: DataFrame) -> DataFrame:
    """The votes on candidate pairs, one row a pair of classes (l_rid, r_rid).

    Only words that stand on one side alone, and of which one may be a slip of another, go through Python.
    """
    alone = lambda a, b: F.filter(F.arrays_zip(F.col(f"{a}.words").alias("w"), F.col(f"{a}.counts").alias("c")), lambda x: ~F.array_contains(F.col(f"{b}.words"), x["w"]))
    read = pairs.select(
        F.col("l.rid").alias("l_rid"), F.col("r.rid").alias("r_rid"), F.size("l.words").alias("na"), F.size("r.words").alias("nb"), alone("l", "r").alias("oa"), alone("r", "l").alias("ob"),
        (F.array_contains("r.words", F.get("l.words", F.lit(0))) | F.array_contains("l.words", F.get("r.words", F.lit(0)))).alias("rarest"),
        *(F.col(f"{s}.{c}").alias(f"{c}_{s}") for c in ("marker", "cut", "url", "date") for s in ("l", "r")),
    )
    none, small = (F.col("na") == 0) | (F.col("nb") == 0), F.least("na", "nb")
    # titles of other things: slips can't make up for so many words
    read = read.withColumn("apart", ~none & (3 * (F.col("na") - F.size("oa")) < small))
    # one side can only be paired whole where its established words are taken by rare words of the other or are slips by their ratio
    usual, low, high = (lambda o: F.filter(o, lambda x: x["c"] >= ESTABLISHED)), (lambda o: F.get(o, F.lit(0))["c"]), (lambda o: F.get(o, F.size(o) - 1)["c"])
    read = read.withColumns({"ea": usual(F.col("oa")), "eb": usual(F.col("ob"))})
    ratio = F.coalesce((low("ea") * RATIO <= high("eb")) | (low("eb") * RATIO <= high("ea")), F.lit(False))
    whole = lambda a, b: F.size(f"e{a}") <= 2 * (F.size(f"o{b}") - F.size(f"e{b}"))
    hard = ~none & ~F.col("apart") & (F.size("oa") > 0) & (F.size("ob") > 0) & (whole("a", "b") | whole("b", "a") | ratio)
    text = lambda o: F.when(hard, F.array_join(F.transform(o, lambda x: F.concat_ws(":", x["w"], x["c"].cast("string"))), " "))
    read = read.withColumn("hard", hard).withColumn("p", _pairings(text("oa"), text("ob")))
    left = lambda o, c: F.when(F.col("hard"), F.col("p")[c]).otherwise(F.size(o))
    read = read.withColumns({"left_a": left("oa", "a"), "left_b": left("ob", "b")})
    la, lb = (F.col("apart") | (F.col(c) > 0) for c in ("left_a", "left_b"))
    share = (F.col("na") - F.col("left_a")) / small
    one_sided = F.when(F.col("marker_l") == "", F.col("cut_l") | lb).when(F.col("marker_r") == "", F.col("cut_r") | la).otherwise(False)
    cast = {
        "v_words": F.when(none, 0).when(la & lb, -1).when(la | lb, 0).otherwise(1),
        "v_rare": F.when(none, 0).when(F.col("rarest"), 1).when(~F.col("apart") & F.col("hard") & (F.col("p.slips") > 0), 0).otherwise(-1),
        "v_marker": F.when(none, 0).when(F.col("marker_l") == F.col("marker_r"), 1).when(one_sided, 0).otherwise(-1),
        "v_overlap": F.when(none, 0).when(F.col("apart"), -1).when(share >= 0.9, 1).when(share < 0.75, -1).otherwise(0),
        "v_date": date_vote(F.col("date_l"), F.col("date_r")),
        "v_url": F.when(F.col("url_l") == F.col("url_r"), 1).when(F.col("url_l").isNotNull() & F.col("url_r").isNotNull(), -1).otherwise(0),
    }
    voted = read.select("l_rid", "r_rid", *(v.cast("byte").alias(c) for c, v in cast.items()))
    unclear = (F.col("v_marker") == 0) & ~((F.col("v_date") == 1) | (F.col("v_url") == 1) & (F.col("v_date") == 0))
    doubt = F.when((F.col("v_words") == 0) & (F.col("v_date") < 0) | unclear, -1).otherwise(0)
    return voted.withColumn("v_doubt", doubt.cast("byte"))


def link(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs (left_id, right_id, confidence) of the same thing.

    left and right come from records(); a thing has one id on the left and may have several on the right. Of several
    records of one id the best pair counts, and of several left things for one right id the ones of the highest confidence.
    Empty tables, null titles, addresses and dates and repeated rows are allowed; records without any title word and address
    have no candidates. Ties need no order.
    """
    members = cut(left.unionByName(right))  # read again below: the titles are tidied once
    voted = cut(votes(candidates(members)))
    patterns = voted.groupBy(*VOTES).agg(F.count(F.lit(1)).alias("n")).toPandas()
    spark = left.sparkSession
    schema = T.StructType([T.StructField(v, T.ByteType()) for v in VOTES] + [T.StructField("confidence", T.DoubleType())])
    if len(patterns):
        x = patterns[VOTES].to_numpy(int)
        patterns["confidence"] = LabelModel(vetoes=tuple(VOTES.index(v) for v in VETOES)).fit(x, patterns["n"].to_numpy()).posterior(x)
    answers = spark.createDataFrame([(*map(int, r[:-1]), float(r[-1])) for r in patterns[[*VOTES, "confidence"]].itertuples(index=False)] if len(patterns) else [], schema)
    scored = voted.join(F.broadcast(answers.where(F.col("confidence") >= least)), VOTES)
    ids = lambda side, name: members.where(F.col("side") == side).select(F.col("rid").alias(f"{side}_rid"), F.col("id").alias(name))
    scored = scored.join(ids("l", "left_id"), "l_rid").join(ids("r", "right_id"), "r_rid")
    best = scored.groupBy("left_id", "right_id").agg(F.max("confidence").alias("confidence"))
    return best.join(best.groupBy("right_id").agg(F.max("confidence").alias("confidence")), ["right_id", "confidence"]).select("left_id", "right_id", "confidence")
