"""Texts put into containers of a fixed number of tokens.

Harmonic packing: a text of s tokens belongs to class floor(C / s), and a container of that class takes a fixed number
of its texts, whichever they are, so workers fill containers without talking to each other. Plain harmonic classes leave
a quarter of the room unused on texts of mixed lengths, so the classes are refined: one class for each length, and bin
types that take a fixed number of texts of each of several classes. The types come from the histogram of lengths (at
most C rows, however large the corpus) by best fit, longest class first; then every text gets its container from its
rank in its class alone. Only a text longer than a container is split, into full containers and one remainder.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits texts before the merges of the rank files (a fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts a shard numbers on its own: a class is never numbered by one task.
SHARD_ROWS = 200_000


@lru_cache(4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter(dict):
    """Token counts of pieces of text that begin with their blank; such pieces never share a token."""

    def __init__(self, path: str, limit: int = 500_000):
        self.encode, self.limit = _encoding(path).encode_ordinary, limit

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self.encode(piece))
        return n

    def count(self, text: str) -> int:
        if "  " in text or "\0" in text:
            return len(self.encode(text))
        n = sum(map(self.__getitem__, text.replace(" ", "\0 ").split("\0")))
        if len(self) > self.limit:
            self.clear()
        return n


def token_counts(df: DataFrame, text: str, out: str = "tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """df with the number of tokens of each text; null for a null text. tokenizer is the path of a rank file on every worker."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(tokenizer)
        for s in batches:
            yield pd.Series([counter.count(t) if isinstance(t, str) else None for t in s], dtype="Int64")

    return df.withColumn(out, count(F.col(text)))


def bin_types(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bin types (bins, [(length, texts a bin)]) that hold all texts of a histogram of lengths: best fit, longest first.

    All open bins of one type are treated as one, so the work depends on the number of lengths, not of texts.
    """
    groups: dict[int, list] = {}  # number: [bins, room, contents]
    order: list[tuple[int, int]] = []  # (room, number), sorted
    number = 0
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            at = bisect_left(order, (size, -1))
            if at == len(order):
                each = min(capacity // size, left)
                bins = left // each
                groups[number] = [bins, capacity - each * size, [(size, each)]]
                insort(order, (capacity - each * size, number))
                number, left = number + 1, left - bins * each
                continue
            room, g = order.pop(at)
            bins, _, contents = groups[g]
            each = min(room // size, max(1, left // bins))
            used = min(bins, left // each)
            if used < bins:
                groups[number] = [bins - used, room, list(contents)]
                insort(order, (room, number))
                number += 1
            groups[g] = [used, room - each * size, [*contents, (size, each)]]
            insort(order, (room - each * size, g))
            left -= used * each
    return [(bins, contents) for bins, _, contents in groups.values()]


def harmonic_types(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bin types by reciprocal-capacity classes: lengths of which k fit into a container share bins of k texts, longest first."""
    classes: dict[int, list[int]] = {}
    for size in sorted(histogram, reverse=True):
        classes.setdefault(capacity // size, []).append(size)
    out = []
    for k, sizes in classes.items():
        started, held = [], 0
        for size in sizes:
            left = histogram[size]
            if held:
                take = min(k - held, left)
                started, held, left = [*started, (size, take)], held + take, left - take
                if held == k:
                    out.append((1, started))
                    started, held = [], 0
            if left >= k:
                out.append((left // k, [(size, k)]))
            if left % k:
                started, held = [(size, left % k)], left % k
        if held:
            out.append((1, started))
    return out


METHODS = {"refined": bin_types, "harmonic": harmonic_types}


def pack(items: DataFrame, key: str, tokens: str, capacity: int, method: str = "refined") -> DataFrame:
    """An assignment (key, part, token_from, token_to, container, slot_from) of texts to containers of so many tokens.

    method is refined (a class for each length, bins shared by several classes) or harmonic (reciprocal-capacity classes).
    items has one row a text; key should be unique (of texts with equal keys and sizes any may come first). part counts
    the pieces of a split text from 0; tokens token_from (included) to token_to (excluded) of the text stand in the
    container from slot_from on. Texts that are null or have no tokens need no container and give no row. An empty
    table gives an empty result. The numbers of containers run from 0 without gaps.
    """
    spark = items.sparkSession
    rows = items.where(F.col(tokens) > 0).select(F.col(key).alias("_k"), F.col(tokens).cast("bigint").alias("_n"))
    starts = F.when(F.col("_n") <= capacity, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(capacity).cast("bigint")))
    pieces = rows.select("_k", "_n", F.posexplode(starts).alias("part", "token_from"))
    pieces = cut(pieces.withColumn("token_to", F.least(F.col("token_from") + capacity, "_n")).withColumn("size", (F.col("token_to") - F.col("token_from")).cast("int")).drop("_n"))
    shards = max(1, -(-pieces.count() // SHARD_ROWS)) * 8
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("_k", "part"), F.lit(shards)).cast("int"))
    counts = pieces.groupBy("size", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("size").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("size", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    spans, next_rank, first = [], dict.fromkeys(histogram, 0), 0
    for bins, contents in METHODS[method](histogram, capacity):
        slot = 0
        for size, each in contents:
            a = next_rank[size]
            spans.append((size, a, a + bins * each, first, each, slot))
            next_rank[size] = a + bins * each
            slot += size * each
        first += bins
    plan = spark.createDataFrame(spans, "size int, rank_from bigint, rank_to bigint, first bigint, each int, slot int")
    own = Window.partitionBy("size", "shard").orderBy("_k", "part")
    ranked = pieces.withColumn("own", F.row_number().over(own) - 1).join(offsets, ["size", "shard"]).withColumn("rank", F.col("offset") + F.col("own"))
    placed = ranked.join(F.broadcast(plan), (ranked["size"] == plan["size"]) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    nth = F.col("rank") - F.col("rank_from")
    return placed.select(
        F.col("_k").alias(key), "part", "token_from", "token_to",
        (F.col("first") + F.floor(nth / F.col("each"))).cast("bigint").alias("container"),
        (F.col("slot") + F.pmod(nth, F.col("each")) * ranked["size"]).cast("int").alias("slot_from"),
    )
