import os
import random
from collections import Counter as Count

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm.packing import TOKENIZER, Counter, _encoding, bin_types, harmonic_types, pack, token_counts


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 200), max_size=30))
def test_types_hold_all(histogram):
    types = bin_types(histogram, 50)
    held = Count()
    for bins, contents in types:
        assert bins > 0 and sum(s * n for s, n in contents) <= 50
        for s, n in contents:
            held[s] += bins * n
    assert held == Count(histogram)
    plain = sum(-(-n // (50 // s)) for s, n in histogram.items())  # one class for each length, none shared
    assert sum(s * n for s, n in histogram.items()) / 50 <= sum(b for b, _ in types) <= plain


def check(rows, sizes, capacity):
    """Every token of every text once, no container over its room, only texts larger than one split."""
    parts, load = {}, {}
    for k, part, a, b, c, slot in rows:
        parts.setdefault(k, []).append((part, a, b))
        load.setdefault(c, []).append((slot, slot + b - a))
    assert set(parts) == {k for k, n in sizes.items() if n}
    for k, ps in parts.items():
        ps.sort()
        assert [p for p, _, _ in ps] == list(range(len(ps))) and ps[0][1] == 0 and ps[-1][2] == sizes[k]
        assert all(x[2] == y[1] for x, y in zip(ps, ps[1:], strict=False)) and (len(ps) == 1) == (sizes[k] <= capacity)
    for spans in load.values():
        spans.sort()
        assert spans[-1][1] <= capacity and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert sorted(load) == list(range(len(load)))
    return sum(sizes.values()) / (len(load) * capacity)


def test_round_trip(spark):
    rng = random.Random(1)
    sizes = {i: rng.choice([0, 7, 7, 7, rng.randint(1, 100), rng.randint(1, 900)]) for i in range(3000)}
    df = spark.createDataFrame([(k, n, "x", 1) for k, n in sizes.items()], "id int, tokens int, size string, shard int").repartition(5)
    rows = [tuple(r) for r in pack(df, "id", "tokens", 256).collect()]
    assert check(rows, sizes, 256) > 0.98
    again = [tuple(r) for r in pack(df.repartition(3), "id", "tokens", 256).collect()]
    assert sorted(rows) == sorted(again)


def test_edges(spark):
    empty = spark.createDataFrame([], "id int, tokens int")
    assert pack(empty, "id", "tokens", 10).count() == 0
    odd = spark.createDataFrame([(1, None), (2, 0), (3, 10), (3, 10), (None, 4), (4, 25)], "id int, tokens int")
    rows = pack(odd, "id", "tokens", 10).collect()
    assert sorted((r.id or 0, r.part, r.token_from, r.token_to) for r in rows) == [(0, 0, 0, 4), (3, 0, 0, 10), (3, 0, 0, 10), (4, 0, 0, 10), (4, 1, 10, 20), (4, 2, 20, 25)]
    assert len({r.container for r in rows}) == 5


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary")
def test_counts_are_the_tokenizers(spark):
    texts = ["", " ", "a  b", "a   b c", "x\n\n y", "\t z ", "don't stop", "été über 12,5 mg/L", "<|endoftext|> x", "word " * 5000, "a​b", " \n ", None]
    want = [None if t is None else len(_encoding(TOKENIZER).encode_ordinary(t)) for t in texts]
    counter = Counter(TOKENIZER)
    assert [None if t is None else counter.count(t) for t in texts] == want
    out = token_counts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t").orderBy("i")
    assert [r.tokens for r in out.collect()] == want


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary")
@given(st.text(alphabet=" ab\n.'é1\t\xa0", max_size=60))
def test_counting_by_pieces(text):
    assert Counter(TOKENIZER).count(text) == len(_encoding(TOKENIZER).encode_ordinary(text))


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 200), max_size=30))
def test_harmonic_types_hold_all(histogram):
    """Every bin holds texts of one class only, as many as the class says but for one bin a class."""
    held, short = Count(), Count()
    for bins, contents in harmonic_types(histogram, 50):
        kinds = {50 // s for s, _ in contents}
        assert bins > 0 and len(kinds) == 1 and sum(s * n for s, n in contents) <= 50
        short[min(kinds)] += bins * (sum(n for _, n in contents) < min(kinds))
        for s, n in contents:
            held[s] += bins * n
    assert held == Count(histogram) and max(short.values(), default=0) <= 1


def test_harmonic_packing(spark):
    rng = random.Random(2)
    sizes = {i: rng.choice([0, 7, rng.randint(1, 100), rng.randint(1, 900)]) for i in range(1500)}
    df = spark.createDataFrame(list(sizes.items()), "id int, tokens int")
    filled = {m: check([tuple(r) for r in pack(df, "id", "tokens", 256, m).collect()], sizes, 256) for m in ("harmonic", "refined")}
    assert 0.6 < filled["harmonic"] < filled["refined"]
