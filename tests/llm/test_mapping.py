import random

import pytest

from quillspark.llm.mapping import Dictionary, allowed, cost, deletions, distance, map_names, read_typed, reference_rows

CATALOG = [("zokofloine", "Zokofloine", "ZKF", ["Зокофлоине"]), ("gaern.acid", "Gaernmusprulase, acid", "GRNA", []), ("gaern", "Gaernmusprulase", "GRN", ["Prebaate"]), ("birn.free", "Birnbaol, free", "BRNF", None), ("birn", "Birnbaol", "BRN", []), ("nezoate", "Nezoate", "NZT", [])]
TYPED = {
    "Zokofloine": "zokofloine", "  ZOKOFLOINE ": "zokofloine", "zok\xadofloine": "zokofloine", "Zok0f1oine": "zokofloine", "zokoflione": "zokofloine", "Zokоflоinе": "zokofloine", "зокофлоине": "zokofloine", "ЗОКОФЛОNНЕ": "zokofloine",
    "Test: zokofl.": "zokofloine", "fP-zokofloine, fasting": "zokofloine", "level of Zokofloine conc.": "zokofloine", "*Zokofloine* - repeat": "zokofloine", "Zokofloine, ECL method [mass/vol]": "zokofloine", "ZKF": "zokofloine", "z.k.f.": "zokofloine",
    "Gaemmusprulase-ac.": "gaern.acid", "ACID gaernmuspruase": "gaern.acid", "gaernm. (acid)": "gaern.acid", "prebaaet": "gaern", "Fr. birnba01": "birn.free", "birn baol free": "birn.free", "BIMBAOL": "birn",
    "Birnbaol, total": None, "zokofloine / nezoate ratio": None, "ratio zokofloine to nezoate": None, "comment": None, "???": None, "": None, "   ": None, "Floflurane": None, "x" * 5000: None, "nz": None,
}


def frames(spark, texts):
    catalog = spark.createDataFrame(CATALOG, "k string, name string, code string, syn array<string>")
    reference = reference_rows(catalog, "k", "name", "code", "syn")
    usage = spark.createDataFrame([("birn", 5)], "key string, n bigint")
    rows = spark.createDataFrame([(i, t, "old", "x") for i, t in enumerate(texts)], "i int, t string, mapped_key string, n string")
    return rows, reference, usage


@pytest.mark.parametrize("limit", [100, 2])
def test_both_ways(spark, limit):
    texts = [*TYPED, None, *TYPED]
    rows, reference, usage = frames(spark, texts)
    out = map_names(rows, "t", reference, usage, broadcast_limit=limit)
    assert sorted(out.columns) == sorted(rows.columns) and out.count() == len(texts)
    got = {r.t: r.mapped_key for r in out.collect()}
    assert {t: got[t] for t in TYPED} == TYPED and got[None] is None


@pytest.mark.parametrize("limit", [100, 0])
def test_empty(spark, limit):
    rows, reference, usage = frames(spark, ["Zokofloine"])
    assert map_names(rows, "t", reference.limit(0), usage, broadcast_limit=100).first().mapped_key is None
    assert map_names(rows.limit(0), "t", reference, usage, broadcast_limit=limit).count() == 0


def test_usage_breaks_ties(spark):
    catalog = spark.createDataFrame([("a", "Tarogene", None, None), ("b", "Tarogane", None, None)], "k string, name string, code string, syn array<string>")
    reference = reference_rows(catalog, "k", "name", "code", "syn")
    rows = spark.createDataFrame([("tarogxne",)], "t string")
    for often in "ab":
        usage = spark.createDataFrame([(often, 9)], "key string, n bigint")
        for limit in (100, 0):
            assert map_names(rows, "t", reference, usage, broadcast_limit=limit).first().mapped_key == often


def test_candidates_are_complete():
    """Every name within the allowed distance by brute force is found through the deletions."""
    rng = random.Random(3)
    names = ["".join(rng.choice("abcdeo") for _ in range(rng.randint(4, 9))) for _ in range(120)]
    d = Dictionary()
    for n in names:
        d.bases[n] += [n]
        d.keys[n, ""] = n
    d.build()
    for _ in range(400):
        typed = list(rng.choice(names))
        for _ in range(rng.randint(0, 2)):
            typed[rng.randrange(len(typed))] = rng.choice("abcdeo")
        typed = read_typed("".join(typed))
        if typed is None or not typed.letters:
            continue
        near = [n for n in names if cost(typed, n) is not None]
        assert (d.look(typed.letters) is not None) == bool(near)


def test_distance():
    assert distance("abc", "abc") == 0 and distance("abc", "acb") == 0.8 and distance("abc", "abbc") == 0.6 and distance("abl", "ab1") == 0.3
    assert distance("a", "abcdef") > 2 and allowed(3) == 0
    assert deletions("abcd", 2) == {"abcd", "bcd", "acd", "abd", "abc", "cd", "bd", "bc", "ad", "ac", "ab"}


@pytest.mark.parametrize("limit", [20_000, 1])
def test_long_names(spark, limit):
    """Names of any length match; over MOST_LETTERS letters without edits."""
    long = "zoko" * 100
    reference = reference_rows(spark.createDataFrame([("a", long, "LNG", None), ("b", "Nezoate", "NZT", [])], "k string, n string, c string, s array<string>"), "k", "n", "c", "s")
    usage = spark.createDataFrame([], "key string, n bigint")
    typed = spark.createDataFrame([(1, long.upper()), (2, long + "x"), (3, "nezoate" + " [" + "x" * 400 + "]"), (4, "y" * 100_000)], "i int, t string")
    got = {r.i: r.mapped_key for r in map_names(typed, "t", reference, usage, broadcast_limit=limit).collect()}
    assert got == {1: "a", 2: None, 3: "b", 4: None}
