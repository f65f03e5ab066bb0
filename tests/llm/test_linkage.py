import random

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm.linkage import VETOES, VOTES, LabelModel, address_key, blocking, candidates, date_vote, link, pairing, ranked, records, resolver_id, votes, with_title_parts

DRUGS = [a + b for a in "brena stiola kryome dovali umbero vixala torami glasto neferu quiste".split() for b in "mab nib pril stat vir".split()]
PLACES = "Thorenby Garashire Moreska Selundra Kilestrand Penonte Ravamer Wynover Dunick Holulva".split()
STATES = "muscle cramps,skin flares,vision strain,appetite loss,early thinning".split(",")
GROUPS = "older adults,office staff,fishing crews,kidney donors,shift workers".split(",")
SCHEMA = "k string, title string, url string, day string, words string, id int"


def works(n, rng):
    out = {}
    while len(out) < n:
        title = f"{rng.choice(DRUGS).capitalize()} for {rng.choice(STATES)} in {rng.choice(GROUPS)}: a cohort study at {rng.choice(PLACES)}"
        out[title] = (f"20{rng.randint(10, 24)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", f"{rng.randint(100000, 999999)}")
    return [(t, *v) for t, v in out.items()]


def typo(t, rng):
    i = rng.randrange(3, 9)
    return t[:i] + t[i + 1] + t[i] + t[i + 2 :]


def frame(spark, rows, side):
    df = spark.createDataFrame(rows, SCHEMA)
    return records(df, "k", "title", address_key(F.col("url"), F.lit(None).cast("string")), F.col("day"), side)


def test_planted_pairs(spark):
    rng = random.Random(4)
    base = works(160, rng)
    left, right, want = [], [], set()
    for i, (t, day, number) in enumerate(base):
        left.append((f"e{i}", t, f"https://pub.example/articles/{number}", day, "x", 1))
        kind = i % 8
        if kind == 7:
            continue
        changed = {0: t, 1: t.upper(), 2: typo(t, rng), 3: t.replace(": a cohort study", " - A cohort study") + " ", 4: f"[{t}] Full text", 5: t.split(":")[0] + "...", 6: t + ", wave 3"}[kind]
        url = f"http://www.pub.example/a/{number}" if i % 2 else None
        right.append((f"s{i}", changed, url, "2005-01-01" if kind == 6 else day, "x", 1))
        if kind != 6:
            want.add((f"e{i}", f"s{i}"))
    right += right[:5] + [("s_none", None, None, None, "x", 1), (None, "x", None, None, "x", 1), ("s_long", "word " * 5000, None, None, "x", 1)]
    got = link(frame(spark, left, "l"), frame(spark, right, "r"))
    pairs = {(r.left_id, r.right_id) for r in got.collect()}
    assert len(pairs & want) >= 0.95 * len(want) and len(pairs - want) <= 0.03 * len(want)
    assert got.select("left_id", "right_id").distinct().count() == got.count() and got.where("confidence < 0.5 or confidence > 1").count() == 0


def test_empty_and_split_blocks(spark, monkeypatch):
    rows = [("e1", "Brenamab for skin flares in older adults: a cohort study at Thorenby", None, "2020-01-01", "x", 1)]
    assert link(frame(spark, [], "l"), frame(spark, rows, "r")).count() == 0
    assert link(frame(spark, rows, "l"), frame(spark, rows, "r").limit(0)).count() == 0
    many = [(f"k{i}", f"Brenamab for {s} in {g}: a cohort study at {p}", None, None, "x", 1) for i, (s, g, p) in enumerate((s, g, p) for s in STATES for g in GROUPS for p in PLACES[:4])]
    def same() -> int:
        pairs = candidates(frame(spark, many, "l").unionByName(frame(spark, many, "r")))
        return pairs.where(F.col("l.words") == F.col("r.words")).count()

    whole = same()
    monkeypatch.setattr("quillspark.llm.linkage.BLOCK_PAIRS", 50)
    split = same()
    assert whole == split == len(many)
    copies = [(f"c{i}", rows[0][1], None, "2020-01-01", "x", 1) for i in range(30)]
    assert candidates(frame(spark, copies, "l").unionByName(frame(spark, copies, "r"))).count() == 1
    assert link(frame(spark, copies[:9], "l"), frame(spark, rows, "r"), least=0.0).count() == 9


def test_big_blocks_are_dealt_whole(spark, monkeypatch):
    """Every pair of a big block meets in one cell, also records without a title word; no cell is big."""
    from quillspark.llm import linkage

    monkeypatch.setattr(linkage, "BLOCK_PAIRS", 100)
    blocks = spark.createDataFrame([(i, s, k) for k, n in (("1:w", 60), ("s", 3)) for s in "lr" for i in range(n)] + [(1, "l", "alone")], "rid bigint, side string, key string")
    fine = linkage.cells(blocks)
    l, r = (fine.where(f"side = '{s}'").select("key", F.col("rid").alias(s)) for s in "lr")
    pairs = l.join(r, "key")
    assert pairs.count() == 60 * 60 + 3 * 3
    assert pairs.where("key like '1:w%'").select("l", "r").distinct().count() == 60 * 60
    assert pairs.groupBy("key").count().agg(F.max("count")).first()[0] <= 400
    monkeypatch.setattr(linkage, "BLOCK_PAIRS", 4)
    rows = lambda side: frame(spark, [(f"{side}{i}", None, "https://pub.example/324856", f"20{i + 10}-01-01", "x", 1) for i in range(6)], side)
    assert candidates(rows("l").unionByName(rows("r"))).count() == 36


def test_label_model_learns_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(6000) < 0.3
    votes = np.zeros((6000, 5), int)
    for j, accuracy in enumerate((0.95, 0.9, 0.8, 0.6)):
        right = rng.random(6000) < accuracy
        votes[:, j] = np.where(rng.random(6000) < 0.1, 0, np.where(truth == right, 1, -1))
    votes[:, 4] = votes[:, 3]  # a copy adds nothing
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = LabelModel().fit(patterns, counts)
    posterior = dict(zip(map(tuple, patterns), model.posterior(patterns), strict=True))
    guess = np.array([posterior[tuple(v)] > 0.5 for v in votes])
    assert (guess == truth).mean() > 0.95 and (model.parent[4] == 3 or model.parent[3] == 4)


def test_parts(spark):
    df = spark.createDataFrame([("<i>Abc for skin</i> &amp; bones: a RCT at X, part II",), ("Abc vs. placebo...",), (None,), ("",)], "t string")
    got = [r.asDict() for r in with_title_parts(df, "t").collect()]
    assert sorted(got[0]["words"]) == ["abc", "bones", "randomised", "skin", "trial", "x"] and got[0]["marker"] == "partii"
    assert got[1]["cut"] and got[1]["words"] == ["abc"] and not got[3]["words"]
    urls = ["https://m.pub.example/ARTICLES/324856/", "http://mirror.pub.example/pdf/324856.pdf", "https://pub.example/x-and-y?id=324856&ref=99999", "https://resolve.example/site-071/324856", "https://resolve.example/w/ccd0a67c", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    host = F.when(resolver_id(F.col("u")) == "site-071", "pub.example")
    assert [r[0] for r in df.select(address_key(F.col("u"), host)).collect()] == ["pub.example/324856"] * 4 + [None, None]


def test_date_votes(spark):
    pairs = {("2024-01-01", "2024-01-02"): 1, ("2024", "2024-03"): 0, ("2024-01", "2024-01-31"): 1, ("2020", "2023-05-01"): -1, (None, "2024"): 0, ("2024-01-01T10:00:00Z", "2024-01-01"): 1, ("2024-01-01", "2024-03-01"): 0, ("2024-01", "2024-02-01"): 0}
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", date_vote(F.col("a"), F.col("b")).alias("v"))
    assert [r.v for r in df.orderBy("i").collect()] == list(pairs.values())


def test_pairing():
    """Slips, words parted elsewhere and slips of light words are paired; other words are not."""
    assert pairing([("brenamba", 1)], [("brenamab", 8)]) == (0, 0, 1)
    assert pairing([("nightshift", 1)], [("night", 900), ("shift", 900)]) == (0, 0, 1)
    assert pairing([("ge", 1), ("schoola", 1)], [("age", 900), ("school", 900)]) == (0, 0, 1)
    assert pairing([("verss", 1), ("skni", 1)], [("skin", 900)]) == (1, 0, 1)
    assert pairing([("verss", 1), ("donors", 700)], [("skin", 900)]) == (1, 1, 0)
    assert pairing([("nurses", 900)], [("nurse", 800)]) == (1, 1, 0)
    assert pairing([("donors", 700), ("kidney", 700)], [("older", 900)]) == (2, 1, 0)


def planted(rng, n):
    """Records of both sides and the true pairs: copies with slips, cut-off titles, and hard cases of other works."""
    left, right, want = [], [], set()
    told = {t.split(" at ")[0]: (t, *rest) for t, *rest in works(n, rng)}  # a title that is cut off names one work
    for i, (t, day, number) in enumerate(told.values()):
        left.append((f"e{i}", t, f"https://pub.example/articles/{number}", day, "x", 1))
        place = t.rsplit(" ", 1)[1]
        kind, k = i % 10, rng.randrange(2, 6)
        other = rng.choice([p for p in PLACES if p != place])
        title = {0: t, 1: typo(t, rng), 2: t.upper(), 3: t.split(" at ")[0] + "...", 4: t + ", part 2", 5: t.replace(place, other), 6: "Protocol: " + t, 7: typo(t, rng), 8: t[:-k] + chr(97 + rng.randrange(26)) + t[-k:], 9: None}[kind]
        if title is None:
            continue
        same = kind not in (4, 5, 6)
        url = f"http://m.pub.example/a/{number}" if rng.random() < (0.5 if same else 0.1) else None
        right.append((f"s{i}", title, url, day if same and rng.random() < 0.7 else None if same or rng.random() < 0.5 else "2003-02-03", "x", 1))
        if same:
            want.add((f"e{i}", f"s{i}"))
    return left, right, want


def test_confidence_is_reliable(spark):
    """Posterior against truth over all candidates: the pairs of each bin are true about as often as it says."""
    left, right, want = planted(random.Random(8), 1000)
    members = frame(spark, left, "l").unionByName(frame(spark, right, "r"))
    rows = votes(candidates(members)).toPandas()
    ids = {s: {r.rid: r.id for r in members.where(f"side = '{s}'").collect()} for s in "lr"}
    true = np.array([(ids["l"][a], ids["r"][b]) in want for a, b in zip(rows.l_rid, rows.r_rid, strict=True)])
    patterns, at, counts = np.unique(rows[VOTES].to_numpy(int), axis=0, return_inverse=True, return_counts=True)
    posterior = LabelModel(vetoes=tuple(VOTES.index(v) for v in VETOES)).fit(patterns, counts).posterior(patterns)[at.ravel()]
    table = {}
    for low, high in ((0, 0.1), (0.1, 0.5), (0.5, 0.9), (0.9, 1.01)):
        among = (posterior >= low) & (posterior < high)
        table[low] = (int(among.sum()), float(posterior[among].mean()) if among.any() else 0.0, float(true[among].mean()) if among.any() else 0.0)
    assert table[0][0] > 200 and table[0][2] < 0.01 and table[0.9][0] > 250 and table[0.9][2] > 0.99
    assert sum(n for n, *_ in table.values()) == len(rows)
    found = {(r.left_id, r.right_id) for r in link(frame(spark, left, "l"), frame(spark, right, "r")).collect()}
    assert len(found & want) >= 0.97 * len(want) and len(found - want) <= 0.01 * len(found)


def test_blocks_stay_narrow(spark):
    """Words that many things have are keys in groups only, and a slip in the rarest word still meets."""
    left, right, _ = planted(random.Random(3), 900)
    rows, things = ranked(frame(spark, left, "l").unionByName(frame(spark, right, "r")))
    keys = blocking(rows, things).groupBy("key").count()
    assert keys.where("key like '1:%'").agg(F.max("count")).first()[0] <= 100 and keys.where("key rlike '^1:(study|cohort|older|adults)$'").count() == 0
    assert things == len(left) + len(right)
