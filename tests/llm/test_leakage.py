import random

import pytest

from quillspark.llm.leakage import Items, Scanner, case_texts, leaked_spans, leaks, shared_spans, without_leaks, without_spans, words

NAMES = ["Brandol", "Teskim", "Olfrad", "Vandrup", "Kespil", "Nortum", "Wexlar", "Quinbo", "Zarlet", "Hupfen"]


def item(i: int) -> str:
    a, b, c = NAMES[i % 10] + str(i), NAMES[(i + 3) % 10] + "mere", f"KX-{100 + i}"
    return (
        f"Read the case below and choose the best answer. Station {a} in {b} retests {20 + i} narrow swabs, finds {3 + i} clotted, and blames a mist cabinet that ran {40 + i} minutes too long. "
        f"Supervisor {a} withdraws memo {c}, since {b} reported {70 + i} clotted samples against a limit of {5 + i} per cabinet. Only {30 + i} narrow labels match code {c} before the rinse at {a}. "
        f"Which step should {a} take first if {c} stays clotted? (A) Discard {i}. (B) Repeat {i}. (C) Both. (D) Neither."
    )


ITEMS = [(i, item(i)) for i in range(12)]
CASES = case_texts(ITEMS)
FILL = "The laboratory keeps a register of all samples and checks every label twice before noon. "


def retouched(text: str) -> str:
    return text.replace("finds", "sees").replace("withdraws", "retracts").upper().replace(" ", "\n", 3)


DOCS = {
    1: (FILL * 3 + CASES[2] + FILL, [2]),
    2: (FILL + " ".join(reversed(CASES[3].split(". "))) + FILL, [3]),
    3: (FILL + retouched(CASES[4]), [4]),
    4: (FILL + CASES[5][: len(CASES[5]) // 2] + FILL * 50, [5]),
    5: (FILL + " ".join(CASES[6].split()[:8]) + FILL, []),
    6: (FILL + item(99) + FILL, []),
    7: ("Read the case below and choose the best answer. (A) Discard 1. (B) Repeat 1. (C) Both. (D) Neither.", []),
    8: (CASES[7] + FILL * 10 + CASES[8], [7, 8]),
    9: ("", []), 10: (None, []), 11: (FILL * 20_000, []), 12: (CASES[9].replace("e", "e​").replace("a", "а"), [9]),
}


@pytest.mark.parametrize("limit", [100, 3])
def test_both_ways(spark, limit):
    rows = [(k, t, "x", 1) for k, (t, _) in DOCS.items()]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id bigint, text string, i string, case int")
    items = spark.createDataFrame([*ITEMS, (50, None), (51, ""), (None, "x"), ITEMS[0]], "item_id bigint, text string")
    got = leaks(docs, items, "doc_id", "text", "item_id", "text", broadcast_items=limit)
    assert got.columns == ["doc_id", "item_id"]
    assert sorted(map(tuple, got.collect())) == sorted((k, i) for k, (_, found) in DOCS.items() for i in found)


LEAD = ["", "Use only what the passage states. ", "Choose one. ", "Answer after the case. ", "Read the case first. ", "Select the best. ", "Be brief. ", "Think. "]


@pytest.mark.parametrize("limit", [100, 3])
def test_copies_and_variants(spark, limit):
    """Copies of a case under other ids, and variants that differ in few words, are all found."""
    bare = [CASES[i] for i in range(12)]
    copies = [(100 + k, f"{LEAD[k]}{bare[2]} (A) Yes {k}. (B) No.") for k in range(8)]
    variants = [(200 + k, bare[3].replace("minutes too long", f"minutes {NAMES[k]} long")) for k in range(8)]
    items = spark.createDataFrame([*ITEMS, *copies, *variants], "item_id bigint, text string")
    half = ". ".join(bare[2].split(". ")[:2]) + ". "
    docs = spark.createDataFrame([(1, FILL + bare[2] + FILL), (2, FILL + bare[3] + FILL), (3, FILL + half + FILL), (4, FILL + item(99)), (5, FILL + bare[7])], "doc_id bigint, text string")
    got = {}
    for d, i in leaks(docs, items, "doc_id", "text", "item_id", "text", broadcast_items=limit).collect():
        got.setdefault(d, set()).add(i)
    same, alike = {2, *range(100, 108)}, {3, *range(200, 208)}
    assert got == {1: same, 2: alike, 3: same, 5: {7}}


def test_own_words_of_the_repeated_part():
    """A whole passage with few of the case's own words is a leak; the same with other names and figures is none."""
    ends = ["a clerk at Oneda counts nine narrow racks beside the mist cabinet and finds all of them clotted before noon", "at Oneda the cabinet ran forty minutes too long so the racks of the morning round had to be washed again"]
    rest = [f"then {a} wrote to {b} about it at length and asked for all the papers" for a, b in (("twoba", "threna"), ("fourik", "fivol"), ("sixtur", "sevun"))]
    case = words(". ".join([ends[0], *rest, ends[1]]))
    own = frozenset("oneda twoba threna fourik fivol sixtur sevun".split())
    items = Items({0: case}, {0: own}, {}, {})
    assert items.verify(0, words(FILL + ". ".join(ends) + ". " + FILL))
    assert not items.verify(0, words(FILL + ". ".join(ends).replace("Oneda", "Elsewhere") + ". " + FILL))
    assert not items.verify(0, ["other" if w in own else w for w in case])


def test_corpus_without_leaks(spark):
    docs = spark.createDataFrame([*((k, t, "x") for k, (t, _) in DOCS.items()), (None, CASES[1], "y")], "doc_id bigint, text string, kind string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    rest = without_leaks(docs, leaks(docs, items, "doc_id", "text", "item_id", "text"), "doc_id")
    assert rest.columns == docs.columns and sorted(r.doc_id for r in rest.collect()) == sorted(k for k, (_, found) in DOCS.items() if not found)
    assert leaks(rest, items, "doc_id", "text", "item_id", "text").count() == 0
    assert without_leaks(docs, leaks(docs, items.limit(0), "doc_id", "text", "item_id", "text"), "doc_id").count() == docs.count()


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert leaks(docs.limit(0), items, "doc_id", "text", "item_id", "text").count() == 0
    assert leaks(docs, items.limit(0), "doc_id", "text", "item_id", "text").count() == 0
    assert leaks(docs.limit(0), items, "doc_id", "text", "item_id", "text", broadcast_items=1).count() == 0


def test_scanner_finds_what_sets_find():
    """The vectorised lookup finds the same windows as sets of windows do."""
    rng = random.Random(2)
    items = Items.build(ITEMS)
    scanner = Scanner(items)
    vocabulary = sorted({w for ws in items.cases.values() for w in ws}) + ["other", "words", "here."]
    for _ in range(60):
        texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80))) + rng.choice(["", " " + item(rng.randrange(12))[:200]]) for _ in range(7)]
        found = scanner.hits(texts)
        for n, t in enumerate(texts):
            ws = words(t)
            windows = set(zip(ws, ws[1:], ws[2:], strict=False)) & set(items.index)
            want = {}
            for g in windows:
                for i in items.index[g]:
                    want[i] = want.get(i, 0) + 1
            assert dict(found.get(n, {})) == want


def test_cases():
    assert "Read the case" not in CASES[0] and "(A)" not in CASES[0] and CASES[0].startswith("Station")
    assert case_texts([(1, "only this one")]) == {1: "only this one"}


@pytest.mark.parametrize("limit", [20_000, 1])
def test_short_and_long_cases(spark, limit):
    """A case of five words is found where it stands whole, one of 10,000 words where two fifths stand; both ways alike."""
    rng = random.Random(6)
    long = " ".join("".join(rng.choice("abdeilmnorstu") for _ in range(7)) for _ in range(10_000))
    five = "Zerrin counted nine blue barges"
    items = spark.createDataFrame([*ITEMS, (500, five), (501, five), (502, long), (503, "two words")], "item_id bigint, text string")
    part = " ".join(long.split()[3000:7600])
    docs = spark.createDataFrame([(1, FILL + " ZERRIN counted nine\nblue barges. " + FILL), (2, FILL + " Zerrin counted nine old barges. " + FILL), (3, FILL + " " + part), (4, "two words"), (5, " ".join(long.split()[:2000]))], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.item_id) for r in leaks(docs, items, "doc_id", "text", "item_id", "text", broadcast_items=limit).collect())
    assert got == [(1, 500), (1, 501), (3, 502)]


def test_spans(spark):
    """What is cut out of the documents found is the item's stretches; nothing is found in what is left."""
    t = "no, one two three four five six seven <b>eight</b> no"
    assert shared_spans(t, "One, two: three four five six seven eight nine") == [(4, t.index("</b>"))]
    assert shared_spans("one two three four", "one two three four") == [] and shared_spans("", "a") == []
    docs = spark.createDataFrame([*((k, t, "x") for k, (t, _) in DOCS.items())], "doc_id bigint, text string, kind string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = leaks(docs, items, "doc_id", "text", "item_id", "text")
    spans = leaked_spans(docs, found, items, "doc_id", "text", "item_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert spans.count() > 0 and all(0 <= r.start < r.end <= len(texts[r.doc_id]) for r in spans.collect())
    rest = without_spans(docs, spans, "doc_id", "text")
    hit = {r.doc_id for r in found.collect()}
    left = {r.doc_id: r.text for r in rest.collect()}
    assert rest.columns == docs.columns and all(left[k] == t for k, t in texts.items() if k not in hit)
    assert all(len(left[r.doc_id]) < len(texts[r.doc_id]) for r in spans.collect())
    assert leaks(rest, items, "doc_id", "text", "item_id", "text").count() == 0
    assert leaked_spans(docs, found.limit(0), items, "doc_id", "text", "item_id", "text").count() == 0
