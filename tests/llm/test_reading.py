import random

import pytest

from quillspark.llm.reading import Vocabulary, cut_texts, fit, predict, reading_levels, Scorer

EASY = "drink water now rest well call us today bring note home sit down good walk".split()
MIDDLE = "remember results often change between laboratories because several reasons matter during visits".split()
HARD = "heterogeneity notwithstanding parameterisation circumscribes identifiability asymptotically autocorrelated incommensurability".split()


def text(level: int, rng: random.Random) -> str:
    words = {1: EASY, 2: MIDDLE, 3: HARD}
    out = []
    for _ in range(rng.randint(4, 9)):
        own = words[level] if rng.random() < 0.85 else words[rng.choice([1, 2, 3])]
        out.append(" ".join(rng.choice(own) for _ in range(rng.randint(6, 10))).capitalize() + rng.choice([".", ".", "\n"]))
    return " ".join(out)


def corpus(n: int, seed: int):
    rng = random.Random(seed)
    labels = [rng.choice([1, 2, 3]) for _ in range(n)]
    return [text(x, rng) for x in labels], labels


def test_held_out_accuracy():
    train, y = corpus(240, 1)
    test, z = corpus(200, 2)
    model = fit(train, y)
    got = predict(model, Scorer(model.sentence), test)
    assert (got == z).mean() > 0.95


def test_same_for_any_batch():
    train, y = corpus(120, 3)
    model = fit(train, y)
    test, _ = corpus(50, 4)
    test += ["", " ", "123 456", "<p>drink</p> &amp; rest", "x" * 50_000]
    whole = predict(model, Scorer(model.sentence), test)
    single = [predict(model, Scorer(model.sentence, limit=3), [t])[0] for t in test]
    assert whole.tolist() == single and whole[50] == 0 and whole[51] == 0


def test_sentences():
    parts = cut_texts(["One two. Three!\nfour", "", "a b c " * 30], Vocabulary())
    assert parts.counts.tolist() == [3, 0, 3] and parts.lengths.tolist() == [4, 0, 90]


def test_in_spark(spark):
    train, y = corpus(150, 5)
    test, z = corpus(60, 6)
    labelled = spark.createDataFrame([(i, t, v, "x") for i, (t, v) in enumerate(zip(train, y, strict=True))] + [(900, None, 1, "x"), (901, "drink water", None, "x")], "doc_id bigint, text string, lv int, _h string")
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate([*test, None, "", "drink water", test[0]])], "doc_id bigint, text string, reading_level string")
    out = reading_levels(docs, labelled, "text", "lv", min_words=10, max_labels=130).orderBy("doc_id").collect()
    got = [r.reading_level for r in out]
    assert len(out) == 64 and sum(a == b for a, b in zip(got, z, strict=False)) > 55 and got[60:63] == [None] * 3 and got[63] == got[0]
    assert reading_levels(docs.limit(0), labelled, "text", "lv").count() == 0


@pytest.mark.parametrize(("rows", "want"), [([], None), ([(1, "a b", 2)], 2)])
def test_too_few_labels(spark, rows, want):
    labelled = spark.createDataFrame(rows, "doc_id bigint, text string, lv int")
    docs = spark.createDataFrame([(1, "some words"), (2, None), (3, "")], "doc_id bigint, text string")
    assert [r.reading_level for r in reading_levels(docs, labelled, "text", "lv").orderBy("doc_id").collect()] == [want, None, None]
