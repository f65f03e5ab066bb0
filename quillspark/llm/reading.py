"""Reading level of documents, estimated from their sentences.

A regularised linear model of words and of the character n-grams inside words classifies every sentence; it is fitted to
the sentences of labelled documents. A second, small model turns the distribution of a document's sentence levels into
the document's level; it is fitted on documents that the sentence model did not see (two folds), so that it is
calibrated. Both are fitted on the driver to at most max_labels labelled documents, the ones with the smallest hash of
their id; every document of the corpus is then classified from its whole text, in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LABELS = 1200
BUCKETS = 1 << 15
SENTENCE_WORDS = 30

_MARKUP = re.compile(r"<[^>]{1,200}>|&#?\w{1,8};")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_END = re.compile(r"[.!?…;:][\W_]*$")
_NEXT, _LINE = "␞", "¶"


def _tidy(text: str) -> str:
    if not text.isascii():
        text = _HIDDEN.sub("", text).replace(_NEXT, " ")
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    return text


def _grams(word: str) -> list[int]:
    """Buckets of a word's character 3- to 5-grams and of its length."""
    w = f"<{word}>"
    out = [hash_text(w[i : i + n]) % BUCKETS for n in (3, 4, 5) for i in range(len(w) - n + 1)]
    return [*out, hash_text(f"length {min(len(word), 20)}") % BUCKETS]


def hash_text(s: str) -> int:
    """FNV-1a, the same in every process."""
    h = 2166136261
    for b in s.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


class Vocabulary(dict):
    """Codes for pieces of text between white space: twice the number of the word, plus 1 where the piece ends a sentence.

    Word 0 is none; all words with digits are one; a text's end has the code -1.
    """

    def __init__(self) -> None:
        super().__init__({_NEXT: -1, _LINE: 1})
        self.number: dict[str, int] = {"": 0}
        self.words: list[str] = [""]

    def __missing__(self, piece: str) -> int:
        word = _EDGES.sub("", piece).lower()
        if any(c.isdigit() for c in word):
            word = "0"
        if (n := self.number.get(word)) is None:
            n = self.number[word] = len(self.words)
            self.words.append(word)
        self[piece] = code = 2 * n + (_END.search(piece) is not None)
        return code


@dataclass
class Parts:
    """Texts cut into sentences: all words, the start of each sentence, and how many words and sentences a text has."""

    words: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    counts: np.ndarray

    def pick(self, texts: np.ndarray) -> Parts:
        first, last = np.r_[0, np.cumsum(self.lengths)], np.r_[0, np.cumsum(self.counts)]
        at = np.concatenate([np.arange(first[i], first[i + 1]) for i in texts])
        sizes = np.diff(np.r_[self.starts, len(self.words)])
        own = np.concatenate([np.arange(last[i], last[i + 1]) for i in texts])
        return Parts(self.words[at], np.r_[0, np.cumsum(sizes[own])[:-1]], self.lengths[texts], self.counts[texts])


def cut_texts(texts: list[str], vocabulary: Vocabulary) -> Parts:
    """Sentences end at marks and line ends; one of over SENTENCE_WORDS words is cut into pieces."""
    n = len(texts)
    pieces = f" {_NEXT} ".join([*map(_tidy, texts), ""]).replace("\n", f" {_LINE} ").split()
    codes = np.fromiter(map(vocabulary.__getitem__, pieces), np.int64, len(pieces))
    stop = codes < 0
    text = np.cumsum(stop)
    number, end = codes >> 1, (codes & 1).astype(bool) | stop
    real = (number > 0) & ~stop
    sentence = np.cumsum(end) - end
    words, text, sentence = number[real], text[real], sentence[real]
    if not len(words):
        return Parts(words, np.zeros(0, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64))
    first = np.flatnonzero(np.r_[True, (sentence[1:] != sentence[:-1]) | (text[1:] != text[:-1])])
    within = np.arange(len(words)) - np.repeat(first, np.diff(np.r_[first, len(words)]))
    starts = np.flatnonzero(within % SENTENCE_WORDS == 0)
    return Parts(words, starts, np.bincount(text, minlength=n)[:n], np.bincount(text[starts], minlength=n)[:n])


@dataclass
class SentenceModel:
    """Class scores of a sentence: the mean of its words' vectors; a word's vector is its own weight plus its n-grams'."""

    levels: np.ndarray
    words: dict[str, np.ndarray]
    grams: np.ndarray
    bias: np.ndarray

    def vector(self, word: str) -> np.ndarray:
        own = self.words.get(word)
        v = self.grams[_grams(word)].mean(axis=0)
        return v if own is None else v + own


def fit_sentences(parts: Parts, labels: np.ndarray, vocabulary: Vocabulary, rounds: int = 60, ridge: float = 2e-6) -> SentenceModel:
    """Multinomial logistic regression by Adam on all sentences at once, each with its document's label."""
    levels, y = np.unique(labels, return_inverse=True)
    words, starts = parts.words, parts.starts
    sizes = np.diff(np.r_[starts, len(words)])
    target = np.repeat(y, parts.counts)
    weight = np.repeat(1 / np.sqrt(np.maximum(1, parts.counts)), parts.counts) * np.minimum(sizes, 10)
    weight = weight / weight.sum()
    used, words = np.unique(words, return_inverse=True)
    grams = [_grams(vocabulary.words[u]) for u in used]
    gram_at, gram_of = np.concatenate([np.array(g) for g in grams]), np.repeat(np.arange(len(used)), [len(g) for g in grams])
    gram_w = np.repeat([1 / len(g) for g in grams], [len(g) for g in grams])
    owner, inverse = np.repeat(np.arange(len(sizes)), sizes), np.repeat(1 / sizes, sizes)
    k = len(levels)
    own, gr, bias = np.zeros((len(used), k)), np.zeros((BUCKETS, k)), np.zeros(k)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (own, gr, bias)]
    one = np.eye(k)[target]
    spread = lambda at, v, n: np.stack([np.bincount(at, v[:, c], n) for c in range(k)], 1)
    for t in range(1, rounds + 1):
        v = own + spread(gram_of, gr[gram_at] * gram_w[:, None], len(used))
        z = np.add.reduceat(v[words], starts) * (1 / sizes)[:, None] + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - one) * weight[:, None]
        gv = spread(words, g[owner] * inverse[:, None], len(used))
        slopes = [gv + ridge * own, spread(gram_at, gv[gram_of] * gram_w[:, None], BUCKETS) + ridge * gr, g.sum(0)]
        for param, slope, (m, s) in zip((own, gr, bias), slopes, moments, strict=True):
            m += 0.1 * (slope - m)
            s += 0.01 * (slope**2 - s)
            param -= 0.5 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9) / (1 + t / 40)
    return SentenceModel(levels, {vocabulary.words[u]: own[i].astype(np.float32) for i, u in enumerate(used)}, gr.astype(np.float32), bias.astype(np.float32))


class Scorer:
    """Sentence-level distributions of texts by a model, with the vectors of words kept."""

    def __init__(self, model: SentenceModel, vocabulary: Vocabulary | None = None, limit: int = 400_000):
        self.model, self.limit = model, limit
        self.reset(vocabulary)

    def reset(self, vocabulary: Vocabulary | None = None) -> None:
        self.vocabulary, self.table, self.filled = vocabulary or Vocabulary(), np.zeros((1024, len(self.model.levels)), np.float32), 1

    def features(self, parts: Parts) -> np.ndarray:
        """A row a text: mean and share of the sentence levels by words, mean scores, lengths of sentences and words."""
        n = len(self.vocabulary.words)
        if n > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((2 * n - len(self.table), self.table.shape[1]), np.float32)])
        for i in range(self.filled, n):
            self.table[i] = self.model.vector(self.vocabulary.words[i])
        self.filled = n
        k = len(self.model.levels)
        out = np.zeros((len(parts.lengths), 3 * k + 3), np.float32)
        full = np.flatnonzero(parts.lengths)
        if not len(full):
            return out
        words, starts, lengths, counts = parts.words, parts.starts, parts.lengths[full], parts.counts[full]
        sizes = np.diff(np.r_[starts, len(words)])
        z = np.add.reduceat(self.table[words], starts) / sizes[:, None] + self.model.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        first = np.r_[0, np.cumsum(counts)[:-1]]
        w = np.minimum(sizes, 15).astype(np.float32)[:, None]
        total = np.add.reduceat(w, first)
        top = np.eye(k, dtype=np.float32)[p.argmax(1)]
        out[full, :k] = np.add.reduceat(p * w, first) / total
        out[full, k : 2 * k] = np.add.reduceat(top * w, first) / total
        out[full, 2 * k : 3 * k] = np.add.reduceat(z * w, first) / total / 4
        out[full, 3 * k] = np.log1p(lengths / counts) / 3
        out[full, 3 * k + 1] = np.log1p(lengths) / 6
        out[full, 3 * k + 2] = 1
        return out


def fit_levels(x: np.ndarray, y: np.ndarray, rounds: int = 400, ridge: float = 1e-4) -> np.ndarray:
    """Multinomial logistic regression of levels on the features of documents."""
    levels, t = np.unique(y, return_inverse=True)
    one, w = np.eye(len(levels))[t], np.zeros((x.shape[1], len(levels)))
    m, s = np.zeros_like(w), np.zeros_like(w)
    for i in range(1, rounds + 1):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = x.T @ (p - one) / len(x) + ridge * w
        m += 0.1 * (g - m)
        s += 0.01 * (g**2 - s)
        w -= 0.2 * (m / (1 - 0.9**i)) / (np.sqrt(s / (1 - 0.99**i)) + 1e-9)
    return w


@dataclass
class LevelModel:
    sentence: SentenceModel
    document: np.ndarray


def fit(texts: list[str], labels: list[int], seed: int = 7) -> LevelModel:
    """Both models: the document model on features from sentence models of the other fold, the sentence model on all."""
    y = np.array(labels)
    vocabulary = Vocabulary()
    parts = cut_texts(texts, vocabulary)
    keep = np.flatnonzero(parts.lengths)
    parts, y = parts.pick(keep), y[keep]
    fold = np.random.default_rng(seed).permutation(len(y)) % 2
    whole = fit_sentences(parts, y, vocabulary)
    x = np.zeros((len(y), 3 * len(whole.levels) + 3))
    for f in (0, 1):
        train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if set(y[train]) != set(y) or not len(test):
            x = Scorer(whole, vocabulary).features(parts)
            break
        x[test] = Scorer(fit_sentences(parts.pick(train), y[train], vocabulary), vocabulary).features(parts.pick(test))
    return LevelModel(whole, fit_levels(x, y))


def predict(model: LevelModel, scorer: Scorer, texts: list[str]) -> np.ndarray:
    """The level of each text; 0 for one without words."""
    parts = cut_texts(texts, scorer.vocabulary)
    level = model.sentence.levels[(scorer.features(parts) @ model.document).argmax(1)].astype(np.int64)
    if len(scorer.vocabulary) > scorer.limit:
        scorer.reset()
    return np.where(parts.lengths > 0, level, 0)


def reading_levels(documents: DataFrame, labelled: DataFrame, text: str, label: str, out: str = "reading_level", min_words: int = 1, max_labels: int = MAX_LABELS, order: str = "doc_id") -> DataFrame:
    """documents with the estimated level of each text in a new column.

    labelled has text, label and the id column order; at most max_labels of its rows are used to fit, by hash of the id.
    Null texts and texts of fewer than min_words words (split at white space) or without any letters get null. Labels that are null are ignored; with fewer than two labels every
    text gets the only one, or null. Other columns, repeated rows and empty tables are kept as they are.
    """
    spark = documents.sparkSession
    usable = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull() & F.col(order).isNotNull())
    picked = usable.select(F.col(order).alias("_i")).distinct().orderBy(F.xxhash64("_i"), "_i").limit(max_labels)  # ids alone are sorted out
    texts = usable.join(F.broadcast(picked), F.col(order) == F.col("_i")).groupBy("_i").agg(F.min(F.struct(F.col(text).alias("_t"), F.col(label).cast("int").alias("_l"))).alias("_v"))
    rows = texts.select("_i", "_v.*").orderBy("_i").collect()
    kinds = {r["_l"] for r in rows}
    if len(kinds) < 2:
        only = F.lit(next(iter(kinds), None)).cast("int")
        return documents.withColumn(out, F.when(F.size(F.split(F.trim(text), r"\s+")) >= min_words, F.when(F.trim(text) != "", only)))
    shared = spark.sparkContext.broadcast(fit([r["_t"] for r in rows], [r["_l"] for r in rows]))

    @F.pandas_udf(T.IntegerType())
    def level(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        scorer = Scorer(model.sentence)
        for texts in batches:
            values = [t if isinstance(t, str) and (min_words <= 1 or len(t.split()) >= min_words) else "" for t in texts]
            found = np.concatenate([predict(model, scorer, values[i : i + 500]) for i in range(0, len(values), 500)]) if values else np.zeros(0, np.int64)
            yield pd.Series(pd.array(np.where(found > 0, found, 0), "Int32")).mask(found == 0, None)

    return documents.withColumn(out, level(F.col(text)))
