"""Operator 10: quality by naive Bayes support vectors.

A text's features are indicators of its word unigrams and bigrams and of the unigrams to trigrams of its words' shapes (hashed).
Each is scaled by the log of the ratio of its smoothed frequencies in the two classes; on these a linear model with hinge loss
is fitted by dual coordinate descent, and mixed with the plain ratios' mean weight as usual.

It is fitted on the driver on the features of at most ``TRAIN_ROWS`` labelled documents of each class, chosen by a hash; the class shares are
those of all labels that may be used. A fifth of each class calibrates the scores. Defined results: a null text scores as an
empty one; where the sample has no text of one class, every score is the share of label 1 among the labels (0.5 without labels); equal texts score alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotloom.llm.common import documents, fold
from slotloom.llm.features import Buckets, both, calibrated, sampled, share_of, split, with_scores, words_cased
from slotloom.llm.toxicity import _flat, _margins

TRAIN_ROWS = 3000
BITS = 18
LIMIT = 0.3
SMOOTH = 1.0
COST = 0.1
ROUNDS = 12
MIX = 0.5


def shape(word: str) -> str:
    """Punctuation as it is, up to 3 of it; digits, capitals, capitalised and other words by kind and whether they are long."""
    if not word[0].isalnum() and word[0] != "_":
        return word[:3]
    size = "short" if len(word) <= 3 else "long" if len(word) > 12 else "word"
    return size + ("9" if word.isdigit() else "A" if word.isupper() and len(word) > 1 else "Aa" if word[0].isupper() else "a")


class Features:
    """The features of texts: sorted distinct buckets."""

    def __init__(self, bits: int = BITS):
        self.buckets, self.bits = Buckets(31), bits
        self.shapes: dict[str, int] = {}

    def _shape(self, word: str) -> int:
        found = self.shapes.get(word)
        if found is None:
            if len(self.shapes) >= 300_000:
                self.shapes.clear()
            found = self.shapes[word] = self.buckets["\0" + shape(word)]
        return found

    def __call__(self, text: str) -> np.ndarray:
        own = words_cased(text)
        w = np.fromiter(map(self.buckets.__getitem__, map(str.lower, own)), np.int64, len(own))
        s = np.fromiter(map(self._shape, own), np.int64, len(own))
        mix = lambda a, b: (a * 1_000_003 + b * 8_191 + 12_345) & 0x7FFFFFFF
        ss = mix(s[:-1], s[1:])
        every = np.concatenate([w, mix(w[:-1], w[1:]), s, ss, mix(ss[:-1], s[2:])])
        found = np.zeros(1 << self.bits, bool)
        found[(every ^ every >> self.bits) & ((1 << self.bits) - 1)] = True
        return np.flatnonzero(found)


def features(bits: int = BITS):
    of = Features(bits)
    return lambda text: [of(text)]


def fit(found: list[list[np.ndarray]], y: np.ndarray, share: float, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Weights by bucket and the intercept, both on the scale of calibrated log-odds, from the ``features`` of texts of both classes."""
    held, kept = split(y, 5)
    rows, t = [found[i][0] for i in kept], y[kept] * 2.0 - 1
    p, q = (SMOOTH + np.bincount(np.concatenate([r for r, s in zip(rows, t) if s == c]), minlength=1 << bits) for c in (1, -1))
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    w, bias, alpha = np.zeros(1 << bits), 0.0, np.zeros(len(rows))
    scaled = [ratio[r] for r in rows]
    norm = np.array([x @ x + 1 for x in scaled])
    for k in range(ROUNDS):
        moved = 0.0
        for i in np.random.default_rng(k).permutation(len(rows)):
            slack = 1 - t[i] * (w[rows[i]] @ scaled[i] + bias)
            a = min(max(alpha[i] + slack / norm[i], 0.0), COST)
            if a != alpha[i]:
                step = (a - alpha[i]) * t[i]
                w[rows[i]] += step * scaled[i]
                bias += step
                moved = max(moved, abs(a - alpha[i]))
                alpha[i] = a
        if moved < 1e-5:
            break
    weights = ratio * ((1 - MIX) * np.abs(w).mean() + MIX * w)
    slope, shift = calibrated(_margins(weights, *_flat([found[i][0] for i in held])) + bias * MIX, y[held], y, share)
    return slope * weights, float(slope * bias * MIX + shift)


def scorer(weights: np.ndarray, bias: float, bits: int = BITS):
    of = Features(bits)

    def score(texts: list[str]) -> np.ndarray:
        return np.array([1 / (1 + np.exp(-np.clip(weights[of(t)].sum() + bias, -30, 30))) for t in texts])

    return score


def quality(docs: DataFrame, labelled: DataFrame, labels: DataFrame, may=None, label: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """Adds ``score`` and ``predicted`` to ``docs``; learns from the rows of ``labels`` that ``may`` admits, with the texts of ``labelled``."""
    may = F.lit(True) if may is None else may
    share = share_of(labels, label, may)
    found = sampled(labelled, labels, label, may, rows, features)
    if not both(found):
        return with_scores(docs, lambda: lambda texts: np.full(len(texts), share), LIMIT)
    weights, bias = fit([x for x, _ in found], np.array([v for _, v in found]), share)
    return with_scores(docs, lambda: scorer(weights, bias), LIMIT)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = quality(documents(spark, sf_dir, "doc_id", "text"), documents(spark, sf_dir, "doc_id", "text"), labels, fold(5) != 0)
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")
