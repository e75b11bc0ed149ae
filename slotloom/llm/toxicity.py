"""Operator 9: toxicity by a counterfactual-regularised linear classifier.

The classifier is logistic regression on the words that a text holds and on their first 4 to 7 letters, which words of one stem
share (all hashed). For every labelled text that names a group, counterfactuals are made by swapping each identity term for every
other of its set; neutral sentences (``NEUTRAL``) name every term of every set in turn, also those that no labelled text has. The squared
change of the score between a text and its counterfactual is part of the loss, so that a neutral mention of a group
cannot move a score, whatever company the term keeps in the labels.

It is fitted on the driver on the features of at most ``TRAIN_ROWS`` labelled documents of each class, chosen by a hash; the class shares are
those of all labels that may be used. A fifth of each class calibrates the scores. Defined results: a null text scores as an
empty one; where the sample has no text of one class, every score is the share of label 1 among the labels (0.5 without labels); equal texts score alike.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotloom.llm.common import documents, fold
from slotloom.llm.features import Buckets, both, calibrated, sampled, share_of, split, with_scores, words

TRAIN_ROWS = 1500
BITS = 19
STEMS = (4, 5, 6, 7)
LIMIT = 0.3
RIDGE = 1e-5
#: Weight of the counterfactual part of the loss.
FAIR = 1.0
ROUNDS = 120
#: Sets of identity terms that a sentence should be able to swap without a change of its toxicity.
IDENTITIES = [
    "woman man", "women men", "female male", "girl boy", "girls boys", "she he", "her his", "mother father", "wife husband", "daughter son",
    "muslim christian jewish hindu buddhist atheist", "muslims christians jews hindus buddhists atheists", "islam christianity judaism hinduism buddhism",
    "black white asian latino arab", "african european american", "gay straight lesbian bisexual", "transgender cisgender", "homosexual heterosexual",
    "immigrant native", "immigrants natives", "mexican chinese indian german french spanish british russian", "old young", "elderly teenage", "disabled abled", "deaf blind",
    "femme homme", "femmes hommes", "musulman chrétien juif", "noir blanc", "frau mann", "frauen männer", "muslimisch christlich jüdisch", "mujer hombre", "mujeres hombres", "musulmán cristiano judío", "negro blanco",
]
#: Sentences that say nothing of whom they name.
NEUTRAL = ["the {} was here", "a {} person", "i am {}", "{} and the others"]
SETS = [terms.split() for terms in IDENTITIES]
PLACE = {term: (own, i) for own in SETS for i, term in enumerate(own)}


def swapped(text: str) -> list[list[str]]:
    """The words of ``text`` with its identity terms swapped, once for each way to move along their sets; none if it has no term."""
    own = words(text)
    most = max((len(PLACE[w][0]) for w in own if w in PLACE), default=1)
    moved = lambda w, k: PLACE[w][0][(PLACE[w][1] + k) % len(PLACE[w][0])] if w in PLACE else w
    ways = [[moved(w, k) for w in own] for k in range(1, most)]
    return [w for w in ways if w != own]


def neutral_pairs() -> list[tuple[list[str], list[str]]]:
    """Each neutral sentence with each term of a set, beside the same with the next."""
    return [(words(s.format(a)), words(s.format(b))) for s in NEUTRAL for own in SETS for a, b in zip(own, [*own[1:], own[0]])]


class Stems(Buckets):
    """The buckets of each word and of its beginnings."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.keep:
            self.clear()
        parts = [word, *(word[:k] + "*" for k in STEMS if len(word) >= k)]
        found = self[word] = tuple(crc32(x.encode("utf-8", "surrogatepass")) & self.mask for x in parts)
        return found


def _row(own: list[str], stems: Stems) -> np.ndarray:
    return np.fromiter(set().union(*map(stems.__getitem__, set(own))), np.int32)


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*rows, np.empty(0, np.int32)]), np.array([len(x) for x in rows], np.int64)


def features(bits: int = BITS):
    """A function from a text to its features and those of its counterfactuals."""
    stems = Stems(bits, keep=150_000)
    return lambda text: [_row(words(text), stems), *[_row(w, stems) for w in swapped(text)]]


def _margins(w: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(w[flat])])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def fit(rows: list[list[np.ndarray]], y: np.ndarray, share: float, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Weights by bucket and the intercept, both on the scale of calibrated log-odds, from the ``features`` of texts of both classes."""
    held, kept = split(y, 3)
    stems = Stems(bits)
    flat, counts = _flat([rows[i][0] for i in kept])
    pairs = [(rows[i][0], other) for i in kept for other in rows[i][1:]]
    pairs += [(_row(a, stems), _row(b, stems)) for a, b in neutral_pairs()]
    a_flat, a_counts = _flat([p for p, _ in pairs])
    b_flat, b_counts = _flat([s for _, s in pairs])
    t, n, m = y[kept].astype(float), len(kept), len(pairs)
    spread = lambda values, flat, counts: np.bincount(flat, np.repeat(values, counts), minlength=1 << bits)
    # a feature counts as much as its frequencies in the two classes differ; else the many that say nothing drown the few that do
    one, zero = 1 + spread(t, flat, counts), 1 + spread(1 - t, flat, counts)
    scale = np.abs(np.log(one / (1 + t.sum())) - np.log(zero / (1 + n - t.sum())))
    bend, v = 1.0, scale / (np.linalg.norm(scale) + 1e-12)
    for _ in range(25):  # power iterations: the largest curvature of the loss
        u = v * scale
        change = _margins(u, a_flat, a_counts) - _margins(u, b_flat, b_counts)
        v = scale * (spread(_margins(u, flat, counts) / n / 4, flat, counts) + 2 * FAIR / m * (spread(change, a_flat, a_counts) - spread(change, b_flat, b_counts)))
        bend = float(np.linalg.norm(v))
        v = v / (bend + 1e-12)
    bend = 1.2 * bend + 0.5 + RIDGE
    w, before, bias, bias_before = np.zeros(1 << bits), np.zeros(1 << bits), 0.0, 0.0
    for k in range(ROUNDS):  # Nesterov's accelerated gradient
        push = k / (k + 3)
        v, c = w + push * (w - before), bias + push * (bias - bias_before)
        u = v * scale
        g = 1 / (1 + np.exp(-np.clip(_margins(u, flat, counts) + c, -30, 30))) - t
        change = _margins(u, a_flat, a_counts) - _margins(u, b_flat, b_counts)
        grad = scale * (spread(g / n, flat, counts) + 2 * FAIR / m * (spread(change, a_flat, a_counts) - spread(change, b_flat, b_counts))) + RIDGE * v
        before, w, bias_before, bias = w, v - grad / bend, bias, c - g.mean() / bend
    w = w * scale
    slope, shift = calibrated(_margins(w, *_flat([rows[i][0] for i in held])) + bias, y[held], y, share)
    return slope * w, float(slope * bias + shift)


def scorer(weights: np.ndarray, bias: float, bits: int = BITS):
    buckets = Stems(bits, keep=150_000)

    def score(texts: list[str]) -> np.ndarray:
        flat, counts = _flat([_row(words(t), buckets) for t in texts])
        return 1 / (1 + np.exp(-np.clip(_margins(weights, flat, counts) + bias, -30, 30)))

    return score


def toxicity(docs: DataFrame, labelled: DataFrame, labels: DataFrame, may=None, label: str = "toxic", rows: int = TRAIN_ROWS) -> DataFrame:
    """Adds ``score`` and ``predicted`` to ``docs``; learns from the rows of ``labels`` that ``may`` admits, with the texts of ``labelled``."""
    may = F.lit(True) if may is None else may
    share = share_of(labels, label, may)
    found = sampled(labelled, labels, label, may, rows, features)
    if not both(found):
        return with_scores(docs, lambda: lambda texts: np.full(len(texts), share), LIMIT)
    weights, bias = fit([x for x, _ in found], np.array([v for _, v in found]), share)
    weights = weights.astype(np.float32)
    return with_scores(docs, lambda: scorer(weights, bias), LIMIT)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = toxicity(documents(spark, sf_dir, "doc_id", "text"), documents(spark, sf_dir, "doc_id", "text"), labels, fold(4) != 2)
    return out.select("doc_id", (fold(4) == 2).alias("held_out"), "score", "predicted")
