"""Operator 6: language identification by rank-order profiles.

A language's profile is the ranking of the ``PROFILE`` most frequent character n-grams (1 to 3, words padded with a space) of all
its training texts. A document's most frequent n-grams are ranked the same way; its distance to a profile is the sum of how far
each is out of place, ``PROFILE`` for one that the profile lacks. The nearest language wins, ties to the first by name.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text where nothing was learned; rows
with a null language teach nothing; equal texts get equal results. Profiles are sent to every task: at most ``LANGUAGES`` of
them, about 5 kB each; more languages are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotloom.llm.common import documents, fold, free_name, slices

PROFILE = 400
LANGUAGES = 2000
#: A document resembles no language if its score is under this part of what all but ``RARE`` of the learned documents reach.
SLACK, RARE = 0.9, 0.001
_DENSE = 1 << 22


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text, each as one integer of up to three code points, and their counts."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[chars]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    seq = np.concatenate([[32], np.where(letter, chars, 32)[keep], [32] if letter[-1] else []]).astype(np.int64)
    ones = np.bincount(seq)
    alphabet = np.flatnonzero(ones)
    m = len(alphabet)
    place = np.zeros(len(ones), np.int64)
    place[alphabet] = np.arange(m)
    at = place[seq]
    codes, counts = [alphabet[1:]], [ones[alphabet[1:]]]  # without the space, the least of them
    pairs = at[:-1] * m + at[1:]
    for index in (pairs, pairs[:-1] * m + at[2:]):
        if m**3 <= _DENSE:
            dense = np.bincount(index)
            found = np.flatnonzero(dense)
            counts.append(dense[found])
        else:
            found, n = np.unique(index, return_counts=True)
            counts.append(n)
        high, low = found // m, alphabet[found % m]
        codes.append(alphabet[high // m] << 42 | alphabet[high % m] << 21 | low if index is not pairs else alphabet[high] << 21 | low)
    return np.concatenate(codes), np.concatenate(counts)


def ranked(codes: np.ndarray, counts: np.ndarray, k: int = PROFILE) -> np.ndarray:
    """The k most frequent n-grams, most frequent first, ties to the smaller code."""
    if len(codes) > k:
        often = counts >= np.partition(counts, -k)[-k]
        codes, counts = codes[often], counts[often]
    return codes[np.lexsort((codes, -counts))[:k]]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", k: int = PROFILE) -> dict[str, list[int]]:
    """The profile of each language, from n-gram counts over all of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def merged(parts: list) -> list:
            codes, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return [(codes, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64))]

        for whole in batches:
            for batch in slices(whole, 1):
                texts: dict[str, list[str]] = {}
                for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    texts.setdefault(name, []).append(value)
                for name, values in texts.items():
                    held.setdefault(name, []).append(grams("\n".join(values)))
                    if len(held[name]) >= 16:
                        held[name] = merged(held[name])
        for name, parts in held.items():
            ((codes, counts),) = merged(parts)
            for a in range(0, len(codes), 1 << 16):
                part = codes[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(part), pa.array(counts[a : a + (1 << 16)])], names=["lang", "gram", "n"])

    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = known.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= k)
    rows = best.orderBy("lang", "rank").limit(k * LANGUAGES + 1).collect()
    if len(rows) > k * LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    out: dict[str, list[int]] = {}
    for r in rows:
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Ranks:
    """All profiles as one sorted table of n-grams, with each one's rank in every language."""

    def __init__(self, profiles: dict[str, list[int]], k: int = PROFILE):
        self.names, self.k = sorted(profiles), k
        self.codes = np.unique(np.concatenate([np.asarray(p, np.int64) for p in profiles.values()])) if profiles else np.empty(0, np.int64)
        self.rank = np.full((len(self.codes) + 1, len(self.names)), -1, np.int64)  # the last row: n-grams of no profile
        for j, name in enumerate(self.names):
            self.rank[np.searchsorted(self.codes, profiles[name]), j] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = ranked(*grams(text or ""), self.k)
        if not len(codes) or not self.names:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        at[self.codes[at] != codes] = len(self.codes)
        rank = self.rank[at]
        far = np.where(rank < 0, self.k, np.abs(rank - np.arange(len(codes))[:, None])).sum(0)
        best = int(far.argmin())
        return self.names[best], float(1 - far[best] / (self.k * len(codes)))


def identify(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score``: 1 less the distance to the nearest profile over the largest possible distance."""
    at, kinds = docs.columns.index(text), [t for _, t in docs.dtypes]
    names = [f"c{i}" for i in range(len(kinds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks(profiles)
        for whole in batches:
            for batch in slices(whole, at):
                found = [ranks.predict(t) for t in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*names, "lang_pred", "score"])

    schema = ", ".join([*(f"{n} {t}" for n, t in zip(names, kinds)), "lang_pred string, score double"])
    return docs.toDF(*names).mapInArrow(run, schema).toDF(*docs.columns, free_name(docs, "lang_pred"), free_name(docs, "score"))


def least_score(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", lang: str = "lang") -> float:
    """The score below which a document resembles no language, from the scores of all of ``docs`` that have a language; 0 where nothing was learned."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"))
    found = identify(known, profiles).where("score > 0").agg(F.percentile_approx("score", RARE, 10_000).alias("q")).first()["q"]
    return SLACK * found if found is not None else 0.0


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    profiles = learn(docs.where(fold(4) != 2))
    return identify(docs.select("doc_id", "text"), profiles).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")
