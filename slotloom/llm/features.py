"""Hashed word n-grams of texts, and bounded samples of labelled documents: what the two text classifiers share.

Executors turn the sampled texts into features; the driver gets these alone, at most ``rows`` of each class and a few kB each.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotloom.llm.common import free_name, slices, written

_TOKEN = re.compile(r"\w+|[^\w\s]+")


def words(text: str) -> list[str]:
    """Lower-case words and runs of punctuation."""
    return _TOKEN.findall(text.lower())


def words_cased(text: str) -> list[str]:
    return _TOKEN.findall(text)


def sampled(docs: DataFrame, labels: DataFrame, label: str, may: Column, rows: int, features: Callable[[], Callable[[str], list[np.ndarray]]]) -> list[tuple[list[np.ndarray], int]]:
    """Features and labels of at most ``rows`` labelled documents of each class that ``may`` be learned from, chosen by a hash of doc_id. ``features()`` makes a worker's function of a text.

    Repeated label rows count once, a document with both labels not at all; repeated doc_ids give one text, the least. Labels of documents
    that are not in ``docs`` are left out; if others are to take their place, pass the labels of those that are.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & may).groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other")
    key = [F.xxhash64("doc_id", F.lit(11)), F.col("doc_id")]
    picked = known.where("label = 0").orderBy(*key).limit(rows).unionByName(known.where("label = 1").orderBy(*key).limit(rows)).select("doc_id", "label")
    picked = written(picked, "picked")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")  # 2 * rows at most
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select(F.col("label").cast("int").alias("label"), "text", F.xxhash64("doc_id").alias("at"), F.col("doc_id").cast("string").alias("name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = features()
        for whole in batches:
            for batch in slices(whole, 1):
                found = [[x.astype("<i4").tobytes() for x in of(t)] for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(found, pa.list_(pa.binary()))], names=["label", "at", "name", "parts"])

    found = texts.mapInArrow(run, "label int, at bigint, name string, parts array<binary>").collect()
    return [([np.frombuffer(x, "<i4") for x in r["parts"]], r["label"]) for r in sorted(found, key=lambda r: (r["at"], r["name"]))]


def split(y: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A fifth of each class to calibrate with, and the rest to fit; nothing is held back of a class with fewer than five rows."""
    rng, held = np.random.default_rng(seed), []
    for c in (0, 1):
        own = rng.permutation(np.flatnonzero(y == c))
        held.append(own[: len(own) // 5])
    held = np.sort(np.concatenate(held))
    return held, np.setdiff1d(np.arange(len(y)), held)


def calibrated(margin: np.ndarray, y: np.ndarray, sample: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and intercept from margins to log-odds: by ``platt`` where both classes are held back, else the margins as they are; moved from the sample's share of label 1 to ``share``."""
    slope, shift = platt(margin, y) if 0 < y.sum() < len(y) else (1.0, 0.0)
    own = float(np.clip(sample.mean(), 1e-6, 1 - 1e-6))
    share = float(np.clip(share, 1e-6, 1 - 1e-6))
    return slope, shift + np.log(share / (1 - share)) - np.log(own / (1 - own))


def both(found: list[tuple[list[np.ndarray], int]]) -> bool:
    """Whether the sample holds texts of both classes."""
    return len({y for _, y in found}) == 2


def with_scores(docs: DataFrame, score: Callable[[], Callable[[list[str]], np.ndarray]], limit: float, text: str = "text") -> DataFrame:
    """Adds ``score`` and ``predicted`` (1 if the score reaches ``limit``); ``score()`` makes a worker's scoring function. A null text is scored as an empty one."""
    at, kinds = docs.columns.index(text), [t for _, t in docs.dtypes]
    names = [f"c{i}" for i in range(len(kinds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = score()
        for whole in batches:
            for batch in slices(whole, at):
                found = np.asarray(scorer([t or "" for t in batch.column(at).to_pylist()]), np.float64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array((found >= limit).astype(np.int32))], names=[*names, "score", "predicted"])

    schema = ", ".join([*(f"{n} {t}" for n, t in zip(names, kinds)), "score double, predicted int"])
    return docs.toDF(*names).mapInArrow(run, schema).toDF(*docs.columns, free_name(docs, "score"), free_name(docs, "predicted"))


class Buckets(dict):
    """The bucket of each word, kept once computed. Cleared when it grows too large."""

    def __init__(self, bits: int, keep: int = 300_000):
        super().__init__()
        self.mask, self.keep = (1 << bits) - 1, keep

    def __missing__(self, word: str) -> int:
        if len(self) >= self.keep:
            self.clear()
        bucket = self[word] = crc32(word.encode("utf-8", "surrogatepass")) & self.mask
        return bucket


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through held-out margins, by Newton's method on smoothed labels."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones(len(y))], axis=1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x.T * (p * (1 - p))) @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (t - p))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def share_of(labels: DataFrame, label: str, may: Column) -> float:
    """The share of label 1 over all labels that may be used; 0.5 without any."""
    n = labels.where(F.col(label).isin(0, 1) & may).agg(F.sum(F.col(label).cast("double")).alias("one"), F.count("*").alias("all")).first()
    return (n["one"] or 0.0) / n["all"] if n["all"] else 0.5
