"""Near-duplicate texts by shingle similarity: pairs whose sets of 5-word shingles have a Jaccard index of 0.8 or more.

Candidates come from operator 3, whose covering links the SimHash fingerprints of 5-word shingles within its radius, and from bands of minimum hashes,
since most pairs of 0.8 differ in more bits than any covering can afford: pairs that share one of ``BANDS`` bands of ``ROWS`` hashes. A pair of similarity s
does so with probability 1 - (1 - s^5)^22, 0.9998 at 0.8 and more above. Whether a candidate counts is decided by the shingles.

Texts of the same words are one node from the start. A bucket's members are first compared with its hub, the one that shares most with all
others; in a group of copies of one text that is the text or nearly so. What the hubs leave apart is compared in the buckets again, but by no more than
can matter: only shingles that some other group of linked texts has can be common to two groups, so a text with too few of them is left
out, and the others carry these shingles alone. So every link that joins groups is found, nothing is capped, and no pair leaves a join that is no link.

Defined results: words are lower-cased (A-Z) and divided at ASCII's white space; a text of fewer than five words is one shingle; texts
without words are copies of one another and of nothing else; rows with a null doc_id stay and link nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.llm import simhash
from slotloom.llm.common import joined, slices, written
from slotloom.llm.components import components
from slotloom.llm.simhash import SEED, once

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 22, 5
#: A document meets so many others in one task, and a bucket is divided into parts of so many.
PART, LARGE = 256, 1024

_random = np.random.default_rng(SEED)
_FLIPS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2)
_FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> set[bytes]:
    w = text.encode().lower().split() if text else []
    return set(map(b" ".join, zip(*(w[k:] for k in range(words))))) if len(w) >= words else {b" ".join(w)} if w else set()


def bands(grams: set[bytes]) -> np.ndarray:
    """One key for each band, of the smallest values of its hashes over ``grams``."""
    h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1024):
        least = np.minimum(least, ((h[at : at + 1024] ^ _FLIPS[:, None]) * _FACTORS[:, None]).min(1))
    return (least * _FACTORS[::-1]).reshape(BANDS, ROWS).sum(1, dtype=np.uint64).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """``(id, words, n, keys)``: a digest of the text's words, how many shingles it has, and its bands (none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                digests, counts, keys = [], [], []
                for text in batch.column(1).to_pylist():
                    grams = shingles(text)
                    digests.append(xxhash.xxh128_digest(b" ".join(text.encode().lower().split()) if text else b"", SEED))
                    counts.append(len(grams))
                    keys.append(bands(grams) if grams else [])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "words", "n", "keys"])

    inner = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
    return inner.mapInArrow(run, f"id {inner.dtypes[0][1]}, words binary, n bigint, keys array<bigint>")


def grams_of(docs: DataFrame) -> DataFrame:
    """``(v, n, grams)``: 64-bit hashes of the shingles of each document, and how many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, rows=64):
                found = [[xxhash.xxh64_intdigest(g, SEED) - (1 << 63) for g in shingles(t)] for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["v", "n", "grams"])

    inner = docs.select(F.col("doc_id").alias("v"), "text")
    return inner.mapInArrow(run, f"v {inner.dtypes[0][1]}, n bigint, grams array<bigint>")


def similarities(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """``(u, v, j)``: the Jaccard index of the shingles of each of ``pairs (u, v)`` of doc_ids. A document that is ``u`` of many pairs is dealt out in parts."""
    text = lambda c: docs.select(F.col("doc_id").alias(c), F.col("text").alias(f"{c}_text"))
    pairs = written(pairs, "pairs")
    many = written(pairs.groupBy("u").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / PART).cast("int")), "many")
    left = many.join(text("u"), "u").select("u", "u_text", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = joined(pairs, many, ["u"], "n", pairs.count()).withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).drop("parts")
    both = right.join(text("v"), "v").join(left, ["u", "part"]).select("u", "v", "u_text", "v_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, a = None, set()
        for batch in batches:
            found = []
            for left, right in zip(batch.column(2), batch.column(3)):
                left = left.as_py()
                if left != last:
                    last, a = left, shingles(left)
                b = shingles(right.as_py())
                met = len(a & b)
                found.append(met / (len(a) + len(b) - met))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["u", "v", "j"])

    kind = dict(both.dtypes)["u"]
    return both.mapInArrow(run, f"u {kind}, v {kind}, j double")


def between(rows: DataFrame, docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Links ``(u, v)`` of at least that similarity between different components of ``rows (band, key, v, component)`` that share a bucket."""
    open_ = rows.groupBy("band", "key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("size")).where("a < b").select("band", "key", "size", F.col("size").alias("all"))
    rows = written(joined(rows, written(open_, "open"), ["band", "key"], "all", rows.count()), "open_rows")
    members = written(rows.select("v", "component").distinct(), "members")
    grams = written(grams_of(docs.join(members.select(F.col("v").alias("doc_id")), "doc_id", "left_semi")).join(members, "v"), "grams")
    each = grams.select("v", "component", F.explode("grams").alias("gram"))
    # by gram and part of the documents first, so that a shingle that very many share is some sixty rows
    some = each.groupBy("gram", F.pmod(F.xxhash64("v"), F.lit(64)).alias("part")).agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n"))
    shared = written(some.groupBy("gram").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n")).where("a < b").select("gram", "n"), "shared")
    kept = joined(each, shared, ["gram"], "n", max(1, grams.agg(F.sum("n")).first()[0] or 1)).groupBy("v").agg(F.collect_list("gram").alias("grams"))
    alive = kept.join(grams.select("v", "n"), "v").where(F.size("grams") >= F.col("n") * F.lit(least))
    rows = rows.join(alive, "v").withColumn("parts", F.ceil(F.col("size") / LARGE).cast("int"))
    rows = written(rows, "alive")
    side = lambda p: rows.select("band", "key", *[F.col(c).alias(f"{p}_{c}") for c in ("v", "component", "n", "grams")], *(["parts"] if p == "v" else [F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part")]))
    right = side("v").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    most = F.least(F.size("u_grams"), F.size("v_grams"))
    near = lambda met: met >= (F.col("u_n") + F.col("v_n") - met) * F.lit(least)
    fits = (F.col("u_v") < F.col("v_v")) & (F.col("u_component") != F.col("v_component")) & near(most) & near(F.size(F.array_intersect("u_grams", "v_grams")))
    left = side("u")
    on = (left["band"] == right["band"]) & (left["key"] == right["key"]) & (left["part"] == right["part"])
    return left.join(right, on & fits).select(F.col("u_v").alias("u"), F.col("v_v").alias("v")).distinct()


def links(nodes: DataFrame, docs: DataFrame, least: float = SIMILARITY, more: DataFrame | None = None) -> DataFrame:
    """Links ``(u, v)`` between ``nodes (v, n, keys)`` of ``docs`` that join whatever chains of candidates of at least that similarity join. ``more (u, v)`` are candidates from elsewhere."""
    keyed = written(nodes.select("v", F.posexplode("keys").alias("band", "key")), "keyed")
    sizes = written(keyed.groupBy("band", "key").agg(F.count("*").alias("size"), F.count("*").alias("all")).where("size > 1"), "sizes")
    rows = written(joined(keyed, sizes, ["band", "key"], "all", keyed.count()), "buckets")
    rows = written(rows.join(rows.groupBy("v").agg(F.sum("size").alias("weight")), "v"), "weighted")
    hubs = written(rows.groupBy("band", "key").agg(F.max(F.struct("weight", F.col("v").alias("u"))).alias("hub"), F.count("*").alias("all")).select("band", "key", "hub.u", "all"), "hubs")
    first = joined(rows, hubs, ["band", "key"], "all", rows.count()).where("u != v").select("u", "v")
    if more is not None:
        first = first.unionByName(more.select("u", "v"))
    first = written(similarities(first.distinct(), docs), "first").where(F.col("j") >= least).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    group = components(first).select(F.col("node").alias("v"), "component")
    known = written(rows.where("size > 2").join(group, "v", "left").select("band", "key", "v", F.coalesce("component", "v").alias("component")), "known")
    return written(first.unionByName(between(known, docs, least)), "links")


def by_fingerprint(docs: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` of the documents that operator 3 links: each with the first of its fingerprint, and the first ones of linked fingerprints."""
    prints = written(simhash.with_fingerprint(docs, words=WORDS), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("u"), F.count("*").alias("n")), "nodes")
    same = joined(prints.select(F.col("id").alias("v"), "fp"), nodes, ["fp"], "n", prints.count()).where("u != v").select("u", "v")
    name = lambda c: nodes.select(F.col("fp").alias(c), F.col("u").alias(f"{c}_id"))
    near = simhash.links(nodes.select("fp")).join(name("u"), "u").join(name("v"), "v").select(F.col("u_id").alias("u"), F.col("v_id").alias("v"))
    return same.unionByName(near)


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the one their group of near-duplicates keeps, as ``simhash.first_of_each`` chooses it."""
    docs = once(docs)
    found = written(sketches(docs), "sketches")
    nodes = written(found.groupBy("words").agg(F.min("id").alias("v"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.count("*").alias("all")), "nodes")
    same = joined(found.select("id", "words"), nodes.select("words", "v", "all"), ["words"], "all", found.count()).where("id != v").select(F.col("id").alias("doc_id"))
    nodes = nodes.where("n > 0")
    own = written(docs.join(nodes.select(F.col("v").alias("doc_id")), "doc_id", "left_semi"), "own")
    near = components(links(nodes.select("v", "n", "keys"), own, more=by_fingerprint(own))).where("node != component").select(F.col("node").alias("doc_id"))
    return docs.join(same.unionByName(near), "doc_id", "left_anti")
