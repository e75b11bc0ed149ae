"""Operator 3: SimHash near-duplicates by covering locality-sensitive hashing.

A table of the covering keeps the bits that one structured mask selects. Each bit position gets a non-zero value of
r + 1 bits, and the mask of v (1 to 2^(r+1) - 1) selects the positions whose value has an odd product with v. Any r positions
give r linear conditions on v, which some v that isn't zero meets: in that table two fingerprints that differ in those
positions alone share their key. So no pair within the radius is missed.

Equal fingerprints are one node from the start. A bucket of more than ``CAP`` fingerprints is divided again by a second and a
third covering of the same kind, which guarantee the same; after the third at most 12 of the 64 bits are free, so that no bucket
can hold more than 4,096 different fingerprints. Nothing is capped.

Defined results: a null or empty text, or one of white space, has fingerprint zero and links like any other; rows with a null
doc_id keep a row of their own; a component's id is the smallest doc_id in it (null if it has none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotloom.llm.common import documents, joined, slices, written
from slotloom.llm.components import components

RADIUS = 3
WORDS = 3
CAP = 512
SEED = 42
#: Shingles whose bits are counted at once.
SLICE = 1 << 14


def fingerprints(texts: list[str | None], words: int = WORDS) -> np.ndarray:
    """The 64-bit fingerprint of each text: bit by bit, the majority among the hashes of its shingles."""
    out, shingle, digest = np.zeros(len(texts), np.uint64), b" ".join, xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        w = text.encode().lower().split() if text else []  # of bytes: only A-Z, only ASCII's white space
        if not w:
            continue
        grams = map(shingle, zip(*(w[k:] for k in range(words)))) if len(w) >= words else [shingle(w)]
        h = np.fromiter((digest(g, SEED) for g in grams), np.uint64, max(1, len(w) - words + 1))
        ones = sum(np.unpackbits(h[a : a + SLICE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64) for a in range(0, len(h), SLICE))
        out[i] = np.packbits(2 * ones > len(h)).view(">u8")[0]
    return out


def with_fingerprint(df: DataFrame, id_: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``(id, fp)``: the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1).to_pylist(), words).view(np.int64))], names=["id", "fp"])

    inner = df.select(F.col(id_).alias("id"), F.col(text).alias("text"))
    return inner.mapInArrow(run, f"id {inner.dtypes[0][1]}, fp bigint")


def covering(level: int, radius: int = RADIUS) -> list[int]:
    """The masks of one covering of 64 bits; each level gives positions their values in another order."""
    n = 2 ** (radius + 1) - 1
    values = [1 + ((i + 1) * (1, 7, 24)[level] % 67 - (level == 0)) % n for i in range(64)]
    return [sum(1 << i for i, m in enumerate(values) if (m & v).bit_count() % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(rows: DataFrame, level: int, within: list[str]) -> DataFrame:
    """Each fingerprint once for each table of the covering, with its key there; ``within`` are the columns that already divide it."""
    masks = F.array(*[F.lit(_signed(m)) for m in covering(level)])
    rows = rows.select(*within, "fp", F.posexplode(masks).alias(f"t{level}", "mask"))
    return rows.select(*within, F.col(f"t{level}"), F.col("fp").bitwiseAND(F.col("mask")).alias(f"k{level}"), "fp")


def _bucket_links(lists: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket a link from every member to the smallest that links within the bucket lead to."""
    us, vs = [], []
    by_size: dict[int, list[np.ndarray]] = {}
    for x in lists:
        by_size.setdefault(len(x), []).append(x)
    for size, same in by_size.items():
        step = max(1, (1 << 21) // size**2)
        for at in range(0, len(same), step):
            x = np.sort(np.stack(same[at : at + step]), axis=1)
            rows = [slice(r, r + max(1, (1 << 21) // size)) for r in range(0, size, max(1, (1 << 21) // size))]
            near = np.concatenate([np.bitwise_count((x[:, r, None] ^ x[:, None, :]).view(np.uint64)) <= radius for r in rows], axis=1)
            label = np.broadcast_to(np.arange(size), x.shape)
            while True:
                then = np.concatenate([np.where(near[:, r], label[:, None, :], size).min(2) for r in rows], axis=1)
                if (then == label).all():
                    break
                label = then
            b, i = np.nonzero(label != np.arange(size))
            us.append(x[b, i])
            vs.append(x[b, label[b, i]])
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.empty(0, np.int64), np.empty(0, np.int64))


def _linked(buckets: DataFrame, radius: int) -> DataFrame:
    """Links within buckets of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            u, v = _bucket_links([flat[a:b] for a, b in zip(offsets, offsets[1:])], radius)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return buckets.mapInArrow(run, "u bigint, v bigint")


def links(distinct: DataFrame, radius: int = RADIUS, cap: int = CAP) -> DataFrame:
    """Links ``(u, v)`` between the different fingerprints of ``distinct (fp)`` that join whatever chains of pairs within ``radius`` join."""
    rows, by, found = distinct.select("fp"), [], []
    for level in range(3):
        keyed = _keyed(rows, level, by)
        by = [*by, f"t{level}", f"k{level}"]
        keyed = written(keyed, f"keyed{level}") if level else keyed
        sizes = written(keyed.groupBy(*by).agg(F.count("*").alias("n"), F.count("*").alias("all")).where("n > 1"), f"sizes{level}")
        rows = written(joined(keyed, sizes, by, "all", keyed.count()), f"buckets{level}")
        last = level == 2  # what is left there is bounded by the bits that are free
        found.append(_linked((rows if last else rows.where(F.col("n") <= cap)).groupBy(*by).agg(F.collect_list("fp").alias("fps")).select("fps"), radius))
        rows = rows.where(F.col("n") > cap).drop("n")
        if last or rows.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return written(out.distinct(), "links")


def near_duplicates(prints: DataFrame) -> DataFrame:
    """Adds ``component_id`` to ``prints (id, fp)``: the smallest id among the rows that chains of links reach."""
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "nodes")
    of = components(links(nodes))
    of = written(of.withColumnRenamed("node", "fp").join(nodes, "fp"), "of")
    named = written(of.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("all")), "named")
    linked = joined(of, named, ["component"], "all", of.count()).select("fp", "component_id")
    each = written(nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n"), "each")
    return joined(prints, each, ["fp"], "n", prints.count()).select("id", "fp", "component_id")


def once(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each doc_id: the least by text, then by the other columns. Rows without a doc_id stay."""
    often = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "often")
    if often.isEmpty():
        return docs
    names = ["text", *[c for c in docs.columns if c not in ("text", "doc_id")]]
    least = docs.join(often, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*names)).alias("row")).select("doc_id", "row.*").select(docs.columns)
    return written(docs.join(often, "doc_id", "left_anti").unionByName(least), "once")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the one their group of near-duplicates keeps: the one of the smallest doc_id. Rows without a doc_id stay; of several rows of one doc_id only the least by text, then by the other columns, counts."""
    docs = once(docs)
    prints = written(with_fingerprint(docs), "prints")
    lost = near_duplicates(prints).where("id != component_id").select(F.col("id").alias("doc_id"))
    return docs.join(lost, "doc_id", "left_anti")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = written(with_fingerprint(documents(spark, sf_dir, "doc_id", "text")), "prints")
    return near_duplicates(prints).select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
