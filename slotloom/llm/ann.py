"""Operator 7: approximate nearest neighbours by robust-pruned directed graphs, one in each shard.

Equal vectors are one node, with the ``TOP`` + 1 smallest ids that have it: more of them cannot reach any result. Nodes are
dealt by a hash over shards of about ``SHARD_ROWS``. In a shard, every node's greedy search of the graph so far proposes neighbours,
and relaxed distance pruning keeps a diverse ``DEGREE`` of them: a candidate is dropped if a kept one is nearer to it, by the factor
ALPHA, than the node itself is. A beam search of every shard answers each distinct query vector, and the shards' best are merged.

Largest inner product is turned into least distance by one more component, which levels the vectors' lengths; the scores
are inner products of the original vectors in double precision. A shard is read once, and the queries stream past it.

Defined results: vectors that are null, all zero, or hold a null or non-finite component take no part; vectors of another number
of components are no candidates of a query; repeated rows count once, and of several vectors of one vec_id the least is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotloom.llm.common import joined, written

TOP = 20
SHARD_ROWS = 4096
DEGREE = 28
BUILD_BEAM = 64
BEAM = 96
ALPHA = 1.2
#: Nodes of a shard among which a search picks the nearest to start from: in clustered data one start alone cannot reach all clusters.
STARTS = 256
#: Nodes that a beam expands at once, and nodes searched at once.
WIDE = 4
BATCH = 256


def beam_search(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``q`` the nearest nodes found, as places in ``x`` (-1 beyond the last), and their squared distances. ``graph`` is padded with -1."""
    n, b = len(x), len(q)
    ids, far = np.full((b, beam), -1), np.full((b, beam), np.inf, np.float32)
    done, seen, rows = np.zeros((b, beam), bool), np.zeros((b, n + 1), bool), np.arange(b)[:, None]
    first = np.maximum((q**2).sum(1)[:, None] + (x[starts] ** 2).sum(1) - 2 * q @ x[starts].T, 0)
    best = np.argsort(first, axis=1, kind="stable")[:, : min(WIDE, len(starts))]
    ids[:, : best.shape[1]], far[:, : best.shape[1]] = starts[best], np.take_along_axis(first, best, 1)
    seen[rows, starts[best]] = seen[:, n:] = True
    while True:
        open_ = np.where(done | (ids < 0), np.inf, far)
        at = np.argpartition(open_, WIDE, axis=1)[:, :WIDE] if beam > WIDE else np.argsort(open_, axis=1)
        live = np.isfinite(np.take_along_axis(open_, at, 1))
        if not live.any():
            return ids, far
        done[rows, at] = done[rows, at] | live
        near = np.where(live[:, :, None], graph[np.where(live, ids[rows, at], 0)], -1).reshape(b, -1)
        near = np.sort(np.where(near < 0, n, near), axis=1)
        fresh = ~seen[rows, near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]  # a node that two lead to counts once
        seen[rows, near] = True
        d = np.where(fresh, ((x[np.minimum(near, n - 1)] - q[:, None, :]) ** 2).sum(2), np.inf).astype(np.float32)
        ids, far = np.concatenate([ids, near], 1), np.concatenate([far, d], 1)
        done = np.concatenate([done, np.zeros(near.shape, bool)], 1)
        best = np.argsort(far, axis=1, kind="stable")[:, :beam]
        ids, far, done = (np.take_along_axis(v, best, 1) for v in (ids, far, done))
        ids = np.where(np.isfinite(far), ids, -1)


def prune(x: np.ndarray, points: np.ndarray, pool: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """For each point the kept ones of its pool of candidates (places in ``x``, -1 for none), nearest first, padded with -1."""
    pool = np.sort(np.where(pool == points[:, None], -1, pool), axis=1)
    pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
    v, p = x[np.maximum(pool, 0)], x[points]
    near = np.where(pool < 0, np.inf, ((v - p[:, None, :]) ** 2).sum(2))
    order = np.argsort(near, axis=1, kind="stable")
    pool, near, v = np.take_along_axis(pool, order, 1), np.take_along_axis(near, order, 1), np.take_along_axis(v, order[:, :, None], 1)
    norm = (v**2).sum(2)
    between = norm[:, :, None] + norm[:, None, :] - 2 * v @ v.transpose(0, 2, 1)
    alive, rows, out = np.isfinite(near), np.arange(len(points)), np.full((len(points), degree), -1)
    for k in range(degree):
        has = alive.any(1)
        if not has.any():
            break
        first = alive.argmax(1)
        out[has, k] = pool[rows, first][has]
        alive &= alpha**2 * between[rows, first] > near
        alive[rows, first] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM) -> tuple[np.ndarray, np.ndarray]:
    """The graph of the rows of ``x`` and the nodes where searches start."""
    n = len(x)
    rng = np.random.default_rng(n)
    starts = np.sort(rng.choice(n, min(n, STARTS), replace=False))
    graph = np.full((n, degree), -1)
    if n > 1:
        graph[:, : degree // 2] = rng.integers(0, n, (n, degree // 2))
        graph[graph == np.arange(n)[:, None]] = -1
    for alpha in (1.0, ALPHA):
        for batch in np.split(order := rng.permutation(n), range(BATCH, n, BATCH)):
            found, _ = beam_search(x, graph, starts, x[batch], beam)
            graph[batch] = prune(x, batch, np.concatenate([found, graph[batch]], 1), alpha, degree)
            # edges back: each target's pool is its own neighbours and those that now lead to it
            to, by = graph[batch].ravel(), np.repeat(batch, degree)
            to, by = to[(ok := to >= 0)], by[ok]
            by, to = by[(o := np.argsort(to, kind="stable"))], to[o]
            targets, first, count = np.unique(to, return_index=True, return_counts=True)
            for a in range(0, len(targets), BATCH):
                t, f, c = targets[a : a + BATCH], first[a : a + BATCH], count[a : a + BATCH]
                pool = np.full((len(t), degree + int(c.max())), -1)
                pool[:, :degree] = graph[t]
                spot = np.repeat(np.arange(len(t)), c), degree + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                pool[spot] = by[f[0] : f[0] + c.sum()]
                graph[t] = prune(x, t, pool, alpha, degree)
    return graph, starts


def usable(table: DataFrame, id_: str, vector: str) -> DataFrame:
    """``(vec_id, v)``: the vectors that take part, one of each id."""
    fit = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(vector, lambda c: c != 0)
    return table.where(F.col(id_).isNotNull() & fit).groupBy(F.col(id_).alias("vec_id")).agg(F.min(vector).alias("v"))


def nodes_of(rows: DataFrame, top: int) -> DataFrame:
    """``(node, v, dim, ids)``: the different vectors, each with its ``top`` + 1 smallest ids, found in two steps so that a common vector is no task of its own."""
    ranked = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))
    some = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("r", ranked(["v", "salt"])).where(F.col("r") <= top + 1)
    some = some.withColumn("r", ranked(["v"])).where(F.col("r") <= top + 1)
    return some.groupBy("v").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("v"))


def _levelled(x: np.ndarray, longest: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(longest**2 - (x.astype(np.float64) ** 2).sum(1), 0))[:, None]], axis=1).astype(np.float32)


def precision(table: DataFrame) -> type:
    """The numpy type that holds the components of ``v`` as they are."""
    return np.float32 if dict(table.dtypes)["v"] == "array<float>" else np.float64


def index(nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each shard: ``(dim, shard, n)`` and, as bytes, ``(starts, vectors, graph, ids, counts)."""
    sizes = {r["dim"]: (r["n"], r["longest"]) for r in nodes.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c))).alias("longest")).collect()}
    kind = precision(nodes)
    shards = F.coalesce(*[F.when(F.col("dim") == d, F.lit(-(-n // shard_rows))) for d, (n, _) in sizes.items()], F.lit(1))

    def run(table: pa.Table) -> pa.Table:
        x = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(table.num_rows, -1)
        order = np.argsort(table["node"].to_numpy())
        x, ids = x[order], [table["ids"][int(i)].as_py() for i in order]
        graph, starts = build(_levelled(x, sizes[x.shape[1]][1]))
        return pa.table({
            "dim": pa.array([x.shape[1]], pa.int32()), "shard": table["shard"].slice(0, 1).cast(pa.int64()), "starts": pa.array([starts.astype(np.int64).tobytes()]), "n": pa.array([len(x)]), "vectors": pa.array([x.tobytes()]),
            "graph": pa.array([graph.astype(np.int32).tobytes()]), "ids": pa.array([np.array([i for own in ids for i in own], np.int64).tobytes()]), "counts": pa.array([np.array([len(o) for o in ids], np.int32).tobytes()]),
        })

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("node"), shards))
    return dealt.groupBy("dim", "shard").applyInArrow(run, "dim int, shard bigint, starts binary, n bigint, vectors binary, graph binary, ids binary, counts binary")


def search(shards: DataFrame, queries: DataFrame, top: int = TOP, beam: int = BEAM) -> DataFrame:
    """``(qid, best)`` for ``queries (qid, v, dim)``: the ``top`` + 1 best ids over all shards, as structs (away, vec_id) where away is minus the score.

    Rows are dealt by shard; the shard's own row comes first in its partition, and queries follow it in batches.
    """
    kind = precision(queries)
    of = shards.groupBy("dim").agg(F.collect_set("shard").alias("all"))  # numbers alone, one for thousands of vectors
    own = shards.select("dim", "shard", F.lit(None).cast("bigint").alias("qid"), F.lit(None).cast(dict(queries.dtypes)["v"]).alias("v"), "starts", "n", "vectors", "graph", "ids", "counts")
    asked = queries.join(F.broadcast(of), "dim").select("dim", F.explode("all").alias("shard"), "qid", "v")
    rows = own.unionByName(asked, allowMissingColumns=True).repartition("dim", "shard").sortWithinPartitions("dim", "shard", F.col("qid").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None

        def loaded(row: dict) -> tuple:
            x = np.frombuffer(row["vectors"], kind).reshape(row["n"], row["dim"])
            counts = np.frombuffer(row["counts"], np.int32)
            longest = float(np.sqrt((x.astype(np.float64) ** 2).sum(1).max()))
            return row["shard"], x, _levelled(x, longest), np.frombuffer(row["graph"], np.int32).reshape(row["n"], -1), np.frombuffer(row["starts"], np.int64), np.frombuffer(row["ids"], np.int64), counts, np.cumsum(counts)

        def answered(batch: pa.RecordBatch) -> pa.RecordBatch:
            number, x, level, graph, starts, ids, counts, ends = shard
            q = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(batch.num_rows, -1)
            found, _ = beam_search(level, graph, starts, np.concatenate([q, np.zeros((len(q), 1), kind)], 1).astype(np.float32), beam)
            score = (x[np.maximum(found, 0)].astype(np.float64) * q[:, None, :].astype(np.float64)).sum(2)
            out = []
            for own, s in zip(found, score):
                own, s = own[own >= 0], s[own >= 0]
                keep = np.argsort(-s, kind="stable")
                cut = keep[s[keep] >= s[keep[min(top, len(keep) - 1)]]]  # with ties of the last
                flat = [(-s[i], v) for i in cut for v in ids[ends[own[i]] - counts[own[i]] : ends[own[i]]].tolist()]
                out.append([{"away": w, "vec_id": v} for w, v in sorted(flat)[: top + 1]])
            return pa.RecordBatch.from_arrays([batch.column("qid"), pa.array([number] * len(out), pa.int64()), pa.array(out, pa.list_(pa.struct([("away", pa.float64()), ("vec_id", pa.int64())])))], names=["qid", "shard", "best"])

        for batch in batches:
            heads = np.flatnonzero(np.asarray(batch.column("qid").is_null()))
            for a, b in zip([0, *heads], [*heads, batch.num_rows]):
                if a in heads:
                    shard = loaded(batch.slice(a, 1).to_pylist()[0])
                    a += 1
                for at in range(a, b, BATCH):
                    yield answered(batch.slice(at, min(BATCH, b - at)))

    found = rows.mapInArrow(run, "qid bigint, shard bigint, best array<struct<away:double,vec_id:bigint>>")
    merged = lambda by: F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, top + 1).alias("best")
    some = found.groupBy("qid", F.pmod("shard", F.lit(64)).alias("part")).agg(merged("qid"))
    return some.groupBy("qid").agg(merged("qid"))


def neighbours(table: DataFrame, is_query, top: int = TOP, id_: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows of ``table`` that ``is_query`` (a condition on vec_id) admits."""
    rows = written(usable(table, id_, vector), "vectors")
    shards = written(index(written(nodes_of(rows, top), "nodes"), shard_rows), "shards")
    asked = written(rows.where(is_query), "asked")
    distinct = written(asked.groupBy("v").agg(F.min("vec_id").alias("qid"), F.count("*").alias("n")).withColumn("dim", F.size("v")), "queries")
    best = written(search(shards, distinct.select("qid", "v", "dim"), top), "best")
    named = written(joined(asked, distinct.select("v", "qid", "n"), ["v"], "n", total := asked.count()).select("vec_id", "qid"), "named")
    each = joined(named, best.join(distinct.select("qid", "n"), "qid"), ["qid"], "n", total)
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, top)
    out = each.select(F.col("vec_id").alias("query_id"), "best").select("query_id", F.posexplode(others).alias("at", "b"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.away")).alias("score"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
