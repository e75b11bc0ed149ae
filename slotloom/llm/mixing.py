"""Operator 5: mixing sources to target weights by Poisson replication.

Every document of source s is repeated k times, k drawn from the Poisson distribution whose mean is the source's target
repetition rate: its share of the output divided by its share of the input, times output over input. The draw inverts the
distribution at a uniform number hashed from the seed and doc_id, so it is the same in every run, retry and engine. A rate
over ``STEP`` is drawn as the sum of several Poisson numbers of equal, smaller means, which keeps the terms exact.
The copies are then dealt over the whole output in ranges of a hash of (seed, doc_id, copy): that hash is uniform, so no source
or group of copies can fill a partition.

Defined results: a null source is a source of its own; a null or empty text counts as size 1 (a text of n characters as n + 1);
repeated doc_ids draw the same number; a source that ``weights`` lacks has weight 0; an empty table gives an empty table.
Columns of docs named replica or mix_key stay, and the new ones get underscores in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotloom.llm.common import documents, free_name, written

SEED = 20240501
ALPHA = 0.5
STEP = 16.0
#: Terms of the distribution; beyond them less than 2^-53 is left for means up to STEP.
TERMS = 80
#: Rates are broadcast up to this many sources (about 7 MB), and joined by a shuffle beyond.
BROADCAST_SOURCES = 10_000
BITS = 52


def hashed(*parts: Column | str) -> Column:
    """52 uniform bits from the parts' texts."""
    text = F.concat_ws(":", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("bigint")


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, total: float | None = None) -> DataFrame:
    """``(source, size, rate, cdf, parts)`` of each source. Without ``weights`` a source's weight is its size to the power ``alpha``; ``total`` is the output's size (the input's)."""
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + F.lit(1)).cast("double").alias("size"))
    weight = F.pow("size", F.lit(alpha)) if alpha != 0.5 else F.sqrt("size")
    if weights is not None:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map().cast("map<string,double>")
        weight = F.coalesce(F.try_element_at(table, F.coalesce("source", F.lit(""))).cast("double"), F.lit(0.0))
    sizes = written(sizes.withColumn("weight", weight), "sizes")
    sums = sizes.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    out = F.lit(float(total) if total is not None else sums["size"])
    rates = sizes.withColumn("rate", F.try_divide("weight", F.lit(sums["weight"])) * out / F.col("size"))
    rates = rates.withColumn("rate", F.coalesce("rate", F.lit(0.0))).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(STEP))).cast("int"))
    mean = F.col("rate") / F.col("parts")

    def step(acc: Column, j: Column) -> Column:
        p = acc["p"] * acc["mean"] / j
        upto = acc["upto"] + p
        return F.struct(p.alias("p"), upto.alias("upto"), acc["mean"].alias("mean"), F.concat(acc["cdf"], F.array(upto)).alias("cdf"))

    zero = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("upto"), mean.alias("mean"), F.array(F.exp(-mean)).alias("cdf"))
    return rates.select("source", "size", "rate", "parts", F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), zero, step, lambda a: a["cdf"]).alias("cdf"))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, total: float | None = None, seed: int = SEED) -> DataFrame:
    """The columns of ``docs``, and ``replica`` (from 1) and ``mix_key``, in the global order of ``mix_key``."""
    replica, key = free_name(docs, "replica"), free_name(docs, "mix_key")
    rates = written(source_rates(docs, weights, alpha, total), "rates")
    small = rates.count() <= BROADCAST_SOURCES
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: n for c, n in zip(docs.columns, names)}
    rates = rates.select(F.col("source").alias("r_source"), "parts", "cdf")
    rows = docs.toDF(*names).join(F.broadcast(rates) if small else rates, F.col(at["source"]).eqNullSafe(F.col("r_source")))
    doc = F.col(at["doc_id"])

    def draw(acc: Column, part: Column) -> Column:
        u = (hashed(F.lit(seed), doc, part).cast("double") + F.lit(0.5)) / F.lit(float(1 << BITS))
        return acc + F.size(F.filter("cdf", lambda c: c < u))

    count = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), draw)
    rows = rows.select(*names, count.alias("n")).where("n > 0").select(*names, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n").cast("bigint"))).alias("replica"))
    rows = rows.withColumn("mix_key", hashed(F.lit(seed), F.lit("order"), doc, "replica"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the hash is uniform, so its ranges are fixed and need no sample, which would be drawn from the whole job once more
    slot = F.floor(F.col("mix_key") * F.lit(parts) / F.lit(float(1 << BITS))).cast("int")
    dealt = rows.repartitionById(parts, slot) if hasattr(rows, "repartitionById") else rows.repartitionByRange(parts, "mix_key")
    return dealt.sortWithinPartitions("mix_key", at["doc_id"], "replica").toDF(*docs.columns, replica, key)


def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix(documents(spark, sf_dir))


ORACLE = f"""
WITH RECURSIVE sizes AS (
  SELECT source, CAST(sum(coalesce(length(text), 0) + 1) AS DOUBLE) AS size FROM documents GROUP BY source
), sums AS (
  SELECT sum(size) AS all_size, sum(sqrt(size)) AS all_weight FROM sizes
), rates AS (
  SELECT source, sqrt(size) / all_weight * all_size / size AS rate FROM sizes, sums
), means AS (
  SELECT source, greatest(1, CAST(ceil(rate / {STEP}) AS INT)) AS parts, rate / greatest(1, CAST(ceil(rate / {STEP}) AS INT)) AS mean FROM rates
), cdf AS (
  SELECT source, mean, parts, 0 AS j, exp(-mean) AS p, exp(-mean) AS upto FROM means
  UNION ALL
  SELECT source, mean, parts, j + 1, p * mean / (j + 1), upto + p * mean / (j + 1) FROM cdf WHERE j < {TERMS}
), draws AS (
  SELECT d.doc_id, d.source, (('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || i.part), 1, 13))::BIGINT + 0.5::DOUBLE) / {1 << BITS}::DOUBLE AS u
  FROM (SELECT DISTINCT doc_id, source FROM documents) d JOIN means m ON d.source IS NOT DISTINCT FROM m.source, unnest(range(1, m.parts + 1)) i(part)
), counts AS (
  SELECT w.doc_id, w.source, count(*) AS n FROM draws w JOIN cdf c ON w.source IS NOT DISTINCT FROM c.source AND c.upto < w.u GROUP BY w.doc_id, w.source
)
SELECT d.*, r.k AS replica, ('0x' || substr(md5('{SEED}:order:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || r.k), 1, 13))::BIGINT AS mix_key
FROM documents d JOIN counts n ON d.doc_id IS NOT DISTINCT FROM n.doc_id AND d.source IS NOT DISTINCT FROM n.source, unnest(range(1, n.n + 1)) r(k)
"""
