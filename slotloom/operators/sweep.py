"""Sweeps over interval endpoints, for all keys in one job.

A span is dealt to each time bucket of its key that it reaches into, cut to the bucket. So every bucket is swept by itself, from nothing to
nothing: endpoints are summed by instant (closes and opens at one instant cancel, their order never matters), and running sums are
taken within the bucket. One shuffle by (key, bucket) serves all of this, so a key that holds a large share of all rows is divided over as
many tasks as it has buckets. The pieces of a run that ends at one bucket's edge and goes on at the next one's are put
together by a second shuffle, in which the pieces that touch an edge (two in a bucket at most) meet by key, and all others stay apart.

How many tasks there are follows from the rows that spans are dealt to, which are counted first, so that a task's memory does not grow with the input: give
written or otherwise cheap tables. What remains whole is one bucket of one key.

Conditions must not hold where every count is 0. A span has one row for each bucket it reaches into: give a wider ``bucket`` where spans are long.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Milliseconds of a bucket.
BUCKET = 7 * 86_400_000
#: Buckets that one span may reach into.
MOST = 100_000
#: Spans, once for each bucket, that a task sweeps.
ROWS = 100_000


def spans_of(rows: DataFrame, name: str, names: Sequence[str], keys: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """Spans that count 1 in column ``name`` and 0 in the other ``names``."""
    return rows.select(*keys, "start", "end", *carried, *[F.lit(int(n == name)).cast("bigint").alias(n) for n in names])


def _reach(bucket: int) -> tuple[Column, Column]:
    """The first and the last bucket of a span."""
    return F.floor(F.col("start") / F.lit(bucket)).cast("bigint"), F.floor((F.col("end") - 1) / F.lit(bucket)).cast("bigint")


def tasks_of(spans: DataFrame, bucket: int = BUCKET) -> int:
    """In how many tasks to sweep ``spans``."""
    first, last = _reach(bucket)
    n = spans.where(F.col("start") < F.col("end")).agg(F.sum((last - first + 1).cast("double"))).first()[0]
    return max(1, math.ceil((n or 0) / ROWS))


def swept(spans: DataFrame, names: Sequence[str], keys: Sequence[str], carried: Sequence[str] = (), bucket: int = BUCKET, tasks: int | None = None) -> DataFrame:
    """One row for each key, bucket and instant with a start or end: ``a_`` and ``b_`` of each of ``names``, its sum from the instant on and before it, and whether the instant is a span's own (``real``) or only the bucket's edge.

    ``carried`` are columns that are one value in a key, or null where a row does not know it. Empty spans give nothing.
    ``tasks`` is ``tasks_of(spans, bucket)`` where that is known.
    """
    first, last = _reach(bucket)
    buckets = F.when(last - first < MOST, F.sequence(first, last)).otherwise(F.raise_error(F.lit("a span reaches into too many buckets")).cast("array<bigint>"))
    rows = spans.where(F.col("start") < F.col("end")).select(*keys, "start", "end", *carried, *names, F.explode(buckets).alias("bucket"))
    dealt = rows.repartition(tasks or tasks_of(spans, bucket), *keys, "bucket")  # spans, which are half as many rows as their ends
    edge = F.col("bucket") * bucket
    s, e = F.greatest("start", edge), F.least("end", edge + bucket)
    ends = F.array(F.struct(s.alias("t"), F.lit(1).alias("d"), (s == F.col("start")).alias("real")), F.struct(e.alias("t"), F.lit(-1).alias("d"), (e == F.col("end")).alias("real")))
    points = dealt.select(*keys, "bucket", *carried, *names, F.explode(ends).alias("p")).select(*keys, "bucket", "p.t", "p.real", *carried, *[(F.col(n) * F.col("p.d")).alias(n) for n in names])
    sums = points.groupBy(*keys, "bucket", "t").agg(*[F.sum(n).alias(n) for n in names], F.max("real").alias("real"), *[F.max(c).alias(c) for c in carried])
    here = Window.partitionBy(*keys, "bucket")
    upto = here.orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = sums.select(*keys, "bucket", "t", "real", *names, *[F.sum(n).over(upto).alias(f"a_{n}") for n in names], *[F.max(c).over(here).alias(c) for c in carried])
    return out.select(*keys, "bucket", "t", "real", *[c for n in names for c in ((F.col(f"a_{n}") - F.col(n)).alias(f"b_{n}"), F.col(f"a_{n}"))], *carried)


def _joined(pieces: DataFrame, keys: Sequence[str], bucket: int, tasks: int, parts: Column | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """Pieces ``(keys, bucket, start, end)`` that touch at a bucket's edge, made one; ``parts`` (of a piece and ``lag_`` columns of the one before it) keeps some apart."""
    edge = (F.col("start") == F.col("bucket") * bucket) | (F.col("end") == (F.col("bucket") + 1) * bucket)
    rows = pieces.withColumn("lane", F.when(~edge, F.col("bucket"))).repartition(tasks, *keys, "lane")
    line = Window.partitionBy(*keys, "lane").orderBy("start")
    apart = F.coalesce(F.lag("end").over(line) != F.col("start"), F.lit(True))
    if parts is not None:
        rows = rows.withColumns({f"lag_{c}": F.lag(c).over(line) for c in extra})
        apart = apart | F.coalesce(parts, F.lit(False))
    rows = rows.withColumn("apart", apart).withColumn("run", F.sum(F.col("apart").cast("int")).over(line))
    return rows.groupBy(*keys, "lane", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), *[F.first(c).alias(c) for c in extra if c not in ("opens", "closes")]).drop("lane", "run")


def runs(rows: DataFrame, condition: Callable[[Callable[[str], Column]], Column], keys: Sequence[str], tasks: int, bucket: int = BUCKET) -> DataFrame:
    """The maximal spans ``(keys, start, end)`` where ``condition`` holds; it gets a function from a name to its running sum."""
    before, after = condition(lambda n: F.col(f"b_{n}")), condition(lambda n: F.col(f"a_{n}"))
    changes = rows.select(*keys, "bucket", F.col("t").alias("start"), before.alias("before"), after.alias("after")).where("before != after")
    pieces = changes.withColumn("end", F.lead("start").over(Window.partitionBy(*keys, "bucket").orderBy("start"))).where("after")
    return _joined(pieces.select(*keys, "bucket", "start", "end"), keys, bucket, tasks).select(*keys, "start", "end")


def pieces_of(rows: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """All spans between neighbouring instants with the running sums that hold in them, cut at the buckets' edges; ``opens`` and ``closes`` tell where a span's own instant bounds them."""
    line = Window.partitionBy(*keys, "bucket").orderBy("t")
    rows = rows.select(*keys, "bucket", F.col("t").alias("start"), F.lead("t").over(line).alias("end"), F.col("real").alias("opens"), F.lead("real").over(line).alias("closes"), *[F.col(f"a_{n}").alias(n) for n in names])
    return rows.where("end is not null")


def segments(rows: DataFrame, names: Sequence[str], keys: Sequence[str], tasks: int, bucket: int = BUCKET) -> DataFrame:
    """All spans between neighbouring instants with the running sums that hold in them."""
    pieces = pieces_of(rows, names, keys)
    return _joined(pieces, keys, bucket, tasks, F.col("opens") | F.col("lag_closes"), ["opens", "closes", *names]).select(*keys, "start", "end", *names)


def merge_overlapping(spans: DataFrame, keys: Sequence[str] = ("resource_id",), bucket: int = BUCKET) -> DataFrame:
    """Spans that overlap or touch, made one."""
    tasks = tasks_of(spans, bucket)
    return runs(swept(spans_of(spans, "n", ["n"], keys), ["n"], keys, bucket=bucket, tasks=tasks), lambda at: at("n") > 0, keys, tasks, bucket)


def subtract_intervals(base: DataFrame, remove: DataFrame, keys: Sequence[str] = ("resource_id",), bucket: int = BUCKET) -> DataFrame:
    """What of ``base`` no span of ``remove`` covers."""
    names = ["base", "cut"]
    both = spans_of(base, "base", names, keys).unionByName(spans_of(remove, "cut", names, keys))
    tasks = tasks_of(both, bucket)
    return runs(swept(both, names, keys, bucket=bucket, tasks=tasks), lambda at: (at("base") > 0) & (at("cut") == 0), keys, tasks, bucket)


def at_least(spans: DataFrame, k: Column | int, keys: Sequence[str], carried: Sequence[str] = (), bucket: int = BUCKET, count: str | None = None) -> DataFrame:
    """Where ``k`` (a number, or an expression of ``carried``) or more spans are open at once; nowhere for k below 1. ``count`` names a column of how often a span counts."""
    k = k if isinstance(k, Column) else F.lit(k)
    rows = spans.select(*keys, "start", "end", *carried, (F.col(count) if count else F.lit(1)).cast("bigint").alias("n"))
    tasks = tasks_of(spans, bucket)
    rows = swept(rows, ["n"], keys, carried, bucket, tasks).withColumn("k", k)
    return runs(rows, lambda at: (at("n") >= F.col("k")) & (at("n") > 0) & (F.col("k") > 0), keys, tasks, bucket)


def saturated_spans(spans: DataFrame, keys: Sequence[str] = ("resource_id",), bucket: int = BUCKET) -> DataFrame:
    """Where as many spans are open as their ``capacity`` column says; nowhere for capacity 0."""
    return at_least(spans, F.col("capacity"), keys, ["capacity"], bucket)


def peaks(spans: DataFrame, keys: Sequence[str], bucket: int = BUCKET) -> DataFrame:
    """``(keys, peak)``: the largest number of spans that are open at once."""
    return swept(spans_of(spans, "n", ["n"], keys), ["n"], keys, bucket=bucket).groupBy(*keys).agg(F.max("a_n").alias("peak"))


def running(points: DataFrame, name: str, keys: Sequence[str], bucket: int = BUCKET) -> DataFrame:
    """Prefix sums of numbers ``name`` at instants ``t``: ``b_`` before each instant and ``a_`` with it, by buckets and the totals of the buckets before."""
    sums = points.withColumn("bucket", F.floor(F.col("t") / F.lit(bucket))).groupBy(*keys, "bucket", "t").agg(F.sum(name).alias(name))
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = sums.groupBy(*keys, "bucket").agg(F.sum(name).alias("total")).select(*keys, "bucket", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    inner = Window.partitionBy(*keys, "bucket").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = sums.withColumn("upto", F.sum(name).over(inner)).join(totals, [*keys, "bucket"])
    return rows.select(*keys, "t", (F.col("offset") + F.col("upto") - F.col(name)).alias(f"b_{name}"), (F.col("offset") + F.col("upto")).alias(f"a_{name}"))
