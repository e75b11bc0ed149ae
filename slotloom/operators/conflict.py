"""Whether requested spans would collide with what is allocated, for many independent requests at once.

A request on a resource is refused if, somewhere in its footprint ``[start, end + buffer)``, as many allocations as the capacity are
active (each with its buffer). Open hours and rules play no part. Requests and allocations meet in time buckets of their resource, so
that a resource with a large share of all rows is divided over many tasks, and no pair is made of spans that lie in different buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.functions.spans import buffer_error, overlaps, plus, span_error
from slotloom.functions.tables import kept
from slotloom.operators.availability import allocated, availability_of
from slotloom.operators.sweep import peaks, subtract_intervals
from slotloom.schema import Limits, Schedule

BUCKET = 86_400_000
FEW, COARSE = 32, 256
#: The last instant that buckets tell apart, some way beyond the last valid time.
LAST = 1 << 45


def overlap_pairs(a: DataFrame, b: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """All pairs of spans of ``a (resource_id, a_id, a_start, a_end)`` and ``b (resource_id, b_id, b_start, b_end)`` that share an instant, each once: in the bucket where the later of both starts.

    A span of more than ``FEW`` buckets is dealt to coarse ones, ``COARSE`` times as wide, and meets short spans there. What lies
    before 0 or after ``LAST`` is dealt to the outermost buckets, so that a saturated end makes a thousand rows at most.
    """

    def at(t, size: int):
        return F.floor(F.least(F.greatest(t, F.lit(0)), F.lit(LAST)) / F.lit(size)).cast("bigint")

    def dealt(rows: DataFrame, p: str, other: str) -> DataFrame:
        s, e = F.col(f"{p}_start"), F.col(f"{p}_end") - 1
        wide = bucket * COARSE
        cells = lambda grain, size: F.transform(F.sequence(at(s, size), at(e, size)), lambda x: F.struct(F.lit(grain).alias("grain"), x.alias("bucket")))
        # grain 0: short with short; long: b is long; other: only a is long
        long, fine = at(e, bucket) - at(s, bucket) >= FEW, cells("short", bucket)
        both = F.concat(cells("b long", wide), cells("a long", wide)) if p == "a" else cells("b long", wide)
        every = F.when(long, both).otherwise(F.concat(fine, cells(f"{other} long", wide)))
        return rows.where(f"{p}_start < {p}_end").withColumn("cell", F.explode(every))

    pairs = dealt(a, "a", "b").join(dealt(b, "b", "a"), ["resource_id", "cell"])
    size = F.when(F.col("cell.grain") == "short", F.lit(bucket)).otherwise(F.lit(bucket * COARSE))
    first = F.floor(F.least(F.greatest("a_start", "b_start", F.lit(0)), F.lit(LAST)) / size).cast("bigint")
    return pairs.where(overlaps("a_start", "a_end", "b_start", "b_end") & (first == F.col("cell.bucket"))).drop("cell")


def allocations(s: Schedule) -> DataFrame:
    """``(resource_id, b_id, b_start, b_end)``: bookings and live holds, with buffers."""
    return allocated(s).select("resource_id", F.col("id").alias("b_id"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))


def what_if(s: Schedule, requests: DataFrame, limits: Limits = Limits(), bucket: int = BUCKET) -> DataFrame:
    """``(id, resource_id, peak, error)`` for each of ``requests (id, resource_id, start, end)``, as if it were alone.

    ``peak`` is the largest number of allocations at one time in its footprint. ``error`` is null if the request would be admitted, else
    the first of: a fault of the span, NotFound, ``Conflict: <id>`` (capacity up to 1: the earliest that overlaps, ties to the smaller
    id), ``CapacityExceeded: <capacity>``. Ids of requests must differ. An allocation named in a column ``ignore_id`` is not in its request's way.
    """
    of = s.resources.select(F.col("id").alias("resource_id"), "capacity", F.coalesce("buffer_after", F.lit(0)).alias("buffer"), F.lit(True).alias("known"))
    ignored = F.col("ignore_id") if "ignore_id" in requests.columns else F.lit(None).cast("string")
    rows = requests.select("id", "resource_id", "start", "end", ignored.alias("ignore_id")).join(of, "resource_id", "left").withColumn("fault", F.coalesce(span_error("start", "end", limits), F.when(F.col("known").isNull(), "NotFound")))
    foot = rows.where("fault is null").select("resource_id", F.col("id").alias("a_id"), "ignore_id", F.col("start").alias("a_start"), plus("end", "buffer").alias("a_end"))
    pairs = overlap_pairs(foot, allocations(s), bucket).where("ignore_id is null or ignore_id != b_id")
    pairs = kept(pairs.select(F.col("a_id").alias("id"), F.greatest("a_start", "b_start").alias("start"), F.least("a_end", "b_end").alias("end"), "b_start", "b_id"), "pairs")
    first = pairs.groupBy("id").agg(F.min(F.struct("b_start", "b_id")).alias("first"))
    most = peaks(pairs.withColumn("end", F.greatest(F.least("end", F.lit(LAST)), F.col("start") + 1)), ["id"], bucket * COARSE)  # the most is reached at a start
    out = rows.join(first, "id", "left").join(most, "id", "left").withColumn("peak", F.coalesce("peak", F.lit(0)))
    full = F.col("peak") >= F.greatest("capacity", F.lit(1))
    error = F.when(F.col("fault").isNotNull(), F.col("fault")).when(full & (F.col("capacity") <= 1), F.concat(F.lit("Conflict: "), F.col("first.b_id"))).when(full, F.concat(F.lit("CapacityExceeded: "), F.col("capacity")))
    return out.select("id", "resource_id", "peak", error.alias("error"))


def uncovered_rules(s: Schedule, rules: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The parts ``(id, resource_id, start, end)`` of open ``rules (id, resource_id, start, end, blocking)`` on resources with a parent that the parent's own free time does not cover.

    Each rule is measured against the parent's free time in the rule's own span: which ancestor the parent takes its open times from
    is decided there. Ids of rules must differ.
    """
    parents = s.resources.where("parent_id is not null").select(F.col("id").alias("resource_id"), "parent_id")
    asked = kept(rules.where("not blocking and start < end").select("id", "resource_id", "start", "end").join(parents, "resource_id"), "asked")
    free = kept(availability_of(s, asked.select(F.col("id").alias("query_id"), F.col("parent_id").alias("resource_id"), "start", "end"), limits).withColumnRenamed("query_id", "id"), "free")
    return subtract_intervals(asked.select("id", "start", "end"), free, ["id"]).join(asked.select("id", "resource_id"), "id").select("id", "resource_id", "start", "end")


def validated(requests: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds ``error``: what is wrong with a request's span, its expiry, its label or its buffer, where it has such columns."""
    have = set(requests.columns)
    checks = [span_error("start", "end", limits)] if {"start", "end"} <= have else []
    if "expires_at" in have:
        checks.append(F.when(~F.col("expires_at").between(0, limits.last_ms), "LimitExceeded: timestamp out of range"))
    if "buffer_after" in have:
        checks.append(buffer_error("buffer_after", limits))
    for name, most in (("name", limits.name_bytes), ("label", limits.label_bytes)):
        if name in have:
            checks.append(F.when(F.octet_length(name) > most, f"LimitExceeded: {name} too long"))
    return requests.withColumn("error", F.coalesce(*checks, F.lit(None).cast("string")))
