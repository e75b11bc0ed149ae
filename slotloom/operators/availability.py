"""When resources are free.

An instant is free if it is open, not blocked, and fewer allocations than the capacity are active. Open times are those of the nearest
resource, itself first and then upwards, that has an open rule overlapping the window; blocked times are those of all of them.
Allocations are the resource's own bookings and live holds, each prolonged by the resource's buffer. Capacity 0 counts as 1.

A circle, too many levels or a missing parent above a resource that is asked for raises ScheduleError, as no rule can be trusted there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotloom.functions.spans import is_live, overlaps, plus
from slotloom.functions.tables import kept, small
from slotloom.operators.hierarchy import checked_tree
from slotloom.operators.sweep import BUCKET, at_least, pieces_of, runs, segments, spans_of, swept, tasks_of
from slotloom.schema import Limits, Schedule, ScheduleError

STATE = ["open", "blocked", "active"]
#: A rule meets the resources below it in so many parts, so that a root with all resources below it is no task of its own.
PARTS = 32


def checked_window(start: int, end: int, limits: Limits, clamp: bool = True) -> tuple[int, int]:
    """The window, cut to the times there are; too wide a window is refused, before the cut where ``clamp`` is off."""
    if clamp:
        start, end = max(0, start), min(end, limits.last_ms)
    if limits.window_ms is not None and end - start > limits.window_ms:
        raise ScheduleError("LimitExceeded", "query window too wide")
    return start, end


def _inner(tree: DataFrame) -> DataFrame:
    return small(tree.where("depth > 0").select("ancestor_id").distinct().withColumn("inner", F.lit(True)))


def _dealt(rows: DataFrame, inner: DataFrame) -> DataFrame:
    """Adds ``part`` to ``rows (ancestor_id, ...)``: -1, by which a resource meets its own, and for ``inner`` resources, which have others below them, also all of ``PARTS``, in which these are dealt."""
    parts = F.when(F.col("inner"), F.sequence(F.lit(-1), F.lit(PARTS - 1))).otherwise(F.array(F.lit(-1)))
    return rows.join(inner, "ancestor_id", "left").withColumn("part", F.explode(parts)).drop("inner")


def sources_of(tree: DataFrame, rules: DataFrame, inner: DataFrame) -> DataFrame:
    """``(id, ancestor_id, part, blocks, takes_open)``: who above each resource has rules; it takes open ones from the nearest that has any in ``rules``, blocking ones from all.

    What the rules say of a resource is one row with two flags. The nearest is found among a resource's own ancestors.
    """
    flags = _dealt(rules.groupBy(F.col("resource_id").alias("ancestor_id")).agg(F.max(~F.col("blocking")).alias("opens"), F.max("blocking").alias("blocks")), inner)
    part = F.when(F.col("depth") == 0, F.lit(-1)).otherwise(F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int"))
    links = tree.withColumn("part", part).join(flags, ["ancestor_id", "part"])
    lists = links.groupBy("id").agg(F.collect_list(F.struct("depth", "ancestor_id", "part", "blocks")).alias("all"), F.min(F.when(F.col("opens"), F.col("depth"))).alias("nearest"))  # a row for each level at most
    each = lists.select("id", "nearest", F.explode("all").alias("a")).select("id", "a.ancestor_id", "a.part", "a.blocks", F.coalesce(F.col("a.depth") == F.col("nearest"), F.lit(False)).alias("takes_open"))
    return each


def inherited_rules(rules: DataFrame, tree: DataFrame, start: int, end: int, every: bool = False) -> DataFrame:
    """``(resource_id, start, end, blocking)``: what applies to each resource of ``tree`` in the window, clamped to it. ``every`` adds the open rules of farther ancestors, with ``blocking`` null."""
    rules = rules.where(overlaps("start", "end", start, end)).select(F.col("resource_id").alias("ancestor_id"), F.greatest("start", F.lit(start)).alias("start"), F.least("end", F.lit(end)).alias("end"), "blocking")
    inner = _inner(tree)
    links = sources_of(tree, rules.withColumnRenamed("ancestor_id", "resource_id"), inner)
    applies = F.col("blocking") | F.col("takes_open")
    links = links.drop("blocks") if every else links.where("takes_open or blocks").drop("blocks")
    rows = _dealt(rules, inner).join(links, ["ancestor_id", "part"])
    rows = rows.withColumn("blocking", F.when(applies, F.col("blocking"))) if every else rows.where(applies)
    return rows.select(F.col("id").alias("resource_id"), "start", "end", "blocking")


def allocated(s: Schedule) -> DataFrame:
    """``(resource_id, id, start, end, capacity)``: bookings and live holds with their buffers, and the capacity that they take from."""
    rows = s.bookings.select("id", "resource_id", "start", "end").unionByName(s.holds.where(is_live(s.now)).select("id", "resource_id", "start", "end"))
    of = s.resources.select(F.col("id").alias("resource_id"), "buffer_after", F.greatest("capacity", F.lit(1)).alias("capacity"))
    return rows.where("start < end").join(of, "resource_id").select("resource_id", "id", "start", plus("end", F.coalesce("buffer_after", F.lit(0))).alias("end"), "capacity")


def active_allocations(s: Schedule, start: int, end: int) -> DataFrame:
    """``(resource_id, start, end, capacity)``: allocations with their buffers, as far as they reach into the window."""
    rows = allocated(s).where((F.col("start") < end) & (F.col("end") > start))
    return rows.select("resource_id", F.greatest("start", F.lit(start)).alias("start"), F.least("end", F.lit(end)).alias("end"), "capacity")


def _state(rules: DataFrame, active: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spans of open and blocking rules and of allocations, for one sweep. Rules that do not apply (``blocking`` null) count nowhere; their starts and ends are instants all the same."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("bigint")
    counts = [flag(~F.col("blocking")).alias("open"), flag(F.col("blocking")).alias("blocked"), F.lit(0).cast("bigint").alias("active")]
    return spans_of(active, "active", STATE, keys, ["capacity"]).unionByName(rules.select(*keys, "start", "end", F.lit(None).cast("bigint").alias("capacity"), *counts))


def is_free(at) -> Column:
    """Where nothing is allocated no row knows the capacity, which is 1 at least."""
    return (at("open") > 0) & (at("blocked") == 0) & (at("active") < F.coalesce("capacity", F.lit(1)))


def state_of(s: Schedule, start: int, end: int, ids: Sequence[str] | None = None, limits: Limits = Limits(), bucket: int = BUCKET, every: bool = False) -> tuple[DataFrame, int]:
    """The running numbers of open and blocking rules and of allocations, and the capacity where it is known, of every resource (of ``ids``); with ``every`` also at the starts and ends of open rules that a nearer resource's replace. And the number of tasks that sweep them."""
    tree = checked_tree(s.resources, None if ids is None else list(ids), limits)
    if ids is not None:
        own = F.col("id").isin(list(ids))
        of = F.col("resource_id").isin(list(ids))
        s = Schedule(s.resources.where(own), s.rules, s.holds.where(of), s.bookings.where(of), s.now)
    spans = kept(_state(inherited_rules(s.rules, tree, start, end, every), active_allocations(s, start, end), ["resource_id"]), "state")
    tasks = tasks_of(spans, bucket)
    return swept(spans, STATE, ["resource_id"], ["capacity"], bucket, tasks), tasks


def availability(s: Schedule, start: int, end: int, min_duration: int | None = None, ids: Sequence[str] | None = None, limits: Limits = Limits(), bucket: int = BUCKET) -> DataFrame:
    """``(resource_id, start, end)``: the maximal free spans of every resource (of ``ids``, repeated ids once; unknown ones give none)."""
    if ids is not None and len(set(ids)) > limits.ids:
        raise ScheduleError("LimitExceeded", "too many ids")
    start, end = checked_window(start, end, limits)
    if start >= end:
        return s.resources.sparkSession.createDataFrame([], "resource_id string, start bigint, end bigint")
    rows, tasks = state_of(s, start, end, ids, limits, bucket)
    free = runs(rows, is_free, ["resource_id"], tasks, bucket)
    return free if min_duration is None else free.where(F.col("end") - F.col("start") >= min_duration)


def availability_of(s: Schedule, requests: DataFrame, limits: Limits = Limits(), bucket: int = BUCKET) -> DataFrame:
    """``(query_id, start, end)``: for each of ``requests (query_id, resource_id, start, end)`` the maximal free spans of its resource in a window of its own.

    The window decides from whom open times are taken, so that requests on one resource may see different ancestors. Ids of requests
    must differ; unknown resources and empty windows give nothing. Requests meet rules and allocations in time buckets.
    """
    from slotloom.operators.conflict import overlap_pairs

    tree = checked_tree(s.resources, None, limits)
    asked = kept(requests.where("start < end").select("query_id", "resource_id", F.greatest("start", F.lit(0)).alias("start"), F.least("end", F.lit(limits.last_ms)).alias("end")).where("start < end"), "asked")
    above = asked.join(tree.select(F.col("id").alias("resource_id"), "ancestor_id", "depth"), "resource_id")
    a = above.select(F.col("ancestor_id").alias("resource_id"), F.struct("query_id", "depth").alias("a_id"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = s.rules.select("resource_id", F.col("blocking").alias("b_id"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    cut = [F.greatest("a_start", "b_start").alias("start"), F.least("a_end", "b_end").alias("end")]
    met = kept(overlap_pairs(a, b, bucket).select("a_id.query_id", "a_id.depth", F.col("b_id").alias("blocking"), *cut), "met")
    nearest = met.where("not blocking").groupBy("query_id").agg(F.min("depth").alias("nearest"))
    rules = met.join(nearest, "query_id", "left").where("blocking or depth = nearest").select("query_id", "start", "end", "blocking")
    taken = allocated(s).select("resource_id", F.col("capacity").alias("b_id"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    own = asked.select("resource_id", F.col("query_id").alias("a_id"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    active = overlap_pairs(own, taken, bucket).select(F.col("a_id").alias("query_id"), *cut, F.col("b_id").alias("capacity"))
    spans = kept(_state(rules, active, ["query_id"]), "state")
    tasks = tasks_of(spans, bucket)
    return runs(swept(spans, STATE, ["query_id"], ["capacity"], bucket, tasks), is_free, ["query_id"], tasks, bucket)


def k_of_n(free: DataFrame, requests: DataFrame, min_duration: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """``(query_id, start, end)``: where at least ``k`` of a request's resources are free.

    ``requests (query_id, resource_id, k)`` names resources one by one; one named twice counts twice. k below 1, or above the number
    named, gives nothing. Spans are merged before ``min_duration`` is asked for.
    """
    named = requests.groupBy("query_id", "resource_id").agg(F.count("*").alias("times"), F.max("k").alias("k"))
    rows = kept(free.join(named, "resource_id").select("query_id", "k", "start", "end", "times"), "named")
    out = at_least(rows, F.col("k"), ["query_id"], ["k"], bucket, count="times")
    return out if min_duration is None else out.where(F.col("end") - F.col("start") >= min_duration)


def merged_availability(s: Schedule, ids: Sequence[str], k: int, start: int, end: int, min_duration: int | None = None, limits: Limits = Limits()) -> DataFrame:
    """``(start, end)``: where at least ``k`` of ``ids`` are free. The window is measured before it is cut."""
    empty = s.resources.sparkSession.createDataFrame([], "start bigint, end bigint")
    if start >= end:
        return empty
    checked_window(start, end, limits, clamp=False)
    if len(ids) > limits.ids:
        raise ScheduleError("LimitExceeded", "too many ids")
    if not 0 < k <= len(ids):
        return empty
    free = availability(s, start, end, ids=list(dict.fromkeys(ids)), limits=limits)
    requests = s.resources.sparkSession.createDataFrame([("q", i, k) for i in ids], "query_id string, resource_id string, k bigint")
    return k_of_n(free, requests, min_duration).select("start", "end")


def utilisation(s: Schedule, start: int, end: int, limits: Limits = Limits()) -> DataFrame:
    """``(resource_id, open_ms, busy_ms)``: open, unblocked time of each resource, and its time with an allocation in it."""
    rows = pieces_of(state_of(s, *checked_window(start, end, limits), limits=limits)[0], STATE, ["resource_id"]).where("open > 0 and blocked = 0")
    size = F.col("end") - F.col("start")
    return rows.groupBy("resource_id").agg(F.sum(size).alias("open_ms"), F.sum(F.when(F.col("active") > 0, size).otherwise(0)).alias("busy_ms"))


def remaining_capacity(s: Schedule, start: int, end: int, limits: Limits = Limits()) -> DataFrame:
    """``(resource_id, start, end, remaining)``: how much of the capacity is left, segment by segment of open, unblocked time. Segments end wherever a rule of the resource or of one above it starts or ends, and wherever an allocation does."""
    rows, tasks = state_of(s, *checked_window(start, end, limits), limits=limits, every=True)
    rows = segments(rows, STATE, ["resource_id"], tasks).where("open > 0 and blocked = 0")
    capacity = s.resources.select(F.col("id").alias("resource_id"), F.greatest("capacity", F.lit(1)).alias("capacity"))
    return rows.join(capacity, "resource_id").select("resource_id", "start", "end", F.greatest(F.col("capacity") - F.col("active"), F.lit(0)).alias("remaining"))


def free_units(free: DataFrame, resources: DataFrame, t: int) -> DataFrame:
    """``(parent_id, free, units)``: of each parent's children, how many are free at instant ``t``."""
    at = free.where((F.col("start") <= t) & (F.col("end") > t)).select(F.col("resource_id").alias("id"), F.lit(1).alias("is_free"))
    return resources.where("parent_id is not null").join(at, "id", "left").groupBy("parent_id").agg(F.coalesce(F.sum("is_free"), F.lit(0)).alias("free"), F.count("*").alias("units"))
