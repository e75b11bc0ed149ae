"""Changes of a schedule: from rows of requests to the rows' faults, and to the events of those that have none.

Requests have ``seq``; where one can stand in the way of another, each is judged after all of smaller ``seq``. That order is never
walked through row by row: what decides is found by levels of the tree, by the smallest ``seq`` of an id, or by the place where a
limit is reached. ``error`` is null for a request that takes effect, else the first fault in a fixed order. A column ``batch_id``
groups requests that came together: batches of more than ``Limits.batch`` rows are refused as a whole.

Bookings and holds that compete for capacity are judged by ``admission``; this module has everything else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotloom.functions.spans import buffer_error, span_error
from slotloom.functions.tables import kept
from slotloom.operators.conflict import uncovered_rules
from slotloom.operators.hierarchy import closure, depths
from slotloom.schema import Limits, Schedule
from slotloom.sources.events import event

_null = lambda: F.lit(None).cast("string")


def _batch_fault(requests: DataFrame, limits: Limits) -> DataFrame:
    """Adds ``crowded``, whether the row's batch is too large."""
    if "batch_id" not in requests.columns:
        return requests.withColumn("crowded", F.lit(False))
    large = requests.groupBy("batch_id").count().where(F.col("count") > limits.batch).select("batch_id", F.lit(True).alias("crowded"))
    return requests.join(large, "batch_id", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))


def _name_fault(limits: Limits) -> Column:
    return F.when(F.octet_length("name") > limits.name_bytes, "LimitExceeded: resource name too long")


def create_resources(s: Schedule, requests: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``(seq, id, error)`` for ``requests (seq, id, parent_id, name, capacity, buffer_after)``; ``seq`` must differ.

    Faults in order: too many resources, buffer, name, AlreadyExists, CycleDetected (its own parent), NotFound (the parent), too deep. A parent
    may be made by an earlier request. A round decides every request that no undecided earlier one can bear on, by its id or its
    parent's; rounds are as many as new resources hang below one another.
    """
    fault = F.when(F.col("crowded"), "LimitExceeded: batch too large")
    fault = F.coalesce(fault, buffer_error("buffer_after", limits), _name_fault(limits))
    rows = kept(_batch_fault(requests, limits).withColumn("fault", fault).select("seq", "id", "parent_id", "fault"), "create")
    done = rows.where("fault is not null").select("seq", "id", F.col("fault").alias("error"))
    known = kept(depths(closure(s.resources, limits)).select("id", "depth", F.lit(-1).cast("bigint").alias("since")), "known")
    of = s.resources.count()
    left = rows.where("fault is null").select("seq", "id", "parent_id")
    while True:
        first = left.groupBy("id").agg(F.min("seq").alias("first"))
        seen = left.join(first, "id").withColumnRenamed("first", "own_first").join(first.select(F.col("id").alias("parent_id"), F.col("first").alias("parent_first")), "parent_id", "left")
        ready = (F.col("own_first") == F.col("seq")) & (F.col("parent_first").isNull() | (F.col("parent_first") >= F.col("seq")))
        seen = seen.join(known.select("id", F.col("since").alias("id_since")), "id", "left").join(known.select(F.col("id").alias("parent_id"), F.col("since").alias("parent_since"), F.col("depth").alias("above")), "parent_id", "left")
        error = (
            F.when(F.col("id_since") < F.col("seq"), "AlreadyExists").when(F.col("parent_id") == F.col("id"), "CycleDetected")
            .when(F.col("parent_id").isNotNull() & ~F.coalesce(F.col("parent_since") < F.col("seq"), F.lit(False)), "NotFound").when(F.col("above") + 1 > limits.depth, "LimitExceeded: hierarchy too deep")
        )
        told = kept(seen.select("seq", "id", "parent_id", F.coalesce(F.col("above") + 1, F.lit(0)).alias("depth"), ready.alias("ready"), F.when(ready, error).alias("error")), "told")
        now = told.where("ready")
        if now.isEmpty():
            break
        done = done.unionByName(now.select("seq", "id", "error"))
        known = known.unionByName(now.where("error is null").select("id", "depth", F.col("seq").alias("since")))
        left = told.where("not ready").select("seq", "id", "parent_id")
    done = kept(done, "done")
    # where the number of resources reaches the limit, all that follow are refused, whatever else they are
    room = limits.resources - of
    reached = done.where("error is null").orderBy("seq").limit(room).agg(F.count("*").alias("n"), F.max("seq").alias("seq")).first() if room > 0 else {"n": 0, "seq": None}
    over = F.lit(False) if reached["n"] < room else F.lit(True) if reached["seq"] is None else F.col("seq") > reached["seq"]
    return done.select("seq", "id", F.when(over, "LimitExceeded: too many resources").otherwise(F.col("error")).alias("error"))


def update_resources(s: Schedule, requests: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``(seq, id, error)`` for ``requests (seq, id, set_name, name, set_capacity, capacity, set_buffer, buffer_after)``: only what is set is checked and changes. A lower capacity is not held against what is booked."""
    known = s.resources.select("id", F.lit(True).alias("known"))
    fault = F.coalesce(F.when(F.coalesce("set_buffer", F.lit(False)), buffer_error("buffer_after", limits)), F.when(F.coalesce("set_name", F.lit(False)), _name_fault(limits)), F.when(F.col("known").isNull(), "NotFound"))
    return requests.join(known, "id", "left").select("seq", "id", fault.alias("error"))


def delete_resources(s: Schedule, requests: DataFrame) -> DataFrame:
    """``(seq, id, error)`` for ``requests (seq, id)``: NotFound for what is not there or no more, HasChildren while a child is there.

    A resource goes with the first request after all of its children have gone. That is found level by level, from the leaves that are
    asked for upwards, over those resources alone whose children are all asked for.
    """
    asked = kept(requests.select("seq", "id"), "delete")
    tree = s.resources.select("id", "parent_id")
    inner = kept(tree.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children")), "inner")
    level = kept(asked.join(tree, "id").join(inner, "id", "left_anti").groupBy("id", "parent_id").agg(F.min("seq").alias("gone")), "gone")
    gone = level
    while not level.isEmpty():
        ready = gone.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n"), F.max("gone").alias("last")).join(inner, "id").where("n = children")
        ready = ready.join(gone.select("id"), "id", "left_anti")
        level = kept(asked.join(ready, "id").where("seq > last").groupBy("id").agg(F.min("seq").alias("gone")).join(tree, "id").select("id", "parent_id", "gone"), "gone")
        gone = gone.unionByName(level)
    rows = asked.join(tree.select("id", F.lit(True).alias("known")), "id", "left").join(gone.select("id", "gone"), "id", "left")
    error = F.when(F.col("known").isNull() | (F.col("gone") < F.col("seq")), "NotFound").when(F.col("gone").isNull() | (F.col("gone") > F.col("seq")), "HasChildren")
    return rows.select("seq", "id", error.alias("error"))


def over_cap(s: Schedule, judged: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``judged (seq, id, resource_id, ok, ...)`` with ``full``: whether the resource has ``Limits.intervals`` intervals, expired holds included, when the request's turn comes.

    Resources that stay below it with all that is asked for need no order; of the others, the request that reaches the cap is looked for.
    """
    have = s.intervals().groupBy("resource_id").agg(F.count("*").alias("have"))
    asked = judged.where("ok").groupBy("resource_id").agg(F.count("*").alias("more"))
    near = kept(judged.select("resource_id").distinct().join(have, "resource_id", "left").join(asked, "resource_id", "left").select("resource_id", F.coalesce("have", F.lit(0)).alias("have"), (F.coalesce("have", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("all")).where(F.col("all") >= limits.intervals), "near")
    rank = F.row_number().over(Window.partitionBy("resource_id").orderBy("seq", "id"))
    last = judged.where("ok").join(near, "resource_id").withColumn("nth", rank).where(F.col("nth") + F.col("have") <= limits.intervals).groupBy("resource_id").agg(F.max("seq").alias("last"), F.max("nth").alias("nth"))
    last = near.join(last, "resource_id", "left").where(F.coalesce("nth", F.lit(0)) + F.col("have") >= limits.intervals).select("resource_id", F.coalesce("last", F.lit(-1 << 62)).alias("last"), F.lit(True).alias("capped"))
    return judged.join(last, "resource_id", "left").withColumn("full", F.coalesce(F.col("capped") & (F.col("seq") > F.col("last")), F.lit(False))).drop("capped", "last")


def add_rules(s: Schedule, requests: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``(seq, id, error)`` for ``requests (seq, id, resource_id, start, end, blocking)``, with ids that differ.

    Faults in order: the span, NotFound, NotCoveredByParent (an open rule opens time that its resource's parent has closed), too many
    intervals. Coverage is measured in ``s`` as it is; the cap counts the rules that were added before.
    """
    known = s.resources.select(F.col("id").alias("resource_id"), F.lit(True).alias("known"))
    fault = F.coalesce(F.when(F.col("crowded"), "LimitExceeded: batch too large"), span_error("start", "end", limits), F.when(F.col("known").isNull(), "NotFound"))
    rows = kept(_batch_fault(requests, limits).join(known, "resource_id", "left").withColumn("fault", fault), "rules")
    bare = uncovered_rules(s, rows.where("fault is null"), limits).select("id").distinct().withColumn("bare", F.lit(True))
    rows = rows.join(bare, "id", "left").withColumn("fault", F.coalesce("fault", F.when(F.col("bare"), "NotCoveredByParent")))
    rows = over_cap(s, kept(rows.select("seq", "id", "resource_id", "fault", F.col("fault").isNull().alias("ok")), "judged"), limits)
    return rows.select("seq", "id", F.coalesce("fault", F.when(F.col("full"), "LimitExceeded: too many intervals on resource")).alias("error"))


def entities(s: Schedule, ids: DataFrame) -> DataFrame:
    """``(id, resource_id, is_rule, is_hold, is_booking)`` of the intervals that ``ids (id)`` name."""
    rows = s.intervals().join(ids.select("id").distinct(), "id", "left_semi")
    return rows.select("id", "resource_id", F.col("kind").isin("open", "blocked").alias("is_rule"), (F.col("kind") == "hold").alias("is_hold"), (F.col("kind") == "booking").alias("is_booking"))


def update_rules(s: Schedule, requests: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``(seq, id, resource_id, error)`` for ``requests (seq, id, start, end, blocking)``, each as if alone. Faults in order: the span, NotFound (no interval of that id), NotCoveredByParent, NotFound (no rule).

    ``seq`` differ, and so do ids of intervals; where they repeat on several resources, a column ``resource_id`` says whose is meant (null: any).
    """
    of = entities(s, requests).select("id", "resource_id", "is_rule")
    asked = requests.select("seq", "id", "start", "end", "blocking", *[F.col("resource_id").alias("named") for c in requests.columns if c == "resource_id"])
    same = (F.col("asked.id") == F.col("of.id")) & (F.coalesce(F.col("named") == F.col("of.resource_id"), F.col("named").isNull()) if "named" in asked.columns else F.lit(True))
    rows = kept(asked.alias("asked").join(of.alias("of"), same, "left").select("asked.*", "of.resource_id", "is_rule").withColumn("fault", F.coalesce(span_error("start", "end", limits), F.when(F.col("resource_id").isNull(), "NotFound"))), "updates")
    key = F.concat_ws("\0", F.col("seq").cast("string"), "resource_id")
    bare = uncovered_rules(s, rows.where("fault is null").select(key.alias("id"), "resource_id", "start", "end", "blocking"), limits)
    bare = bare.select(F.split("id", "\0")[0].cast("bigint").alias("seq"), "resource_id").distinct().withColumn("bare", F.lit(True))
    error = F.coalesce("fault", F.when(F.col("bare"), "NotCoveredByParent"), F.when(~F.col("is_rule"), "NotFound"))
    return rows.join(bare, ["seq", "resource_id"], "left").select("seq", "id", "resource_id", error.alias("error"))


def remove(s: Schedule, requests: DataFrame, kind: str) -> DataFrame:
    """``(seq, id, resource_id, error)`` for ``requests (seq, id)`` to remove rules, holds or bookings (``kind``: rule, hold, booking). NotFound for what is of another kind, is not there, or has gone by an earlier request."""
    of = entities(s, requests).select("id", "resource_id", F.col(f"is_{kind}").alias("fits"))
    first = requests.groupBy("id").agg(F.min("seq").alias("first"))
    rows = requests.select("seq", "id").join(first, "id").join(of, "id", "left")
    good = F.coalesce(F.col("fits"), F.lit(False)) & (F.col("seq") == F.col("first"))
    return rows.select("seq", "id", "resource_id", F.when(~good, "NotFound").alias("error"))


#: The event of each kind of request.
EVENT_OF = {"create_resources": "ResourceCreated", "update_resources": "ResourceUpdated", "delete_resources": "ResourceDeleted", "add_rules": "RuleAdded", "update_rules": "RuleUpdated", "remove_rule": "RuleRemoved", "remove_hold": "HoldReleased", "remove_booking": "BookingCancelled", "place_holds": "HoldPlaced", "confirm_bookings": "BookingConfirmed"}


def events_of(name: str, requests: DataFrame, judged: DataFrame, after: int) -> DataFrame:
    """The events of the requests (by ``seq``, which must differ) that ``judged`` finds no fault with, numbered ``after`` + ``seq``. ``name`` is a key of ``EVENT_OF``."""
    good = judged.where("error is null").select(*[c for c in ("seq", "resource_id") if c in judged.columns])
    return event(EVENT_OF[name], requests.drop(*[c for c in good.columns if c != "seq"]).join(good, "seq"), F.col("seq") + after)
