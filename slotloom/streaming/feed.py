"""The event log as a stream: change feed, hold expiry, admission.

Batches and streams share the same transformations; sinks are the caller's. Times are event times: a row's ``ts`` column (a timestamp, when
the event was logged) moves the watermark, and with it the clock by which holds expire.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from slotloom.operators.admission import admit
from slotloom.schema import Limits, ScheduleError
from slotloom.sources.events import STORED, append_log, bubbled, compact, event, fold, read_log, valid_prefix


def event_stream(spark: SparkSession, path: str, schema: str = STORED) -> DataFrame:
    """New files of events in the batches of the log at ``path``, or in ``path`` itself. Snapshots, which repeat what was told, are left out."""
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    return rows.where(~F.contains(F.input_file_name(), F.lit("/snapshot-")))


def change_feed(events: DataFrame, tree: DataFrame, ids: Sequence[str] | None = None, limits: Limits = Limits()) -> DataFrame:
    """``(seq, channel, payload)`` of every event, for its resource and all above it; with ``ids`` only their channels. Nothing is dropped for slow readers.

    An id that no resource of ``tree`` has raises ScheduleError, and so do more ids than a reader may follow.
    """
    feed = bubbled(events, tree)
    if ids is None:
        return feed
    if len(set(ids)) > limits.followed:
        raise ScheduleError("LimitExceeded", "too many subscriptions")
    known = {r["id"] for r in tree.where(F.col("id").isin(list(ids))).select("id").distinct().collect()}  # of at most so many ids
    if missing := sorted(set(ids) - known):
        raise ScheduleError("NotFound", missing[0])
    return feed.where(F.col("channel").isin([f"resource_{i}" for i in ids]))


def expired_holds(events: DataFrame, now: int) -> DataFrame:
    """``(id, resource_id, expires_at)`` of the holds that events up to ``now`` have left and whose time is over: what ``expiring_holds`` tells, from a whole log at once."""
    return fold(events, now).holds.where(F.col("expires_at") <= now).select("id", "resource_id", "expires_at")


def expiring_holds(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """``(id, resource_id, expires_at)`` for each hold once the watermark passes its expiry, unless it was released or its resource deleted before.

    ``events`` needs ``ts``. State is kept by resource, since a deletion ends all of its holds: two numbers for each hold that is alive, of
    which a resource has ``Limits.intervals`` at most.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, times = (list(x) for x in state.get) if state.exists else ([], [])
        alive = dict(zip(ids, times))
        if not state.hasTimedOut:
            for r in pd.concat(list(frames)).sort_values("seq").itertuples():
                if r.type == "HoldPlaced":
                    alive[r.id] = int(r.expires_at)
                elif r.type == "HoldReleased":
                    alive.pop(r.id, None)
                else:
                    alive.clear()
        over = sorted((t, i) for i, t in alive.items() if t <= state.getCurrentWatermarkMs())
        for _, i in over:
            del alive[i]
        if alive:
            state.update((list(alive), list(alive.values())))
            state.setTimeoutTimestamp(min(alive.values()))
        elif state.exists:
            state.remove()
        if over:
            yield pd.DataFrame({"id": [i for _, i in over], "resource_id": key[0], "expires_at": [t for t, _ in over]})

    # every event moves the clock, so the filter must stay above the watermark: it is one condition on ts, which is not pushed below
    wanted = F.when(F.col("type").isin("HoldPlaced", "HoldReleased", "ResourceDeleted", "ResourceCreated"), F.col("ts")).isNotNull()
    rows = events.withWatermark("ts", delay).where(wanted).select("seq", "type", "id", F.coalesce("resource_id", "id").alias("of"), "expires_at", "ts")
    return rows.groupBy("of").applyInPandasWithState(step, "id string, resource_id string, expires_at bigint", "ids array<string>, times array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def tumbling_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """``(start, type, n)``: events by type in windows of event time."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "type", "n")


def admitting(requests: DataFrame, log: str, checkpoint: str, clock: Callable[[], int], compact_every: int = 0) -> StreamingQuery:
    """Starts the single writer of ``log``: each micro-batch of booking requests ``(seq, id, resource_id, start, end, label)`` is decided against the folded log, and what is admitted is appended in one commit.

    ``clock`` gives the time of each batch in Unix milliseconds. After every ``compact_every`` batches (0: never) a snapshot is made, so that a
    batch reads the state and what follows it instead of all history. A batch that is run again after a failure finds its bookings in the
    log and adds none twice. The caller stops the query.
    """

    def decide(batch: DataFrame, epoch: int) -> None:
        spark, now = batch.sparkSession, clock()
        past = valid_prefix(read_log(spark, log))
        state = fold(past, now)
        fresh = batch.join(state.bookings.select("id"), "id", "left_anti")
        last = past.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("seq")).first()["seq"]
        good = admit(state, fresh).where("admitted").select("id").join(fresh, "id")
        append_log(event("BookingConfirmed", good, F.lit(last) + F.col("seq") + 1), log)
        if compact_every and (epoch + 1) % compact_every == 0:
            compact(spark, log, now)

    return requests.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
