"""Admission: which requests get in, where earlier ones stand in the way of later ones.

Each resource's line is cut into pieces of about ``PIECE`` starts, and rounds decide all pieces at once. A piece is gone through in the order
of ``seq``; a request is refused once what is held fills the capacity, and admitted once what is held and all earlier undecided
requests together do not. One that lies in several pieces is refused by any of them and admitted by all. The first undecided
request is always decided, so the rounds end; all requests across one cut share an instant, so a cut takes few rounds: when the capacity
is held there, the others are refused together. A line of one piece takes one round.

A task holds one piece: its starts (more where one instant has more), and what reaches into it from before.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.functions.spans import plus
from slotloom.functions.tables import kept
from slotloom.operators.conflict import LAST, allocations, overlap_pairs, validated, what_if
from slotloom.operators.mutations import over_cap
from slotloom.operators.sweep import peaks, running
from slotloom.schema import Limits, Schedule
from slotloom.sources.events import REMOVED, event

PIECE = 4096
DAY = 86_400_000
VERDICTS = "k bigint, capacity bigint, held bigint, most bigint, first_start bigint, first_id string, late boolean"


def _peak(starts: np.ndarray, ends: np.ndarray, start: int) -> int:
    """The largest number of these spans at one time from ``start`` on, which all of them reach."""
    if not len(starts):
        return 0
    starts = np.sort(np.maximum(starts, start))
    return int((np.searchsorted(starts, starts, "right") - np.searchsorted(np.sort(ends), starts, "right")).max())


def judge(piece: dict[str, np.ndarray]) -> list[tuple]:
    """What one piece (columns of its rows) says of its undecided requests: the peaks of what is held and of what may be, the first held that overlaps, and whether an undecided one (``late``) could come before that."""
    new = ~np.isnan(piece["seq"])
    old = np.nonzero(~new)[0]
    n, out, ids = len(old), [], piece["id"][old].tolist()
    starts, ends, sure = (np.empty(len(new), t) for t in (np.int64, np.int64, bool))
    starts[:n], ends[:n], sure[:n] = piece["start"][old], piece["end"][old], True
    asked = [piece[c][new].tolist() for c in ("seq", "id", "k", "start", "end", "capacity", "ghost", "held", "crossing")]
    for _, name, k, start, end, capacity, ghost, settled, crossing in sorted(zip(*asked)):
        if ghost and settled:
            continue
        if not settled:
            met = np.nonzero((starts[:n] < end) & (ends[:n] > start))[0]
            known = met[sure[met]]
            most = _peak(starts[met], ends[met], start)
            held = most if len(known) == len(met) else _peak(starts[known], ends[known], start)
            first = min(((int(starts[j]), ids[j]) for j in known), default=(None, None)) if capacity <= 1 else (None, None)
            out.append((k, capacity, held, most, *first, len(known) < len(met)))
            if held >= max(capacity, 1) or ghost:
                continue
        starts[n], ends[n], sure[n] = start, end, settled or (not crossing and most < max(capacity, 1))
        ids.append(name)
        n += 1
    return out


def judge_pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Judges the pieces of one partition, whose rows come piece by piece; no more than a batch and one piece is held. Pieces are many and mostly small, so that no frame is made of each."""
    rest = None
    for frame in itertools.chain(frames, [None]):
        rows = rest if frame is None else frame if rest is None else pd.concat([rest, frame])
        if rows is None or not len(rows):
            continue
        columns = {c: rows[c].to_numpy() for c in rows.columns}
        columns["seq"] = columns["seq"].astype(np.float64)
        of, piece = columns["resource_id"], columns["piece"]
        cuts = [0, *(np.nonzero((of[1:] != of[:-1]) | (piece[1:] != piece[:-1]))[0] + 1).tolist(), len(rows)]
        rest = None if frame is None else rows.iloc[cuts[-2] :]
        cuts = cuts if frame is None else cuts[:-1]
        out = [told for i, j in zip(cuts, cuts[1:]) for told in judge({c: x[i:j] for c, x in columns.items()})]
        if out:
            yield pd.DataFrame(out, columns=["k", "capacity", "held", "most", "first_start", "first_id", "late"]).astype({"first_start": "Int64", "first_id": object, "late": bool})


def _placed(spans: DataFrame, piece: int) -> DataFrame:
    """Each of ``spans`` once for each ``piece`` of its resource's line in which it lies, and whether these are several (``crossing``)."""
    counted = running(spans.select("resource_id", F.col("start").alias("t"), F.lit(1).cast("bigint").alias("n")), "n", ["resource_id"], bucket=DAY)
    cuts = counted.where(F.floor(F.col("a_n") / piece) > F.floor(F.col("b_n") / piece)).select("resource_id", (F.col("t") + 1).alias("t"), F.lit(1).cast("bigint").alias("cut"))
    mark = lambda t: spans.select("resource_id", t.alias("t"), F.lit(0).cast("bigint").alias("cut"))
    at = running(cuts.unionByName(mark(F.col("start"))).unionByName(mark(F.col("end") - 1)), "cut", ["resource_id"], bucket=DAY)
    at = kept(at.select("resource_id", "t", F.col("a_cut").alias("piece")), "pieces")
    rows = spans.join(at.select("resource_id", F.col("t").alias("start"), F.col("piece").alias("lo")), ["resource_id", "start"])
    rows = rows.withColumn("last", F.col("end") - 1).join(at.select("resource_id", F.col("t").alias("last"), F.col("piece").alias("hi")), ["resource_id", "last"])
    return rows.select(*spans.columns, (F.col("lo") < F.col("hi")).alias("crossing"), F.explode(F.sequence("lo", "hi")).alias("piece"))


def admit(s: Schedule, requests: DataFrame, limits: Limits = Limits(), piece: int = PIECE) -> DataFrame:
    """``(id, admitted, error)`` for bookings or holds ``requests (seq, id, resource_id, start, end)``, each decided after all of smaller ``seq``. The rounds run when this is called.

    Ids must differ. A hold (with a column ``expires_at``) that has expired when it is placed may be admitted but stands in nobody's way. Requests whose
    resource has ``Limits.intervals`` intervals when their turn comes are refused before any conflict is looked for.
    """
    ghost = F.coalesce(F.col("expires_at") <= s.now, F.lit(False)) if "expires_at" in requests.columns else F.lit(False)
    of = s.resources.select(F.col("id").alias("resource_id"), "capacity", F.coalesce("buffer_after", F.lit(0)).alias("buffer"))
    rows = kept(validated(requests, limits).join(of, "resource_id", "left").withColumn("error", F.coalesce("error", F.when(F.col("capacity").isNull(), "NotFound"))), "requests")
    asked = rows.where("error is null").select("resource_id", "id", "seq", "start", plus("end", "buffer").alias("end"), ghost.alias("ghost"))
    held = allocations(s).join(asked.select("resource_id").distinct(), "resource_id", "left_semi").where("b_start < b_end")
    every = asked.unionByName(held.select("resource_id", F.col("b_id").alias("id"), F.lit(None).cast("bigint").alias("seq"), F.col("b_start").alias("start"), F.col("b_end").alias("end"), F.lit(False).alias("ghost")))
    every = kept(every.join(of.select("resource_id", "capacity"), "resource_id").withColumn("k", F.monotonically_increasing_id()), "footprints")
    now, settled = kept(_placed(every, piece).withColumn("held", F.col("seq").isNull()), "placed"), None
    while True:
        told = now.repartition("resource_id", "piece").sortWithinPartitions("resource_id", "piece").mapInPandas(judge_pieces, VERDICTS)
        told = told.groupBy("k").agg(F.max("held").alias("held"), F.max("most").alias("most"), F.max(F.greatest("capacity", F.lit(1))).alias("full"), F.min(F.when(F.col("first_start").isNotNull(), F.struct("first_start", "first_id"))).alias("first"), F.max("late").alias("late"))
        admitted = F.when(F.col("held") >= F.col("full"), False).when(F.col("most") < F.col("full"), True)
        told = kept(told.select("k", admitted.alias("admitted"), F.col("first.first_id").alias("first_id"), "late"), "round")
        good = told.where("admitted is not null")
        settled = good if settled is None else settled.unionByName(good)
        if told.where("admitted is null").isEmpty():
            break
        now = now.join(good.select("k", "admitted"), "k", "left").where("admitted is null or admitted").withColumn("held", F.col("held") | F.col("admitted").isNotNull()).drop("admitted")
        now = kept(now.join(now.where("not held").select("resource_id", "piece").distinct(), ["resource_id", "piece"], "left_semi"), "placed")
    settled = kept(every.where("seq is not null").join(settled, "k"), "settled")
    # refused while an earlier overlapping request was open: the first that overlaps shows in the end only
    late = settled.where("not admitted and late and capacity <= 1").select("resource_id", F.struct("k", "seq", "id").alias("a_id"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    inside = every.where("seq is null").unionByName(settled.where("admitted and not ghost").select(every.columns))
    met = overlap_pairs(late, inside.select("resource_id", F.struct("seq", "id", "k").alias("b_id"), F.col("start").alias("b_start"), F.col("end").alias("b_end")))
    before = F.col("b_id.seq").isNull() | (F.struct("b_id.seq", "b_id.id", "b_id.k") < F.struct("a_id.seq", "a_id.id", "a_id.k"))
    met = met.where(before).groupBy(F.col("a_id.k").alias("k")).agg(F.min(F.struct("b_start", "b_id.id")).alias("met")).select("k", F.col("met.id").alias("met_id"))
    error = F.when(F.col("admitted"), None).when(F.col("capacity") <= 1, F.concat(F.lit("Conflict: "), F.coalesce("met_id", "first_id"))).otherwise(F.concat(F.lit("CapacityExceeded: "), F.col("capacity")))
    decided = settled.join(met, "k", "left").select("id", "admitted", error.alias("error"), "seq", "resource_id", F.col("admitted").alias("ok"))
    decided = over_cap(s, kept(decided, "decided"), limits).select("id", (F.col("admitted") & ~F.col("full")).alias("admitted"), F.when(F.col("full"), "LimitExceeded: too many intervals on resource").otherwise(F.col("error")).alias("error"))
    return decided.unionByName(rows.where("error is not null").select("id", F.lit(False).alias("admitted"), "error"))


def batch_what_if(s: Schedule, batches: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``(batch_id, error)`` for all-or-nothing batches ``(batch_id, id, resource_id, start, end)``, each as if it were alone; null: admitted.

    A batch is refused if a member would be refused alone, or if its members exceed the capacity together: for capacity up to 1 when two of
    them overlap, else when members and allocations together do so anywhere in the batch's span on that resource, even where the
    allocations alone do. The error is the least of those found; a batch of more than ``Limits.batch`` members is refused as it is. Ids of members must differ within a batch.
    """
    key = F.concat_ws("\0", "batch_id", "id")
    single = what_if(s, batches.select(key.alias("id"), "resource_id", "start", "end"), limits).where("error is not null").select(F.split("id", "\0")[0].alias("batch_id"), "error")
    of = s.resources.select(F.col("id").alias("resource_id"), "capacity", F.coalesce("buffer_after", F.lit(0)).alias("buffer"))
    members = batches.where("start < end").join(of, "resource_id").select("batch_id", "resource_id", "capacity", "buffer", "id", "start", plus("end", "buffer").alias("end"))
    bounds = members.groupBy("batch_id", "resource_id").agg(F.min("start").alias("a_start"), F.max("end").alias("a_end"), F.count("*").alias("n"), F.max("capacity").alias("capacity"), F.max("buffer").alias("buffer")).where("n > 1")
    many = bounds.where("capacity > 1")
    near = overlap_pairs(many.select("resource_id", F.col("batch_id").alias("a_id"), F.greatest(F.col("a_start") - F.col("buffer"), F.lit(0)).alias("a_start"), "a_end"), allocations(s))
    load = members.join(bounds.select("batch_id", "resource_id"), ["batch_id", "resource_id"], "left_semi").select("batch_id", "resource_id", "start", "end")
    load = load.unionByName(near.select(F.col("a_id").alias("batch_id"), "resource_id", F.col("b_start").alias("start"), F.col("b_end").alias("end")))
    load = load.where("start < end").withColumn("end", F.greatest(F.least("end", F.lit(LAST)), F.col("start") + 1))  # the most is reached at a start
    most = peaks(kept(load, "load"), ["batch_id", "resource_id"], DAY * 256)
    over = most.join(of, "resource_id").where(F.col("peak") > F.greatest("capacity", F.lit(1)))
    together = over.select("batch_id", F.when(F.col("capacity") <= 1, F.lit("Conflict")).otherwise(F.concat(F.lit("CapacityExceeded: "), F.col("capacity"))).alias("error"))
    found = single.unionByName(together).groupBy("batch_id").agg(F.min("error").alias("error"))
    sizes = batches.groupBy("batch_id").agg(F.count("*").alias("n"))
    return sizes.join(found, "batch_id", "left").select("batch_id", F.when(F.col("n") > limits.batch, "LimitExceeded: batch too large").otherwise(F.col("error")).alias("error"))


def commit_holds(s: Schedule, requests: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``(id, hold_id, error)`` for ``requests (hold_id, id, label)`` to turn holds into bookings on their spans, each as if alone. The hold itself is not in its way, and may have expired."""
    holds = s.holds.select(F.col("id").alias("hold_id"), "resource_id", "start", "end")
    rows = requests.join(holds, "hold_id", "left")
    fault = F.when(F.col("resource_id").isNull(), "NotFound").when(F.octet_length("label") > limits.label_bytes, "LimitExceeded: label too long")
    rows = rows.withColumn("fault", fault)
    judged = what_if(s, rows.where("fault is null").select("id", "resource_id", "start", "end", F.col("hold_id").alias("ignore_id")), limits).select("id", "error")
    return rows.join(judged, "id", "left").select("id", "hold_id", F.coalesce("fault", "error").alias("error"))


def commit_events(s: Schedule, requests: DataFrame, first_seq: int, limits: Limits = Limits()) -> DataFrame:
    """The events of the holds that ``commit_holds`` admits: release, then confirmation, with neighbouring numbers from ``first_seq`` on (gaps between pairs)."""
    good = commit_holds(s, requests, limits).where("error is null").join(requests.select("id", "label"), "id").join(s.holds.select(F.col("id").alias("hold_id"), "resource_id", "start", "end"), "hold_id")
    good = good.withColumn("pair", F.monotonically_increasing_id() * 2 + F.lit(first_seq))
    both = F.array(F.struct(F.col("pair").alias("seq"), F.lit("HoldReleased").alias("type"), F.col("hold_id").alias("id")), F.struct((F.col("pair") + 1).alias("seq"), F.lit("BookingConfirmed").alias("type"), F.col("id").alias("id")))
    rows = good.select("resource_id", "start", "end", "label", F.explode(both).alias("e")).select("e.*", "resource_id", "start", "end", "label")
    keep = lambda c: F.when(~F.col("type").isin(REMOVED), F.col(c))
    return event("", rows, F.col("seq"), type=F.col("type"), start=keep("start"), end=keep("end"), label=keep("label"))
