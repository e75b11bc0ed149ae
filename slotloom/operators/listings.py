"""Listings and counts of the base tables, in a fixed order of columns. Orders are left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.functions.spans import is_live
from slotloom.schema import Limits, Schedule, ScheduleError


def roots(s: Schedule) -> DataFrame:
    return s.resources.where("parent_id is null")


def children(s: Schedule, parent_id: str) -> DataFrame:
    return s.resources.where(F.col("parent_id") == parent_id)


def rules_of(s: Schedule, resource_id: str) -> DataFrame:
    return s.rules.where(F.col("resource_id") == resource_id)


def _of(rows: DataFrame, ids: Sequence[str], limits: Limits) -> DataFrame:
    """Repeated ids count once, unknown ones give nothing."""
    if len(ids) > limits.ids:
        raise ScheduleError("LimitExceeded", "too many ids")
    return rows.where(F.col("resource_id").isin(list(ids)))


def bookings_of(s: Schedule, ids: Sequence[str], limits: Limits = Limits()) -> DataFrame:
    return _of(s.bookings, ids, limits)


def holds_of(s: Schedule, ids: Sequence[str], limits: Limits = Limits()) -> DataFrame:
    """Expired holds that nothing has released are listed too."""
    return _of(s.holds, ids, limits)


def live_holds(s: Schedule) -> DataFrame:
    return s.holds.where(is_live(s.now))


def earliest_expiry(s: Schedule) -> DataFrame:
    """``(resource_id, expires_at)``: when the first of a resource's live holds expires."""
    return live_holds(s).groupBy("resource_id").agg(F.min("expires_at").alias("expires_at"))


def interval_counts(s: Schedule) -> DataFrame:
    """``(resource_id, n, first, last)`` of the intervals of every resource that has any: their number and bounds."""
    return s.intervals().groupBy("resource_id").agg(F.count("*").alias("n"), F.min("start").alias("first"), F.max("end").alias("last"))
