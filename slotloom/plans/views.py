"""SQL access: the tables of a schedule as temporary views, and free time as another, for Spark's own SQL."""

from __future__ import annotations

from slotloom.operators.availability import availability
from slotloom.schema import Limits, Schedule


def register(s: Schedule, prefix: str = "") -> None:
    """Makes views ``resources``, ``rules``, ``holds``, ``bookings`` and ``intervals``, each with ``prefix`` in front."""
    for name in ("resources", "rules", "holds", "bookings"):
        getattr(s, name).createOrReplaceTempView(prefix + name)
    s.intervals().createOrReplaceTempView(prefix + "intervals")


def register_availability(s: Schedule, start: int, end: int, name: str = "availability", limits: Limits = Limits()) -> None:
    """Makes a view of all free spans in a window; filters on ``resource_id`` reach down to the scans."""
    availability(s, start, end, limits=limits).createOrReplaceTempView(name)
