"""Tables, limits and errors of the scheduling model.

Everything is a half-open interval ``[start, end)`` of Unix milliseconds on a resource in a tree. Ids are 26-character texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESOURCES = "id string, parent_id string, name string, capacity bigint, buffer_after bigint"
RULES = "id string, resource_id string, start bigint, end bigint, blocking boolean"
HOLDS = "id string, resource_id string, start bigint, end bigint, expires_at bigint"
BOOKINGS = "id string, resource_id string, start bigint, end bigint, label string"
#: One row for each logged change; set_name, set_capacity and set_buffer say which columns a resource update sets (a set null clears).
EVENTS = (
    "seq bigint, type string, id string, resource_id string, parent_id string, set_name boolean, name string, set_capacity boolean, capacity bigint,"
    " set_buffer boolean, buffer_after bigint, start bigint, end bigint, blocking boolean, expires_at bigint, label string"
)
#: The types of events.
EVENT_TYPES = ["ResourceCreated", "ResourceUpdated", "ResourceDeleted", "RuleAdded", "RuleUpdated", "RuleRemoved", "HoldPlaced", "HoldReleased", "BookingConfirmed", "BookingCancelled"]


@dataclass(frozen=True)
class Limits:
    """What requests may ask for at most. Bulk analysis may pass ``Limits(window_ms=None)``."""

    window_ms: int | None = 90 * 86_400_000
    span_ms: int = 3650 * 86_400_000
    last_ms: int = 32_503_680_000_000
    batch: int = 1000
    ids: int = 1000
    intervals: int = 100_000
    resources: int = 100_000
    tenants: int = 1000
    depth: int = 50
    name_bytes: int = 1000
    label_bytes: int = 10_000
    tenant_bytes: int = 256
    followed: int = 100


class ScheduleError(ValueError):
    """A request that the model refuses; ``kind`` names why."""

    def __init__(self, kind: str, detail: str = ""):
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind = kind


@dataclass
class Schedule:
    """The four tables at one moment; ``now`` decides which holds are alive."""

    resources: DataFrame
    rules: DataFrame
    holds: DataFrame
    bookings: DataFrame
    now: int

    def intervals(self) -> DataFrame:
        """All intervals in one table: id, resource_id, start, end, kind (open, blocked, hold, booking), expires_at, label."""
        null = lambda t: F.lit(None).cast(t)
        kind = F.when(F.col("blocking"), "blocked").otherwise("open")
        rows = self.rules.select("id", "resource_id", "start", "end", kind.alias("kind"), null("bigint").alias("expires_at"), null("string").alias("label"))
        rows = rows.unionByName(self.holds.select("id", "resource_id", "start", "end", F.lit("hold").alias("kind"), "expires_at", null("string").alias("label")))
        return rows.unionByName(self.bookings.select("id", "resource_id", "start", "end", F.lit("booking").alias("kind"), null("bigint").alias("expires_at"), "label"))
