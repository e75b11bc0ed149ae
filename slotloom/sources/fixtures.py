"""Two schedules derived from the test tables: a team calendar from ``events`` and a dispatch tree from ``supplier`` and ``lineitem``.

The tables of a schedule are written once in an application and read by all queries, as a stored schedule is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotloom.functions.tables import REMEMBERED, kept
from slotloom.schema import Schedule

A_START, A_END, A_NOW = 1_704_067_200_000, 1_706_659_200_000, 1_705_276_800_000
B_START, B_END = 883_612_800_000, 891_302_400_000
DAY = 86_400_000


def ident(n: Column | int) -> Column:
    return F.lpad((n if isinstance(n, Column) else F.lit(n)).cast("bigint").cast("string"), 26, "0")


def millis(name: str) -> Column:
    """Milliseconds of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast({name} as timestamp_ntz))")


def _resource(id_: Column, parent: Column, capacity, buffer) -> list[Column]:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [id_.alias("id"), parent.cast("string").alias("parent_id"), F.lit(None).cast("string").alias("name"), lit(capacity).cast("bigint").alias("capacity"), lit(buffer).cast("bigint").alias("buffer_after")]


def _rule(id_: Column, resource: Column, start, end, blocking: bool) -> list[Column]:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [id_.alias("id"), resource.alias("resource_id"), lit(start).cast("bigint").alias("start"), lit(end).cast("bigint").alias("end"), F.lit(blocking).alias("blocking")]


def events_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", "props", millis("ts").alias("start"))
    return rows.withColumns({"id": ident(F.col("event_id") + 10_000_000_000), "resource_id": ident(F.col("user_id") + 100_000)})


def _lasting(rows: DataFrame, ms: int) -> DataFrame:
    return rows.withColumn("end", F.col("start") + (F.floor("value") + 1) * F.lit(ms).cast("bigint"))


def candidates_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested spans: ``(id, resource_id, start, end)``."""
    return _lasting(events_a(spark, sf_dir).where("event_type = 'signup'"), 60_000).select("id", "resource_id", "start", "end")


def _stored(name: str, make, spark: SparkSession, sf_dir: str) -> Schedule:
    key = (spark.sparkContext.applicationId, name, sf_dir)
    if key not in REMEMBERED:
        s = make(spark, sf_dir)
        REMEMBERED[key] = Schedule(*[kept(getattr(s, t), f"{name}-{t}") for t in ("resources", "rules", "holds", "bookings")], s.now)
    return REMEMBERED[key]


def calendar(spark: SparkSession, sf_dir: str) -> Schedule:
    return _stored("calendar", _calendar, spark, sf_dir)


def dispatch(spark: SparkSession, sf_dir: str) -> Schedule:
    return _stored("dispatch", _dispatch, spark, sf_dir)


def _calendar(spark: SparkSession, sf_dir: str) -> Schedule:
    events = events_a(spark, sf_dir)
    users = events.select("user_id").distinct().withColumn("team", F.floor(F.col("user_id") / 10))
    teams = users.select("team").distinct()
    org = spark.range(1)
    u, t = F.col("user_id"), F.col("team")
    resources = org.select(*_resource(ident(1), F.lit(None), 1, None))
    resources = resources.unionByName(teams.select(*_resource(ident(t + 1000), ident(1), 1, None)))
    resources = resources.unionByName(users.select(*_resource(ident(u + 100_000), ident(t + 1000), u % 3 + 1, F.when(u % 4 != 0, u % 4 * 900_000))))
    rules = org.select(*_rule(ident(10_000_000), ident(1), A_START, A_END, False))
    rules = rules.unionByName(teams.where("team % 3 = 0").select(*_rule(ident(t + 10_001_000), ident(t + 1000), F.lit(A_START) + t % 5 * DAY, 1_705_881_600_000, False)))
    rules = rules.unionByName(teams.where("team % 4 = 1").select(*_rule(ident(t + 10_002_000), ident(t + 1000), 1_705_276_800_000, 1_705_363_200_000, True)))
    opened = _lasting(events.where("event_type = 'view' and user_id % 5 = 0"), 360_000)
    blocked = _lasting(events.where("event_type = 'error'"), 60_000)
    rules = rules.unionByName(opened.select("id", "resource_id", "start", "end", F.lit(False).alias("blocking"))).unionByName(blocked.select("id", "resource_id", "start", "end", F.lit(True).alias("blocking")))
    holds = _lasting(events.where("event_type = 'click'"), 60_000).select("id", "resource_id", "start", "end", (F.col("start") + F.col("event_id") % 20 * DAY).alias("expires_at"))
    bookings = _lasting(events.where("event_type = 'purchase'"), 60_000).select("id", "resource_id", "start", "end", F.col("props").alias("label"))
    return Schedule(resources, rules, holds, bookings, A_NOW)


def _dispatch(spark: SparkSession, sf_dir: str) -> Schedule:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    region, nation, supplier = read("region"), read("nation"), read("supplier")
    r, n, k = F.col("r_regionkey"), F.col("n_nationkey"), F.col("s_suppkey")
    resources = region.select(*_resource(ident(r + 1), F.lit(None), 1, None))
    resources = resources.unionByName(nation.select(*_resource(ident(n + 100), ident(F.col("n_regionkey") + 1), 1, None)))
    resources = resources.unionByName(supplier.select(*_resource(ident(k + 10_000), ident(F.col("s_nationkey") + 100), k % 4 + 1, F.when(k % 3 != 0, k % 3 * 3_600_000))))
    rules = region.select(*_rule(ident(r + 20_000_000), ident(r + 1), 788_918_400_000, 1_009_843_200_000, False))
    at = F.lit(B_START) + n.cast("bigint") * 259_200_000
    rules = rules.unionByName(nation.select(*_rule(ident(n + 20_000_100), ident(n + 100), at, at + 259_200_000, True)))
    rules = rules.unionByName(supplier.where("s_suppkey % 7 = 0").select(*_rule(ident(k + 20_010_000), ident(k + 10_000), B_START, 888_796_800_000, False)))
    line = read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", millis("l_shipdate").alias("start"))
    key = ((F.col("l_orderkey") * 100_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")
    bookings = line.select(ident(key).alias("id"), ident(F.col("l_suppkey") + 10_000).alias("resource_id"), "start", (F.col("start") + F.floor("l_quantity") * 3_600_000).alias("end"), F.lit(None).cast("string").alias("label"))
    holds = bookings.limit(0).select("id", "resource_id", "start", "end", F.col("start").alias("expires_at"))
    return Schedule(resources, rules, holds, bookings, B_START)
