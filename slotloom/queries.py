"""The library's queries over the test tables, by name, with the SQL that checks each.

The SQL states each result in another way than the Spark code: free time is found segment by segment with correlated counts
instead of running sums, so that it can catch faults of the sweeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotloom.functions import spans
from slotloom.operators import admission, availability as av, conflict, hierarchy, listings, mutations, sweep
from slotloom.schema import Limits, Schedule
from slotloom.sources import events as ev, fixtures as fx
from slotloom.streaming import feed

USER, TEAM = "00000000000000000000100005", "00000000000000000000001000"
SOME = [f"{100_000 + i:026d}" for i in (1, 2, 3, 5, 8, 13, 999_999, 1)]

# ---------------------------------------------------------------- the fixtures in SQL

A_SQL = """
ev AS (SELECT event_id, user_id AS u, CAST(floor(user_id / 10) AS BIGINT) AS t, event_type, value, props, epoch_us(ts) // 1000 AS ms, lpad(CAST(10000000000 + event_id AS VARCHAR), 26, '0') AS id, lpad(CAST(100000 + user_id AS VARCHAR), 26, '0') AS rid FROM events),
us AS (SELECT DISTINCT u, t FROM ev),
resources AS (
  SELECT lpad('1', 26, '0') AS id, CAST(NULL AS VARCHAR) AS parent_id, CAST(NULL AS VARCHAR) AS name, 1::BIGINT AS capacity, CAST(NULL AS BIGINT) AS buffer_after
  UNION ALL SELECT DISTINCT lpad(CAST(1000 + t AS VARCHAR), 26, '0'), lpad('1', 26, '0'), NULL, 1, NULL FROM us
  UNION ALL SELECT lpad(CAST(100000 + u AS VARCHAR), 26, '0'), lpad(CAST(1000 + t AS VARCHAR), 26, '0'), NULL, 1 + u % 3, CASE WHEN u % 4 <> 0 THEN (u % 4) * 900000 END FROM us),
rules AS (
  SELECT lpad('10000000', 26, '0') AS id, lpad('1', 26, '0') AS resource_id, 1704067200000::BIGINT AS s, 1706659200000::BIGINT AS e, FALSE AS blocking
  UNION ALL SELECT DISTINCT lpad(CAST(10001000 + t AS VARCHAR), 26, '0'), lpad(CAST(1000 + t AS VARCHAR), 26, '0'), 1704067200000 + (t % 5) * 86400000, 1705881600000, FALSE FROM us WHERE t % 3 = 0
  UNION ALL SELECT DISTINCT lpad(CAST(10002000 + t AS VARCHAR), 26, '0'), lpad(CAST(1000 + t AS VARCHAR), 26, '0'), 1705276800000, 1705363200000, TRUE FROM us WHERE t % 4 = 1
  UNION ALL SELECT id, rid, ms, ms + CAST(1 + floor(value) AS BIGINT) * 360000, FALSE FROM ev WHERE event_type = 'view' AND u % 5 = 0
  UNION ALL SELECT id, rid, ms, ms + CAST(1 + floor(value) AS BIGINT) * 60000, TRUE FROM ev WHERE event_type = 'error'),
holds AS (SELECT id, rid AS resource_id, ms AS s, ms + CAST(1 + floor(value) AS BIGINT) * 60000 AS e, ms + (event_id % 20) * 86400000 AS expires_at FROM ev WHERE event_type = 'click'),
bookings AS (SELECT id, rid AS resource_id, ms AS s, ms + CAST(1 + floor(value) AS BIGINT) * 60000 AS e, props AS label FROM ev WHERE event_type = 'purchase'),
requests AS (SELECT id, rid AS resource_id, ms AS s, ms + CAST(1 + floor(value) AS BIGINT) * 60000 AS e FROM ev WHERE event_type = 'signup'),
live AS (SELECT * FROM holds WHERE expires_at > 1705276800000)
"""
B_SQL = """
resources AS (
  SELECT lpad(CAST(1 + r_regionkey AS VARCHAR), 26, '0') AS id, CAST(NULL AS VARCHAR) AS parent_id, 1::BIGINT AS capacity, CAST(NULL AS BIGINT) AS buffer_after FROM region
  UNION ALL SELECT lpad(CAST(100 + n_nationkey AS VARCHAR), 26, '0'), lpad(CAST(1 + n_regionkey AS VARCHAR), 26, '0'), 1, NULL FROM nation
  UNION ALL SELECT lpad(CAST(10000 + s_suppkey AS VARCHAR), 26, '0'), lpad(CAST(100 + s_nationkey AS VARCHAR), 26, '0'), 1 + s_suppkey % 4, CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey % 3) * 3600000 END FROM supplier),
rules AS (
  SELECT lpad(CAST(1 + r_regionkey AS VARCHAR), 26, '0') AS resource_id, 788918400000::BIGINT AS s, 1009843200000::BIGINT AS e, FALSE AS blocking FROM region
  UNION ALL SELECT lpad(CAST(100 + n_nationkey AS VARCHAR), 26, '0'), 883612800000 + n_nationkey::BIGINT * 259200000, 883612800000 + n_nationkey::BIGINT * 259200000 + 259200000, TRUE FROM nation
  UNION ALL SELECT lpad(CAST(10000 + s_suppkey AS VARCHAR), 26, '0'), 883612800000, 888796800000, FALSE FROM supplier WHERE s_suppkey % 7 = 0),
bookings AS (SELECT lpad(CAST(10000 + l_suppkey AS VARCHAR), 26, '0') AS resource_id, epoch_us(l_shipdate) // 1000 AS s, epoch_us(l_shipdate) // 1000 + CAST(floor(l_quantity) AS BIGINT) * 3600000 AS e FROM lineitem),
live AS (SELECT resource_id, s, e FROM bookings WHERE FALSE)
"""
TREE_SQL = """
tree AS (SELECT id, id AS ancestor_id, 0 AS depth FROM resources UNION ALL SELECT t.id, r.parent_id, t.depth + 1 FROM tree t JOIN resources r ON r.id = t.ancestor_id WHERE r.parent_id IS NOT NULL)
"""


def free_sql(start: int, end: int) -> str:
    return f"""
near AS (SELECT t.id AS resource_id, t.depth, greatest(r.s, {start}) AS s, least(r.e, {end}) AS e, r.blocking FROM tree t JOIN rules r ON r.resource_id = t.ancestor_id WHERE r.s < {end} AND r.e > {start}),
opens AS (SELECT n.* FROM near n JOIN (SELECT resource_id, min(depth) AS d FROM near WHERE NOT blocking GROUP BY ALL) m ON m.resource_id = n.resource_id AND m.d = n.depth WHERE NOT n.blocking),
blocks AS (SELECT * FROM near WHERE blocking),
allocs AS (SELECT a.resource_id, greatest(a.s, {start}) AS s, least(a.e + coalesce(r.buffer_after, 0), {end}) AS e FROM (SELECT resource_id, s, e FROM bookings UNION ALL SELECT resource_id, s, e FROM live) a JOIN resources r ON r.id = a.resource_id WHERE a.s < a.e AND a.s < {end} AND a.e + coalesce(r.buffer_after, 0) > {start}),
cuts AS (SELECT DISTINCT resource_id, t FROM (SELECT resource_id, unnest([s, e]) AS t FROM near UNION ALL SELECT resource_id, unnest([s, e]) FROM allocs)),
segs AS (SELECT resource_id, t AS s, lead(t) OVER (PARTITION BY resource_id ORDER BY t) AS e FROM cuts),
state AS (SELECT g.resource_id, g.s, g.e, greatest(r.capacity, 1) AS capacity,
  (SELECT count(*) FROM opens o WHERE o.resource_id = g.resource_id AND o.s <= g.s AND o.e >= g.e) AS n_open,
  (SELECT count(*) FROM blocks b WHERE b.resource_id = g.resource_id AND b.s <= g.s AND b.e >= g.e) AS n_blocked,
  (SELECT count(*) FROM allocs a WHERE a.resource_id = g.resource_id AND a.s <= g.s AND a.e >= g.e) AS n_active
  FROM segs g JOIN resources r ON r.id = g.resource_id WHERE g.e IS NOT NULL),
pieces AS (SELECT resource_id, s, e, lag(e) OVER (PARTITION BY resource_id ORDER BY s) AS before FROM state WHERE n_open > 0 AND n_blocked = 0 AND n_active < capacity),
free AS (SELECT resource_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN before = s THEN 0 ELSE 1 END) OVER (PARTITION BY resource_id ORDER BY s) AS g FROM pieces) GROUP BY resource_id, g)
"""


def free_each_sql(asked: str) -> str:
    """As ``free_sql``, for each row of ``asked (q, rid, s, e)`` in a window of its own."""
    return f"""
near AS (SELECT x.q, t.depth, greatest(r.s, x.s) AS s, least(r.e, x.e) AS e, r.blocking FROM {asked} x JOIN tree t ON t.id = x.rid JOIN rules r ON r.resource_id = t.ancestor_id WHERE r.s < x.e AND r.e > x.s),
opens AS (SELECT n.* FROM near n JOIN (SELECT q, min(depth) AS d FROM near WHERE NOT blocking GROUP BY ALL) m ON m.q = n.q AND m.d = n.depth WHERE NOT n.blocking),
allocs AS (SELECT x.q, greatest(a.s, x.s) AS s, least(a.e + coalesce(r.buffer_after, 0), x.e) AS e FROM {asked} x JOIN resources r ON r.id = x.rid JOIN (SELECT resource_id, s, e FROM bookings UNION ALL SELECT resource_id, s, e FROM live) a ON a.resource_id = x.rid WHERE a.s < x.e AND a.e + coalesce(r.buffer_after, 0) > x.s),
cuts AS (SELECT DISTINCT q, t FROM (SELECT q, unnest([s, e]) AS t FROM near UNION ALL SELECT q, unnest([s, e]) FROM allocs)),
segs AS (SELECT q, t AS s, lead(t) OVER (PARTITION BY q ORDER BY t) AS e FROM cuts),
state AS (SELECT g.q, g.s, g.e, greatest(r.capacity, 1) AS capacity,
  (SELECT count(*) FROM opens o WHERE o.q = g.q AND o.s <= g.s AND o.e >= g.e) AS n_open,
  (SELECT count(*) FROM near b WHERE b.blocking AND b.q = g.q AND b.s <= g.s AND b.e >= g.e) AS n_blocked,
  (SELECT count(*) FROM allocs a WHERE a.q = g.q AND a.s <= g.s AND a.e >= g.e) AS n_active
  FROM segs g JOIN {asked} x ON x.q = g.q JOIN resources r ON r.id = x.rid WHERE g.e IS NOT NULL),
pieces AS (SELECT q, s, e, lag(e) OVER (PARTITION BY q ORDER BY s) AS before FROM state WHERE n_open > 0 AND n_blocked = 0 AND n_active < capacity),
free AS (SELECT q, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN before = s THEN 0 ELSE 1 END) OVER (PARTITION BY q ORDER BY s) AS g FROM pieces) GROUP BY q, g)
"""


def uncovered_sql(asked: str) -> str:
    """``gaps (id, s, e)`` of open rules ``asked (id, resource_id, s, e)``: what the parent's free time in the rule's own span leaves open."""
    return f"""
inner_ AS (SELECT a.id AS q, r.parent_id AS rid, a.s, a.e FROM {asked} a JOIN resources r ON r.id = a.resource_id WHERE r.parent_id IS NOT NULL),
{free_each_sql('inner_')},
inside AS (SELECT q, s, e, lag(e) OVER (PARTITION BY q ORDER BY s) AS before FROM free),
gaps AS (SELECT * FROM (SELECT i.q AS id, coalesce(i.before, x.s) AS s, i.s AS e FROM inside i JOIN inner_ x ON x.q = i.q UNION ALL SELECT i.q, max(i.e), x.e FROM inside i JOIN inner_ x ON x.q = i.q GROUP BY i.q, x.e UNION ALL SELECT q, s, e FROM inner_ WHERE q NOT IN (SELECT q FROM free)) WHERE s < e)
"""


A_FREE = f"WITH RECURSIVE {A_SQL}, {TREE_SQL}, {free_sql(fx.A_START, fx.A_END)}"
B_FREE = f"WITH RECURSIVE {B_SQL}, {TREE_SQL}, {free_sql(fx.B_START, fx.B_END)}"
FREE = 'SELECT resource_id, s AS start, e AS "end" FROM free'

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def a(spark: SparkSession, sf_dir: str) -> Schedule:
    return fx.calendar(spark, sf_dir)


def _listed(ids: list[str]) -> str:
    return ", ".join(f"'{i}'" for i in ids)


def merged_sql(source: str, keys: str, condition: str) -> str:
    """Maximal runs of the segments between the endpoints of ``source (keys, s, e)`` where ``condition`` on n, the spans that cover one, holds."""
    on = " AND ".join(f"x.{k} = g.{k}" for k in keys.split(", "))
    return f"""
cut AS (SELECT DISTINCT {keys}, unnest([s, e]) AS t FROM {source}),
seg AS (SELECT {keys}, t AS s, lead(t) OVER (PARTITION BY {keys} ORDER BY t) AS e FROM cut),
hit AS (SELECT *, lag(e) OVER (PARTITION BY {keys} ORDER BY s) AS before FROM (SELECT g.*, (SELECT count(*) FROM {source} x WHERE {on} AND x.s <= g.s AND x.e >= g.e) AS n FROM seg g WHERE g.e IS NOT NULL) WHERE {condition}),
run AS (SELECT {keys}, min(s) AS start, max(e) AS "end" FROM (SELECT *, sum(CASE WHEN before = s THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY s) AS g FROM hit) GROUP BY {keys}, g)
"""


# ---------------------------------------------------------------- listings


@query("list_resources", f"WITH {A_SQL} SELECT id, parent_id, capacity, buffer_after FROM resources")
def _(spark, d):
    return a(spark, d).resources.select("id", "parent_id", "capacity", "buffer_after")


@query("list_roots", f"WITH {A_SQL} SELECT id, capacity, buffer_after FROM resources WHERE parent_id IS NULL")
def _(spark, d):
    return listings.roots(a(spark, d)).select("id", "capacity", "buffer_after")


@query("list_children", f"WITH {A_SQL} SELECT id, parent_id, capacity, buffer_after FROM resources WHERE parent_id = '{TEAM}'")
def _(spark, d):
    return listings.children(a(spark, d), TEAM).select("id", "parent_id", "capacity", "buffer_after")


@query("list_rules", f"WITH {A_SQL} SELECT id, resource_id, s AS start, e AS \"end\", blocking FROM rules WHERE resource_id = '{USER}'")
def _(spark, d):
    return listings.rules_of(a(spark, d), USER)


@query("list_bookings_multi", f"WITH {A_SQL} SELECT id, resource_id, s AS start, e AS \"end\", label FROM bookings WHERE resource_id IN ({_listed(SOME)})")
def _(spark, d):
    return listings.bookings_of(a(spark, d), SOME)


@query("list_holds_multi", f"WITH {A_SQL} SELECT id, resource_id, s AS start, e AS \"end\", expires_at FROM holds WHERE resource_id IN ({_listed(SOME)})")
def _(spark, d):
    return listings.holds_of(a(spark, d), SOME)


@query("hold_liveness", f"WITH {A_SQL} SELECT id, resource_id, expires_at FROM live")
def _(spark, d):
    return listings.live_holds(a(spark, d)).select("id", "resource_id", "expires_at")


@query("earliest_hold_expiry", f"WITH {A_SQL} SELECT resource_id, min(expires_at) AS expires_at FROM live GROUP BY ALL")
def _(spark, d):
    return listings.earliest_expiry(a(spark, d))


@query("interval_counts", f"WITH {A_SQL} SELECT resource_id, count(*) AS n, min(s) AS first, max(e) AS last FROM (SELECT resource_id, s, e FROM rules UNION ALL SELECT resource_id, s, e FROM holds UNION ALL SELECT resource_id, s, e FROM bookings) GROUP BY ALL")
def _(spark, d):
    return listings.interval_counts(a(spark, d))


@query("all_intervals", f"WITH {A_SQL} SELECT id, resource_id, s AS start, e AS \"end\", CASE WHEN blocking THEN 'blocked' ELSE 'open' END AS kind, CAST(NULL AS BIGINT) AS expires_at FROM rules UNION ALL SELECT id, resource_id, s, e, 'hold', expires_at FROM holds UNION ALL SELECT id, resource_id, s, e, 'booking', NULL FROM bookings")
def _(spark, d):
    return a(spark, d).intervals().drop("label")


# ---------------------------------------------------------------- tree


@query("resource_closure", f"WITH RECURSIVE {A_SQL}, {TREE_SQL} SELECT id, ancestor_id, depth FROM tree")
def _(spark, d):
    return hierarchy.closure(a(spark, d).resources)


@query("resource_depth", f"WITH RECURSIVE {B_SQL}, {TREE_SQL} SELECT id, max(depth) AS depth FROM tree GROUP BY ALL")
def _(spark, d):
    return hierarchy.depths(hierarchy.closure(fx.dispatch(spark, d).resources))


@query("has_children", f"WITH {B_SQL} SELECT DISTINCT parent_id AS id FROM resources WHERE parent_id IS NOT NULL")
def _(spark, d):
    return hierarchy.has_children(fx.dispatch(spark, d).resources).select("id")


@query("inherited_rules", f"{A_FREE} SELECT resource_id, s AS start, e AS \"end\", blocking FROM opens UNION ALL SELECT resource_id, s, e, blocking FROM blocks")
def _(spark, d):
    s = a(spark, d)
    return av.inherited_rules(s.rules, hierarchy.closure(s.resources), fx.A_START, fx.A_END)


# ---------------------------------------------------------------- spans


@query("merge_overlapping", f"WITH {B_SQL}, {merged_sql('bookings', 'resource_id', 'n > 0')} SELECT * FROM run")
def _(spark, d):
    return sweep.merge_overlapping(fx.dispatch(spark, d).bookings)


@query("subtract_intervals", f"""WITH {A_SQL}, base AS (SELECT resource_id, s, e FROM rules WHERE NOT blocking), cutter AS (SELECT resource_id, s, e FROM rules WHERE blocking UNION ALL SELECT resource_id, s, e FROM bookings), source AS (SELECT * FROM base UNION ALL SELECT * FROM cutter),
{merged_sql('source', 'resource_id', '(SELECT count(*) FROM cutter c WHERE c.resource_id = hit_.resource_id AND c.s <= hit_.s AND c.e >= hit_.e) = 0 AND (SELECT count(*) FROM base c WHERE c.resource_id = hit_.resource_id AND c.s <= hit_.s AND c.e >= hit_.e) > 0').replace('AS n FROM seg g WHERE g.e IS NOT NULL) WHERE', 'AS n FROM seg g WHERE g.e IS NOT NULL) hit_ WHERE')} SELECT * FROM run""")
def _(spark, d):
    s = a(spark, d)
    cut = s.rules.where("blocking").select("resource_id", "start", "end").unionByName(s.bookings.select("resource_id", "start", "end"))
    return sweep.subtract_intervals(s.rules.where("not blocking"), cut)


@query("saturated_spans", f"WITH {B_SQL}, source AS (SELECT b.*, r.capacity FROM bookings b JOIN resources r ON r.id = b.resource_id), {merged_sql('source', 'resource_id', 'n >= (SELECT max(capacity) FROM source y WHERE y.resource_id = hit_.resource_id)').replace('g.e IS NOT NULL) WHERE', 'g.e IS NOT NULL) hit_ WHERE')} SELECT * FROM run")
def _(spark, d):
    s = fx.dispatch(spark, d)
    return sweep.saturated_spans(s.bookings.join(s.resources.select(F.col("id").alias("resource_id"), "capacity"), "resource_id"))


@query("span_overlap_join", f"WITH {A_SQL} SELECT q.resource_id, q.id AS a_id, q.s AS a_start, q.e AS a_end, b.id AS b_id, b.s AS b_start, b.e AS b_end FROM requests q JOIN bookings b ON b.resource_id = q.resource_id AND q.s < b.e AND b.s < q.e")
def _(spark, d):
    pick = lambda rows, p: rows.select("resource_id", F.col("id").alias(f"{p}_id"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"))
    return conflict.overlap_pairs(pick(fx.candidates_a(spark, d), "a"), pick(a(spark, d).bookings, "b"))


@query("span_predicates", f"WITH {A_SQL} SELECT id, s <= 1705276800000 AND 1705276800000 < e AS has_now, s < 1705363200000 AND 1705276800000 < e AS meets_day, 1705276800000 <= s AND e <= 1705363200000 AS in_day, e - s AS ms, greatest(s - 1705276800000, 0) AS since FROM bookings")
def _(spark, d):
    n, m = fx.A_NOW, fx.A_NOW + fx.DAY
    return a(spark, d).bookings.select("id", spans.contains_instant("start", "end", n).alias("has_now"), spans.overlaps("start", "end", n, m).alias("meets_day"), spans.contains_span(n, m, "start", "end").alias("in_day"), spans.duration().alias("ms"), spans.minus("start", n).alias("since"))


@query("parsed_values", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN lpad(CAST(event_id AS VARCHAR), 26, '0') END AS ulid, CASE WHEN event_id % 2 = 0 THEN -event_id END AS number, event_id % 4 <> 0 AS flag, CASE WHEN event_id % 3 = 0 THEN lpad(CAST(event_id AS VARCHAR), 26, '0') END AS of FROM events")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id")
    text = F.expr("case when event_id % 3 = 0 then lpad(cast(event_id as string), 26, '0') else concat('x', event_id) end")
    number = F.expr("case when event_id % 2 = 0 then concat('-', event_id) else concat(event_id, 'x') end")
    flag = F.expr("element_at(array('0.0', 't', 'TRUE', '7'), cast(event_id % 4 as int) + 1)")
    return rows.select("event_id", spans.parse_ulid(text).alias("ulid"), spans.parse_long(number).alias("number"), spans.parse_bool(flag).alias("flag"), spans.channel_resource(F.concat(F.lit("resource_"), text)).alias("of"))


# ---------------------------------------------------------------- free time


@query("availability_flat", f"""WITH {B_SQL}, day AS (SELECT id AS resource_id, {fx.B_START} AS s, {fx.B_START + 30 * fx.DAY} AS e FROM resources), taken AS (SELECT resource_id, greatest(s, {fx.B_START}) AS s, least(e, {fx.B_START + 30 * fx.DAY}) AS e FROM bookings WHERE s < {fx.B_START + 30 * fx.DAY} AND e > {fx.B_START}),
source AS (SELECT * FROM day UNION ALL SELECT * FROM taken), {merged_sql('source', 'resource_id', 'n = 1')} SELECT * FROM run""")
def _(spark, d):
    """The complement of the bookings in a window."""
    s, end = fx.dispatch(spark, d), fx.B_START + 30 * fx.DAY
    window = s.resources.select(F.col("id").alias("resource_id"), F.lit(fx.B_START).alias("start"), F.lit(end).alias("end"))
    taken = s.bookings.where(spans.overlaps("start", "end", fx.B_START, end)).select("resource_id", F.greatest("start", F.lit(fx.B_START)).alias("start"), F.least("end", F.lit(end)).alias("end"))
    return sweep.subtract_intervals(window, taken)


@query("availability_inherited", f"{A_FREE} {FREE}")
def _(spark, d):
    return av.availability(a(spark, d), fx.A_START, fx.A_END)


@query("availability_capacity", f"{B_FREE} {FREE}")
def _(spark, d):
    return av.availability(fx.dispatch(spark, d), fx.B_START, fx.B_END)


@query("availability_single", f"{A_FREE} {FREE} WHERE resource_id = '{USER}'")
def _(spark, d):
    return av.availability(a(spark, d), fx.A_START, fx.A_END, ids=[USER])


@query("availability_per_resource", f"{A_FREE} {FREE} WHERE resource_id IN ({_listed(SOME)})")
def _(spark, d):
    return av.availability(a(spark, d), fx.A_START, fx.A_END, ids=SOME)


@query("availability_min_duration", f"{A_FREE} {FREE} WHERE e - s >= 14400000")
def _(spark, d):
    return av.availability(a(spark, d), fx.A_START, fx.A_END, min_duration=14_400_000)


@query("availability_buffer", f"WITH RECURSIVE {A_SQL}, {TREE_SQL}, {free_sql(fx.A_NOW, fx.A_NOW + 3_600_000)} {FREE}")
def _(spark, d):
    """A window of one hour, into which earlier allocations reach by their buffers alone."""
    return av.availability(a(spark, d), fx.A_NOW, fx.A_NOW + 3_600_000)


def _per_nation(k: str) -> str:
    return f"{B_FREE}, req AS (SELECT parent_id AS query_id, id AS resource_id FROM resources WHERE parent_id IN (SELECT id FROM resources WHERE parent_id IS NOT NULL)), kn AS (SELECT query_id, count(*) AS n FROM req GROUP BY ALL), source AS (SELECT q.query_id, f.s, f.e FROM free f JOIN req q ON q.resource_id = f.resource_id), {merged_sql('source', 'query_id', f'n >= (SELECT {k} FROM kn y WHERE y.query_id = hit_.query_id)').replace('g.e IS NOT NULL) WHERE', 'g.e IS NOT NULL) hit_ WHERE')} SELECT * FROM run"


def _nations(spark: SparkSession, d: str, k) -> DataFrame:
    s = fx.dispatch(spark, d)
    inner = s.resources.where("parent_id is not null").select(F.col("id").alias("query_id"))
    requests = s.resources.select(F.col("parent_id").alias("query_id"), F.col("id").alias("resource_id")).join(inner, "query_id")
    number = requests.groupBy("query_id").agg(F.count("*").alias("n")).withColumn("k", k)
    return av.k_of_n(av.availability(s, fx.B_START, fx.B_END), requests.join(number, "query_id"))


@query("k_of_n_threshold", _per_nation("2"))
def _(spark, d):
    return _nations(spark, d, F.lit(2).cast("bigint"))


@query("k_of_n_union", _per_nation("1"))
def _(spark, d):
    return _nations(spark, d, F.lit(1).cast("bigint"))


@query("k_of_n_intersection", _per_nation("n"))
def _(spark, d):
    return _nations(spark, d, F.col("n"))


TWICE = [SOME[0], SOME[1], SOME[0], SOME[3]]


@query("merged_availability", f"{A_FREE}, source AS (SELECT 'q' AS q, f.s, f.e FROM free f JOIN (SELECT unnest([{_listed(TWICE)}]) AS id) i ON i.id = f.resource_id), {merged_sql('source', 'q', 'n >= 2')} SELECT start, \"end\" FROM run WHERE \"end\" - start >= 1800000")
def _(spark, d):
    """Two of four named resources, one of them named twice, for half an hour at least."""
    return av.merged_availability(a(spark, d), TWICE, 2, fx.A_START, fx.A_END, 1_800_000)


@query("utilisation", f"{A_FREE} SELECT resource_id, CAST(sum(e - s) AS BIGINT) AS open_ms, CAST(sum(CASE WHEN n_active > 0 THEN e - s ELSE 0 END) AS BIGINT) AS busy_ms FROM state WHERE n_open > 0 AND n_blocked = 0 GROUP BY ALL")
def _(spark, d):
    return av.utilisation(a(spark, d), fx.A_START, fx.A_END)


@query("remaining_capacity", f"{A_FREE} SELECT resource_id, s AS start, e AS \"end\", greatest(capacity - n_active, 0) AS remaining FROM state WHERE n_open > 0 AND n_blocked = 0")
def _(spark, d):
    return av.remaining_capacity(a(spark, d), fx.A_START, fx.A_END)


@query("rollup_free_units", f"{A_FREE} SELECT r.parent_id, CAST(count(f.resource_id) AS BIGINT) AS free, count(*) AS units FROM resources r LEFT JOIN free f ON f.resource_id = r.id AND f.s <= {fx.A_NOW} AND f.e > {fx.A_NOW} WHERE r.parent_id IS NOT NULL GROUP BY ALL")
def _(spark, d):
    s = a(spark, d)
    return av.free_units(av.availability(s, fx.A_START, fx.A_END), s.resources, fx.A_NOW)


# ---------------------------------------------------------------- conflicts

WHAT_IF = f"""WITH {A_SQL}, allocs AS (SELECT a.id, a.resource_id, a.s, a.e + coalesce(r.buffer_after, 0) AS e FROM (SELECT id, resource_id, s, e FROM bookings UNION ALL SELECT id, resource_id, s, e FROM live) a JOIN resources r ON r.id = a.resource_id),
foot AS (SELECT q.id, q.resource_id, q.s, q.e + coalesce(r.buffer_after, 0) AS e, r.capacity FROM requests q JOIN resources r ON r.id = q.resource_id),
points AS (SELECT f.*, f.s AS t FROM foot f UNION ALL SELECT f.*, a.s FROM foot f JOIN allocs a ON a.resource_id = f.resource_id AND a.s > f.s AND a.s < f.e),
peaks AS (SELECT id, max(n) AS peak FROM (SELECT p.id, (SELECT count(*) FROM allocs a WHERE a.resource_id = p.resource_id AND a.s <= p.t AND a.e > p.t) AS n FROM points p) GROUP BY ALL)"""


@query("conflict_what_if", f"""{WHAT_IF} SELECT f.id, f.resource_id, p.peak, CASE WHEN p.peak >= greatest(f.capacity, 1) THEN CASE WHEN f.capacity <= 1 THEN 'Conflict: ' || (SELECT min_by(a.id, a.s) FROM allocs a WHERE a.resource_id = f.resource_id AND a.s < f.e AND f.s < a.e) ELSE 'CapacityExceeded: ' || f.capacity END END AS error FROM foot f JOIN peaks p ON p.id = f.id""")
def _(spark, d):
    return conflict.what_if(a(spark, d), fx.candidates_a(spark, d))


@query("validated_requests", f"WITH {A_SQL} SELECT id, CASE WHEN e - s > 3000000 THEN 'LimitExceeded: span too wide' END AS error FROM requests")
def _(spark, d):
    return conflict.validated(fx.candidates_a(spark, d), Limits(span_ms=3_000_000)).select("id", "error")


@query("rule_coverage", f"""WITH RECURSIVE {A_SQL}, {TREE_SQL}, asked AS (SELECT id, resource_id, s, e FROM rules WHERE NOT blocking), {uncovered_sql('asked')}
SELECT g.id, a.resource_id, g.s AS start, g.e AS "end" FROM gaps g JOIN asked a ON a.id = g.id""")
def _(spark, d):
    """Every open rule against its parent's free time in the rule's own span."""
    s = a(spark, d)
    return conflict.uncovered_rules(s, s.rules)


@query("availability_each", f"WITH RECURSIVE {A_SQL}, {TREE_SQL}, req AS (SELECT id AS q, resource_id AS rid, s - 10800000 AS s, e + 10800000 AS e FROM requests), {free_each_sql('req')} SELECT q AS query_id, s AS start, e AS \"end\" FROM free")
def _(spark, d):
    """Free time around every requested span, each in a window of its own."""
    asked = fx.candidates_a(spark, d).select(F.col("id").alias("query_id"), "resource_id", (F.col("start") - 10_800_000).alias("start"), (F.col("end") + 10_800_000).alias("end"))
    return av.availability_of(a(spark, d), asked)


def admitted_sql(requests: str) -> str:
    """``step (id, admitted, error, ...)``: requests ``(id, resource_id, s, e, ghost)`` in the order of their ids, one after another in each resource."""
    return f"""
allocs AS (SELECT a.id, a.resource_id, a.s, a.e + coalesce(r.buffer_after, 0) AS e FROM (SELECT id, resource_id, s, e FROM bookings UNION ALL SELECT id, resource_id, s, e FROM live) a JOIN resources r ON r.id = a.resource_id),
line AS (SELECT q.id, q.resource_id, q.s, q.e + coalesce(r.buffer_after, 0) AS e, q.ghost, r.capacity, row_number() OVER (PARTITION BY q.resource_id ORDER BY q.id) AS n FROM {requests} q JOIN resources r ON r.id = q.resource_id),
base AS (SELECT resource_id, list({{'s': s, 'id': id, 'e': e}}) AS held FROM allocs GROUP BY resource_id),
step AS (
  SELECT l.resource_id, 0::BIGINT AS n, coalesce(b.held, []) AS held, NULL::VARCHAR AS id, NULL::BOOLEAN AS admitted, NULL::VARCHAR AS error FROM (SELECT DISTINCT resource_id FROM line) l LEFT JOIN base b ON b.resource_id = l.resource_id
  UNION ALL
  SELECT resource_id, n, CASE WHEN peak >= greatest(capacity, 1) OR ghost THEN held ELSE list_append(held, {{'s': s, 'id': id, 'e': e}}) END, id, peak < greatest(capacity, 1), CASE WHEN peak >= greatest(capacity, 1) THEN CASE WHEN capacity <= 1 THEN 'Conflict: ' || list_sort(met)[1].id ELSE 'CapacityExceeded: ' || capacity END END
  FROM (SELECT *, list_max(list_transform(list_append(list_transform(met, lambda x: greatest(x.s, s)), s), lambda t: len(list_filter(met, lambda y: y.s <= t AND y.e > t)))) AS peak
    FROM (SELECT l.*, p.held, list_filter(p.held, lambda x: x.s < l.e AND x.e > l.s) AS met FROM step p JOIN line l ON l.resource_id = p.resource_id AND l.n = p.n + 1)))
"""


@query("admission", f"WITH RECURSIVE {A_SQL}, asked AS (SELECT *, FALSE AS ghost FROM requests), {admitted_sql('asked')} SELECT id, admitted, error FROM step WHERE n > 0")
def _(spark, d):
    """Requests in the order of their ids, each after those before it."""
    return admission.admit(a(spark, d), fx.candidates_a(spark, d).withColumn("seq", F.col("id").cast("bigint")))


BATCHED = "lpad(CAST(CAST(id AS BIGINT) // 40 AS VARCHAR), 12, '0')"


@query("batch_admission", f"""{WHAT_IF}, member AS (SELECT *, {BATCHED} AS batch_id FROM foot), alone AS (SELECT m.batch_id, CASE WHEN m.capacity <= 1 THEN 'Conflict: ' || (SELECT min_by(a.id, a.s) FROM allocs a WHERE a.resource_id = m.resource_id AND a.s < m.e AND m.s < a.e) ELSE 'CapacityExceeded: ' || m.capacity END AS error FROM member m JOIN peaks p ON p.id = m.id WHERE p.peak >= greatest(m.capacity, 1)),
bounds AS (SELECT batch_id, resource_id, min(s) AS lo, max(e) AS hi, count(*) AS n FROM member GROUP BY ALL HAVING count(*) > 1),
load AS (SELECT m.batch_id, m.resource_id, m.s, m.e FROM member m JOIN bounds b ON b.batch_id = m.batch_id AND b.resource_id = m.resource_id UNION ALL SELECT b.batch_id, b.resource_id, a.s, a.e FROM bounds b JOIN resources r ON r.id = b.resource_id AND r.capacity > 1 JOIN allocs a ON a.resource_id = b.resource_id AND a.s < b.hi AND a.e > greatest(b.lo - coalesce(r.buffer_after, 0), 0)),
most AS (SELECT batch_id, resource_id, max(n) AS n FROM (SELECT l.*, (SELECT count(*) FROM load k WHERE k.batch_id = l.batch_id AND k.resource_id = l.resource_id AND k.s <= l.s AND k.e > l.s) AS n FROM load l) GROUP BY ALL),
together AS (SELECT m.batch_id, CASE WHEN r.capacity <= 1 THEN 'Conflict' ELSE 'CapacityExceeded: ' || r.capacity END AS error FROM most m JOIN resources r ON r.id = m.resource_id WHERE m.n > greatest(r.capacity, 1))
SELECT b.batch_id, min(x.error) AS error FROM (SELECT DISTINCT batch_id FROM member) b LEFT JOIN (SELECT * FROM alone UNION ALL SELECT * FROM together) x ON x.batch_id = b.batch_id GROUP BY b.batch_id""")
def _(spark, d):
    rows = fx.candidates_a(spark, d).withColumn("batch_id", F.expr("lpad(cast(cast(id as bigint) div 40 as string), 12, '0')"))
    return admission.batch_what_if(a(spark, d), rows)


@query("commit_holds", f"""{WHAT_IF}, asked AS (SELECT 'c' || h.id AS id, h.id AS hold_id, h.resource_id, h.s, h.e + coalesce(r.buffer_after, 0) AS e, r.capacity FROM holds h JOIN resources r ON r.id = h.resource_id),
pts AS (SELECT q.*, q.s AS t FROM asked q UNION ALL SELECT q.*, a.s FROM asked q JOIN allocs a ON a.resource_id = q.resource_id AND a.s > q.s AND a.s < q.e AND a.id <> q.hold_id),
top AS (SELECT id, max(n) AS peak FROM (SELECT p.id, (SELECT count(*) FROM allocs a WHERE a.resource_id = p.resource_id AND a.s <= p.t AND a.e > p.t AND a.id <> p.hold_id) AS n FROM pts p) GROUP BY ALL)
SELECT q.id, q.hold_id, CASE WHEN t.peak >= greatest(q.capacity, 1) THEN CASE WHEN q.capacity <= 1 THEN 'Conflict: ' || (SELECT min_by(a.id, a.s) FROM allocs a WHERE a.resource_id = q.resource_id AND a.s < q.e AND q.s < a.e AND a.id <> q.hold_id) ELSE 'CapacityExceeded: ' || q.capacity END END AS error FROM asked q JOIN top t ON t.id = q.id""")
def _(spark, d):
    s = a(spark, d)
    return admission.commit_holds(s, s.holds.select(F.concat(F.lit("c"), "id").alias("id"), F.col("id").alias("hold_id"), F.lit("x").alias("label")))


# ---------------------------------------------------------------- changes


@query("place_holds", f"WITH RECURSIVE {A_SQL}, asked AS (SELECT *, CAST(id AS BIGINT) % 3 = 0 AS ghost FROM requests), {admitted_sql('asked')} SELECT id, admitted, error FROM step WHERE n > 0")
def _(spark, d):
    """Holds in the order of their ids; a third has expired when it is placed and stands in nobody's way."""
    n = F.col("id").cast("bigint")
    return admission.admit(a(spark, d), fx.candidates_a(spark, d).withColumns({"seq": n, "expires_at": F.when(n % 3 == 0, fx.A_NOW).otherwise(fx.A_NOW + 1)}))


NEW = """
asked AS (SELECT c_custkey AS seq, lpad(CAST(CASE WHEN c_custkey % 7 = 0 THEN 100000 + c_custkey WHEN c_custkey % 3 = 0 THEN 599999 + c_custkey ELSE 600000 + c_custkey END AS VARCHAR), 26, '0') AS id,
  CASE c_custkey % 6 WHEN 1 THEN lpad('1', 26, '0') WHEN 2 THEN lpad(CAST(1000 + c_custkey % 20 AS VARCHAR), 26, '0') WHEN 3 THEN lpad(CAST(599995 + c_custkey AS VARCHAR), 26, '0') WHEN 4 THEN lpad(CAST(600002 + c_custkey AS VARCHAR), 26, '0')
    WHEN 5 THEN lpad(CAST(CASE WHEN c_custkey % 7 = 0 THEN 100000 + c_custkey WHEN c_custkey % 3 = 0 THEN 599999 + c_custkey ELSE 600000 + c_custkey END AS VARCHAR), 26, '0') END AS parent_id,
  CASE WHEN c_custkey % 50 = 0 THEN repeat('x', 1001) ELSE 'r' END AS name, CASE WHEN c_custkey % 40 = 1 THEN -5 ELSE 1000 END AS buffer_after FROM customer)"""


@query("create_resources", f"""WITH RECURSIVE {A_SQL}, {TREE_SQL}, {NEW}, line AS (SELECT a.*, row_number() OVER (ORDER BY seq) AS n, o.d AS own, p.d AS above FROM asked a LEFT JOIN (SELECT id, max(depth) AS d FROM tree GROUP BY id) o ON o.id = a.id LEFT JOIN (SELECT id, max(depth) AS d FROM tree GROUP BY id) p ON p.id = a.parent_id),
step AS (
  SELECT 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS id, NULL::VARCHAR AS error, []::VARCHAR[] AS made, (SELECT count(*) FROM resources) AS total
  UNION ALL
  SELECT n, seq, id, error, CASE WHEN error IS NULL THEN list_append(made, id) ELSE made END, total + CASE WHEN error IS NULL THEN 1 ELSE 0 END
  FROM (SELECT l.n, l.seq, l.id, p.made, p.total, CASE WHEN p.total >= 600 THEN 'LimitExceeded: too many resources' WHEN l.buffer_after < 0 THEN 'LimitExceeded: buffer out of range' WHEN length(l.name) > 1000 THEN 'LimitExceeded: resource name too long'
      WHEN l.own IS NOT NULL OR list_contains(p.made, l.id) THEN 'AlreadyExists' WHEN l.parent_id = l.id THEN 'CycleDetected' WHEN l.parent_id IS NOT NULL AND l.above IS NULL AND NOT list_contains(p.made, l.parent_id) THEN 'NotFound' END AS error
    FROM step p JOIN line l ON l.n = p.n + 1))
SELECT seq, id, error FROM step WHERE n > 0""")
def _(spark, d):
    """New resources, some of them below others of the same requests, repeated, or with faults; there is room for 600 in all."""
    n = F.col("seq")
    own = F.when(n % 7 == 0, n + 100_000).when(n % 3 == 0, n + 599_999).otherwise(n + 600_000)
    parent = F.when(n % 6 == 1, F.lit(1)).when(n % 6 == 2, n % 20 + 1000).when(n % 6 == 3, n + 599_995).when(n % 6 == 4, n + 600_002).when(n % 6 == 5, own)
    asked = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("bigint").alias("seq"))
    asked = asked.select("seq", fx.ident(own).alias("id"), fx.ident(parent).alias("parent_id"), F.when(n % 50 == 0, F.repeat(F.lit("x"), 1001)).otherwise("r").alias("name"), F.lit(1).cast("bigint").alias("capacity"), F.when(n % 40 == 1, -5).otherwise(1000).cast("bigint").alias("buffer_after"))
    return mutations.create_resources(a(spark, d), asked, Limits(resources=600))


@query("update_resources", f"WITH {A_SQL} SELECT c_custkey AS seq, lpad(CAST(100000 + c_custkey AS VARCHAR), 26, '0') AS id, CASE WHEN c_custkey % 4 = 1 AND c_custkey % 9 = 0 THEN 'LimitExceeded: buffer out of range' WHEN 100000 + c_custkey NOT IN (SELECT CAST(id AS BIGINT) FROM resources) THEN 'NotFound' END AS error FROM customer")
def _(spark, d):
    """Partial updates: of a wrong buffer only those that set it are refused."""
    n = F.col("seq")
    asked = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("bigint").alias("seq"))
    asked = asked.select("seq", fx.ident(n + 100_000).alias("id"), (n % 3 == 0).alias("set_name"), F.lit("new").alias("name"), F.lit(True).alias("set_capacity"), F.lit(2).cast("bigint").alias("capacity"), (n % 4 == 1).alias("set_buffer"), F.when(n % 9 == 0, -1).otherwise(5).cast("bigint").alias("buffer_after"))
    return mutations.update_resources(a(spark, d), asked)


@query("delete_resources", f"""WITH {B_SQL}, sup AS (SELECT id, parent_id, CAST(id AS BIGINT) - 10000 AS k FROM resources WHERE CAST(id AS BIGINT) > 10000), nat AS (SELECT id, parent_id, CAST(id AS BIGINT) - 100 AS k FROM resources WHERE CAST(id AS BIGINT) BETWEEN 100 AND 10000), reg AS (SELECT id, CAST(id AS BIGINT) AS k FROM resources WHERE CAST(id AS BIGINT) < 100),
asked AS (SELECT k * 10 AS seq, id FROM sup WHERE CAST(parent_id AS BIGINT) % 3 <> 0 UNION ALL SELECT k * 10 + 5, id FROM sup WHERE k % 2 = 0 AND CAST(parent_id AS BIGINT) % 3 <> 0 UNION ALL SELECT 20 + k, id FROM nat UNION ALL SELECT 100000000 + k, id FROM nat UNION ALL SELECT 200000000 + k, id FROM reg UNION ALL SELECT 300000000, lpad('7', 26, '9')),
g1 AS (SELECT s.id, s.parent_id, min(a.seq) AS gone FROM sup s LEFT JOIN asked a ON a.id = s.id GROUP BY ALL),
n1 AS (SELECT n.id, n.parent_id, count(s.id) > count(s.gone) AS stuck, max(s.gone) AS after FROM nat n LEFT JOIN g1 s ON s.parent_id = n.id GROUP BY ALL),
g2 AS (SELECT n.id, n.parent_id, min(a.seq) AS gone FROM n1 n LEFT JOIN asked a ON a.id = n.id AND NOT n.stuck AND a.seq > coalesce(n.after, -1) GROUP BY ALL),
r1 AS (SELECT r.id, count(n.id) > count(n.gone) AS stuck, max(n.gone) AS after FROM reg r LEFT JOIN g2 n ON n.parent_id = r.id GROUP BY ALL),
g3 AS (SELECT r.id, min(a.seq) AS gone FROM r1 r LEFT JOIN asked a ON a.id = r.id AND NOT r.stuck AND a.seq > coalesce(r.after, -1) GROUP BY ALL),
gone AS (SELECT id, gone FROM g1 UNION ALL SELECT id, gone FROM g2 UNION ALL SELECT id, gone FROM g3)
SELECT a.seq, a.id, CASE WHEN g.id IS NULL OR g.gone < a.seq THEN 'NotFound' WHEN g.gone IS NULL OR g.gone > a.seq THEN 'HasChildren' END AS error FROM asked a LEFT JOIN gone g ON g.id = a.id""")
def _(spark, d):
    """Suppliers of some nations, then nations, then regions; each nation is also asked for early, and some suppliers twice."""
    s, k = fx.dispatch(spark, d), F.col("id").cast("bigint")
    sup = s.resources.where(k > 10_000).where(F.col("parent_id").cast("bigint") % 3 != 0)
    nat, reg = s.resources.where(k.between(100, 10_000)), s.resources.where(k < 100)
    parts = [sup.select(((k - 10_000) * 10).alias("seq"), "id"), sup.where(k % 2 == 0).select(((k - 10_000) * 10 + 5).alias("seq"), "id"), nat.select((k - 80).alias("seq"), "id"), nat.select((k + 99_999_900).alias("seq"), "id"), reg.select((k + 200_000_000).alias("seq"), "id")]
    asked = spark.range(1).select(F.lit(300_000_000).cast("bigint").alias("seq"), F.lit("9" * 25 + "7").alias("id"))
    for part in parts:
        asked = asked.unionByName(part)
    return mutations.delete_resources(s, asked)


RULES_ASKED = "asked AS (SELECT event_id AS seq, lpad(CAST(30000000000 + event_id AS VARCHAR), 26, '0') AS id, CASE WHEN event_id % 60 = 11 THEN lpad('999', 26, '0') WHEN event_id % 4 = 0 THEN lpad(CAST(1000 + t AS VARCHAR), 26, '0') ELSE rid END AS resource_id, ms AS s, CASE WHEN event_id % 50 = 7 THEN ms ELSE ms + CAST(1 + floor(value) AS BIGINT) * 600000 END AS e, event_id % 3 = 0 AS blocking FROM ev WHERE event_type = 'signup')"


@query("add_rules", f"""WITH RECURSIVE {A_SQL}, {TREE_SQL}, {RULES_ASKED}, good AS (SELECT a.* FROM asked a JOIN resources r ON r.id = a.resource_id WHERE a.s < a.e), opening AS (SELECT * FROM good WHERE NOT blocking), {uncovered_sql('opening')},
have AS (SELECT resource_id, count(*) AS n FROM (SELECT resource_id FROM rules UNION ALL SELECT resource_id FROM holds UNION ALL SELECT resource_id FROM bookings) GROUP BY ALL),
ok AS (SELECT g.seq, g.id, coalesce(h.n, 0) + row_number() OVER (PARTITION BY g.resource_id ORDER BY g.seq) - 1 AS before FROM good g LEFT JOIN have h ON h.resource_id = g.resource_id WHERE g.id NOT IN (SELECT id FROM gaps))
SELECT a.seq, a.id, CASE WHEN a.s >= a.e THEN 'InvalidSpan' WHEN g.id IS NULL THEN 'NotFound' WHEN a.id IN (SELECT id FROM gaps) THEN 'NotCoveredByParent' WHEN k.before >= 45 THEN 'LimitExceeded: too many intervals on resource' END AS error FROM asked a LEFT JOIN good g ON g.id = a.id LEFT JOIN ok k ON k.id = a.id""")
def _(spark, d):
    """New rules of users and teams, open and blocking, with at most 45 intervals on a resource."""
    n = F.col("event_id")
    rows = fx.events_a(spark, d).where("event_type = 'signup'")
    to = F.when(n % 60 == 11, fx.ident(999)).when(n % 4 == 0, fx.ident(F.floor(F.col("user_id") / 10) + 1000)).otherwise(F.col("resource_id"))
    end = F.when(n % 50 == 7, F.col("start")).otherwise(F.col("start") + (F.floor("value") + 1) * 600_000)
    asked = rows.select(n.cast("bigint").alias("seq"), fx.ident(n + 30_000_000_000).alias("id"), to.alias("resource_id"), "start", end.alias("end"), (n % 3 == 0).alias("blocking"))
    return mutations.add_rules(a(spark, d), asked, Limits(intervals=45))


@query("update_rules", f"""WITH RECURSIVE {A_SQL}, {TREE_SQL}, every AS (SELECT id, resource_id, s, e, TRUE AS is_rule FROM rules UNION ALL SELECT id, resource_id, s, e, FALSE FROM bookings),
line AS (SELECT CAST(id AS BIGINT) AS seq, id, resource_id, s + 3600000 AS s, e + 3600000 AS e, CAST(id AS BIGINT) % 2 = 0 AS blocking, is_rule FROM every WHERE CAST(id AS BIGINT) % 3 <> 0 UNION ALL SELECT 7, lpad('7', 26, '9'), NULL, 1, 2, FALSE, NULL), opening AS (SELECT id, resource_id, s, e FROM line WHERE NOT blocking AND resource_id IS NOT NULL), {uncovered_sql('opening')}
SELECT seq, id, resource_id, CASE WHEN resource_id IS NULL THEN 'NotFound' WHEN id IN (SELECT id FROM gaps) THEN 'NotCoveredByParent' WHEN NOT is_rule THEN 'NotFound' END AS error FROM line""")
def _(spark, d):
    """Rules, and bookings taken for rules, moved by an hour."""
    s, n = a(spark, d), F.col("id").cast("bigint")
    rows = s.rules.select("id", "resource_id", "start", "end").unionByName(s.bookings.select("id", "resource_id", "start", "end")).where(n % 3 != 0)
    asked = rows.select(n.alias("seq"), "id", "resource_id", (F.col("start") + 3_600_000).alias("start"), (F.col("end") + 3_600_000).alias("end"), (n % 2 == 0).alias("blocking"))
    one = spark.range(1).select(F.lit(7).cast("bigint").alias("seq"), F.lit("9" * 25 + "7").alias("id"), F.lit(None).cast("string").alias("resource_id"), F.lit(1).cast("bigint").alias("start"), F.lit(2).cast("bigint").alias("end"), F.lit(False).alias("blocking"))
    return mutations.update_rules(s, asked.unionByName(one))


def _removed(kind: str, table: str) -> None:
    sql = f"""WITH {A_SQL}, every AS (SELECT id, resource_id, 'rule' AS kind FROM rules UNION ALL SELECT id, resource_id, 'hold' FROM holds UNION ALL SELECT id, resource_id, 'booking' FROM bookings),
asked AS (SELECT CAST(id AS BIGINT) AS seq, id FROM every WHERE CAST(id AS BIGINT) % 4 = 1 UNION ALL SELECT CAST(id AS BIGINT) + 50000000000, id FROM every WHERE CAST(id AS BIGINT) % 8 = 1)
SELECT a.seq, a.id, e.resource_id, CASE WHEN e.kind <> '{kind}' OR a.seq > CAST(a.id AS BIGINT) THEN 'NotFound' END AS error FROM asked a JOIN every e ON e.id = a.id"""

    @query(f"remove_{table}", sql)
    def _(spark, d):
        """Intervals of every kind, some of them twice."""
        s, n = a(spark, d), F.col("id").cast("bigint")
        ids = s.intervals().select("id").where(n % 4 == 1)
        return mutations.remove(s, ids.select(n.alias("seq"), "id").unionByName(ids.where(n % 8 == 1).select((n + 50_000_000_000).alias("seq"), "id")), kind)


for _kind, _table in (("rule", "rules"), ("hold", "holds"), ("booking", "bookings")):
    _removed(_kind, _table)


@query("change_events", f"""WITH {A_SQL} SELECT CAST(id AS BIGINT) + 5 AS seq, 'BookingCancelled' AS type, id, resource_id FROM bookings WHERE CAST(id AS BIGINT) % 4 = 1""")
def _(spark, d):
    """From requests to what enters the log."""
    s, n = a(spark, d), F.col("id").cast("bigint")
    asked = s.intervals().select("id").where(n % 4 == 1).select(n.alias("seq"), "id")
    return mutations.events_of("remove_booking", asked, mutations.remove(s, asked, "booking"), 5).select("seq", "type", "id", "resource_id")


@query("entity_lookup", f"WITH {A_SQL} SELECT id, resource_id, TRUE AS is_rule, FALSE AS is_hold, FALSE AS is_booking FROM rules WHERE CAST(id AS BIGINT) % 5 = 2 UNION ALL SELECT id, resource_id, FALSE, TRUE, FALSE FROM holds WHERE CAST(id AS BIGINT) % 5 = 2 UNION ALL SELECT id, resource_id, FALSE, FALSE, TRUE FROM bookings WHERE CAST(id AS BIGINT) % 5 = 2")
def _(spark, d):
    s = a(spark, d)
    return mutations.entities(s, s.intervals().select("id").where("cast(id as bigint) % 5 = 2"))


@query("long_stays", f"{B_FREE} {FREE} WHERE e - s >= 172800000")
def _(spark, d):
    """Two nights or more in one unit of a supplier, which its capacity makes possible while others come and go."""
    return av.availability(fx.dispatch(spark, d), fx.B_START, fx.B_END, min_duration=172_800_000)


@query("availability_clamped", f"WITH RECURSIVE {A_SQL}, {TREE_SQL}, {free_sql(0, 32_503_680_000_000)} {FREE}")
def _(spark, d):
    """A window beyond all times on both sides is cut to the times there are."""
    return av.availability(a(spark, d), -5, 1 << 60, limits=Limits(window_ms=None))


@query("scalar_values", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN NULL WHEN event_id % 4 = 2 THEN event_id END AS small, CASE WHEN event_id % 5 <> 0 THEN 'a-b_' || event_id END AS tenant, event_id % 4 < 2 AS rule, event_id % 4 > 1 AS allocation FROM events")
def _(spark, d):
    n = F.col("event_id")
    number = F.when(n % 4 == 0, F.lit("4294967296")).when(n % 4 == 1, F.concat(F.lit("-"), n + 1)).when(n % 4 == 2, F.concat(F.lit(" "), n))
    name = F.when(n % 5 == 0, F.lit("!. ")).otherwise(F.concat(F.lit("a-b_ !"), n))
    kind = F.element_at(F.array(*map(F.lit, ["open", "blocked", "hold", "booking"])), (n % 4 + 1).cast("int"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", spans.parse_u32(number).alias("small"), spans.tenant_name(name).alias("tenant"), spans.is_rule(kind).alias("rule"), spans.is_allocation(kind).alias("allocation"))


# ---------------------------------------------------------------- the log


def sample_log(spark: SparkSession, d: str) -> DataFrame:
    """A log that makes the calendar, with later changes: of some users the capacity or buffer, of some intervals the removal, of some users the deletion, and their creation anew."""
    s = a(spark, d)
    n = F.col("id").cast("bigint")
    user, made = n >= 100_000, s.resources
    rank = F.when(n == 1, 1).when(n < 100_000, n).otherwise(n)
    event = ev.event
    log = event("ResourceCreated", made, rank)
    log = log.unionByName(event("RuleAdded", s.rules, n + 10**9)).unionByName(event("HoldPlaced", s.holds, n + 10**9)).unionByName(event("BookingConfirmed", s.bookings, n + 10**9))
    later = 10**11
    log = log.unionByName(event("ResourceUpdated", made.where(user & (n % 5 == 1)), n + later, set_capacity=F.lit(True), capacity=F.lit(5)))
    log = log.unionByName(event("ResourceUpdated", made.where(user & (n % 7 == 2)), n + 2 * later, set_buffer=F.lit(True), buffer_after=F.lit(None)))
    log = log.unionByName(event("RuleUpdated", s.rules.where(n % 9 == 4), n + 2 * later, end=F.col("end") + 60_000, blocking=~F.col("blocking")))
    for kind, rows, k in (("RuleRemoved", s.rules, 6), ("HoldReleased", s.holds, 4), ("BookingCancelled", s.bookings, 8)):
        log = log.unionByName(event(kind, rows.where(n % k == 0).select("id", "resource_id"), n + 3 * later))
    log = log.unionByName(event("ResourceDeleted", made.where(user & (n % 11 == 3)).select("id"), n + 4 * later))
    return log.unionByName(event("ResourceCreated", made.where(user & (n % 22 == 3)), n + 5 * later))


FOLDED = f"""WITH {A_SQL}, num AS (SELECT *, CAST(id AS BIGINT) AS n FROM resources),
kept AS (SELECT id, parent_id, CASE WHEN n >= 100000 AND n % 5 = 1 AND NOT (n % 22 = 3) THEN 5 ELSE capacity END AS capacity, CASE WHEN n >= 100000 AND n % 7 = 2 AND NOT (n % 22 = 3) THEN NULL ELSE buffer_after END AS buffer_after, n >= 100000 AND n % 11 = 3 AS was_deleted FROM num WHERE NOT (n >= 100000 AND n % 11 = 3 AND n % 22 <> 3)),
there AS (SELECT id FROM kept WHERE NOT was_deleted),
every AS (SELECT r.id, r.resource_id, r.s, r.e + CASE WHEN CAST(r.id AS BIGINT) % 9 = 4 THEN 60000 ELSE 0 END AS e, CASE WHEN (CAST(r.id AS BIGINT) % 9 = 4) <> r.blocking THEN 'blocked' ELSE 'open' END AS kind FROM rules r WHERE CAST(r.id AS BIGINT) % 6 <> 0
  UNION ALL SELECT id, resource_id, s, e, 'hold' FROM holds WHERE CAST(id AS BIGINT) % 4 <> 0 UNION ALL SELECT id, resource_id, s, e, 'booking' FROM bookings WHERE CAST(id AS BIGINT) % 8 <> 0)"""
FOLDED_INTERVALS = f'{FOLDED} SELECT i.id, i.resource_id, i.s AS start, i.e AS "end", i.kind FROM every i JOIN there t ON t.id = i.resource_id'


@query("event_fold", FOLDED_INTERVALS)
def _(spark, d):
    return ev.fold(ev.valid_prefix(sample_log(spark, d)), fx.A_NOW).intervals().select("id", "resource_id", "start", "end", "kind")


@query("event_fold_resources", f"{FOLDED} SELECT id, parent_id, capacity, buffer_after FROM kept")
def _(spark, d):
    return ev.fold(sample_log(spark, d), fx.A_NOW).resources.select("id", "parent_id", "capacity", "buffer_after")


@query("snapshot_compaction", FOLDED_INTERVALS)
def _(spark, d):
    """The fold of the snapshot of a fold is that fold."""
    return ev.fold(ev.as_events(ev.fold(sample_log(spark, d), fx.A_NOW)), fx.A_NOW).intervals().select("id", "resource_id", "start", "end", "kind")


@query("corrupt_tail", f"WITH {A_SQL} SELECT id, s AS start FROM bookings WHERE CAST(id AS BIGINT) < 10000000500")
def _(spark, d):
    """An event whose span is none ends what is replayed."""
    bookings = a(spark, d).bookings
    n = F.col("id").cast("bigint")
    log = ev.event("BookingConfirmed", bookings, n * 2, end=F.when(n >= 10_000_000_500, F.col("start")).otherwise(F.col("end")))
    return ev.valid_prefix(log).select("id", "start")


@query("gc_retention", f"WITH {A_SQL} SELECT id, 'hold' AS kind FROM holds WHERE expires_at > {fx.A_NOW} OR e >= {fx.A_NOW - 7 * fx.DAY} UNION ALL SELECT id, 'booking' FROM bookings WHERE e >= {fx.A_NOW - 7 * fx.DAY} UNION ALL SELECT id, CASE WHEN blocking THEN 'blocked' ELSE 'open' END FROM rules")
def _(spark, d):
    return ev.collected(a(spark, d)).intervals().select("id", "kind")


@query("event_bubbling", f"""WITH RECURSIVE {A_SQL}, {TREE_SQL} SELECT 'resource_' || t.ancestor_id AS channel, '{{"BookingConfirmed":{{"id":"' || b.id || '","resource_id":"' || b.resource_id || '","span":{{"start":' || b.s || ',"end":' || b.e || '}},"label":' || CASE WHEN b.label IS NULL THEN 'null' ELSE '"' || replace(b.label, '"', '\\"') || '"' END || '}}}}' AS payload FROM bookings b JOIN tree t ON t.id = b.resource_id""")
def _(spark, d):
    s = a(spark, d)
    return ev.bubbled(ev.event("BookingConfirmed", s.bookings, F.col("id").cast("bigint")), hierarchy.closure(s.resources)).select("channel", "payload")


@query("expired_holds", f"{FOLDED} SELECT i.id, i.resource_id, h.expires_at FROM every i JOIN there t ON t.id = i.resource_id JOIN holds h ON h.id = i.id WHERE i.kind = 'hold' AND h.expires_at <= {fx.A_NOW}")
def _(spark, d):
    """What the stream of expiring holds tells, from the whole log."""
    return feed.expired_holds(sample_log(spark, d), fx.A_NOW)


@query("change_feed", ORACLE_SQL["event_bubbling"] + f" WHERE t.ancestor_id IN ('{TEAM}', '{USER}')")
def _(spark, d):
    """The channels of one team and one user, who may be in it."""
    s = a(spark, d)
    events = ev.event("BookingConfirmed", s.bookings, F.col("id").cast("bigint"))
    return feed.change_feed(events, hierarchy.closure(s.resources), [TEAM, USER]).select("channel", "payload")
