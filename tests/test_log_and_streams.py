"""The event log, its streams, tenants and scalar functions."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from slotloom.functions import spans
from slotloom.operators import admission, conflict, hierarchy
from slotloom.plans import views
from slotloom.schema import BOOKINGS, EVENTS, HOLDS, RESOURCES, RULES, Limits, Schedule, ScheduleError
from slotloom.sources import events as ev
from slotloom.sources.tenants import Tenants
from slotloom.streaming import feed

NAMES = [c.strip().split(" ")[0] for c in EVENTS.split(",")]


def log(spark, *rows):
    return spark.createDataFrame([tuple({"seq": n, **r}.get(c) for c in NAMES) for n, r in enumerate(rows, 1)], EVENTS)


CREATED = {"type": "ResourceCreated", "id": "r", "capacity": 2, "name": "x", "buffer_after": 5}
BOOKED = {"type": "BookingConfirmed", "id": "b", "resource_id": "r", "start": 1, "end": 2}


def test_fold_of_partial_updates_and_lives(spark):
    updates = [{"type": "ResourceUpdated", "id": "r", "set_name": True}, {"type": "ResourceUpdated", "id": "r", "set_capacity": True, "capacity": 7}]
    s = ev.fold(log(spark, CREATED, *updates, {"type": "ResourceUpdated", "id": "nobody", "set_name": True}), 0)
    assert [tuple(r) for r in s.resources.select("id", "name", "capacity", "buffer_after").collect()] == [("r", None, 7, 5)]
    again = [CREATED, BOOKED, {"type": "ResourceDeleted", "id": "r"}, CREATED]
    assert ev.fold(log(spark, *again), 0).bookings.count() == 0
    assert ev.fold(log(spark, *again, BOOKED), 0).bookings.count() == 1
    gone = [CREATED, {"type": "RuleAdded", "id": "a", "resource_id": "r", "start": 1, "end": 2, "blocking": False}, {"type": "RuleRemoved", "id": "a", "resource_id": "r"}, {"type": "RuleUpdated", "id": "a", "resource_id": "r", "start": 1, "end": 3, "blocking": True}]
    assert ev.fold(log(spark, *gone[:3]), 0).rules.count() == 0
    assert [(r.id, r.end, r.blocking) for r in ev.fold(log(spark, *gone), 0).rules.collect()] == [("a", 3, True)]  # an update brings a removed rule back
    assert ev.fold(log(spark, CREATED, gone[3]), 0).rules.count() == 1 and ev.fold(log(spark, gone[3]), 0).rules.count() == 0
    assert ev.fold(log(spark, *gone[:2], gone[3]), 0).rules.first().end == 3
    assert ev.fold(log(spark), 0).intervals().count() == 0


def test_corrupt_tail(spark):
    rows = log(spark, CREATED, BOOKED, {**BOOKED, "end": 1}, BOOKED)
    assert ev.valid_prefix(rows).count() == 2
    assert ev.valid_prefix(log(spark, CREATED, {"type": "Nonsense", "id": "x"}, BOOKED)).count() == 1


def test_retention_edges(spark):
    rows = lambda ends: spark.createDataFrame([(f"b{e}", "r", 0, e, None) for e in ends], BOOKINGS)
    holds = spark.createDataFrame([("h1", "r", 0, 49, 100), ("h2", "r", 0, 49, 101), ("h3", "r", 0, 50, 100)], HOLDS)
    s = ev.collected(Schedule(spark.createDataFrame([], RESOURCES), spark.createDataFrame([], RULES), holds, rows([49, 50, 51]), 100), 50)
    assert sorted(r.id for r in s.intervals().collect()) == ["b50", "b51", "h2", "h3"]


def test_payloads(spark):
    rows = log(spark, CREATED, {"type": "ResourceUpdated", "id": "r", "set_name": True, "set_capacity": True, "capacity": 3}, BOOKED, {"type": "HoldReleased", "id": "h", "resource_id": "r"})
    assert [r.p for r in rows.select(ev.payload().alias("p"), "seq").orderBy("seq").collect()] == [
        '{"ResourceCreated":{"id":"r","parent_id":null,"name":"x","capacity":2,"buffer_after":5}}',
        '{"ResourceUpdated":{"id":"r","name":null,"capacity":3}}',
        '{"BookingConfirmed":{"id":"b","resource_id":"r","span":{"start":1,"end":2},"label":null}}',
        '{"HoldReleased":{"id":"h","resource_id":"r"}}',
    ]


def test_commit_hold_events(spark):
    s = Schedule(spark.createDataFrame([("r", None, None, 1, None)], RESOURCES), spark.createDataFrame([], RULES), spark.createDataFrame([("h", "r", 5, 9, 1)], HOLDS), spark.createDataFrame([("x", "r", 9, 12, None)], BOOKINGS), 1000)
    asked = spark.createDataFrame([("h", "b", "hi"), ("nobody", "c", None)], "hold_id string, id string, label string")
    assert {r.id: r.error for r in admission.commit_holds(s, asked).collect()} == {"b": None, "c": "NotFound"}
    got = admission.commit_events(s, asked, 10).orderBy("seq").collect()
    assert [(r.type, r.id, r.label) for r in got] == [("HoldReleased", "h", None), ("BookingConfirmed", "b", "hi")] and got[1].seq == got[0].seq + 1


def test_streams(spark, tmp_path):
    path, ts = str(tmp_path / "log"), "ts timestamp"
    at = lambda ms: dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc).replace(tzinfo=None)
    hold = lambda i, e, seq: {"seq": seq, "type": "HoldPlaced", "id": i, "resource_id": "c", "start": 1, "end": 2, "expires_at": e}
    parts = [
        [({**CREATED, "id": "c", "seq": 1}, 10), (hold("early", 1000, 2), 10), (hold("released", 1000, 3), 10), (hold("late", 10**9, 4), 10)],
        [({"seq": 5, "type": "HoldReleased", "id": "released", "resource_id": "c"}, 500), ({**hold("gone", 1000, 3), "resource_id": "d"}, 10), ({"seq": 5, "type": "ResourceDeleted", "id": "d"}, 500)],
        [({**BOOKED, "resource_id": "c", "seq": 6}, 5000)],
        [({**BOOKED, "resource_id": "c", "id": "b2", "seq": 7}, 6000)],
    ]
    for rows in parts:
        spark.createDataFrame([(*[r.get(c) for c in NAMES], at(t)) for r, t in rows], f"{EVENTS}, {ts}").coalesce(1).write.mode("append").parquet(path)
    events = feed.event_stream(spark, path, f"{EVENTS}, {ts}")
    tree = spark.createDataFrame([("c", "c", 0), ("c", "top", 1)], "id string, ancestor_id string, depth int")

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    # one file in each micro-batch, so that the watermark moves between them
    slow = spark.readStream.schema(f"{EVENTS}, {ts}").option("maxFilesPerTrigger", 1).parquet(path)
    assert [(r.id, r.expires_at) for r in run(feed.expiring_holds(slow), "expired")] == [("early", 1000)]
    rows = run(feed.change_feed(events, tree), "feed")
    assert len(rows) == 14 and {r.channel for r in rows} == {"resource_c", "resource_top"}
    both = tree.unionByName(spark.createDataFrame([("top", "top", 0)], tree.schema))
    assert {r.channel for r in run(feed.change_feed(events, both, ["top"]), "one")} == {"resource_top"}
    for ids, limits in ((["nobody"], Limits()), (["c", "top"], Limits(followed=1))):
        with pytest.raises(ScheduleError):
            feed.change_feed(events, both, ids, limits)


def test_admitting_writer(spark, tmp_path):
    path, asked = str(tmp_path / "log"), str(tmp_path / "asked")
    ev.append_log(log(spark, {**CREATED, "capacity": 1, "buffer_after": None}), path)
    kind = "seq bigint, id string, resource_id string, start bigint, end bigint, label string"
    for rows in ([(1, "a", "r", 0, 10, None), (2, "b", "r", 5, 15, None)], [(3, "c", "r", 10, 20, "x"), (4, "d", "nobody", 0, 1, None)]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(asked)
        feed.admitting(spark.readStream.schema(kind).parquet(asked), path, str(tmp_path / "ck"), lambda: 0, compact_every=2).awaitTermination(120)
    assert sorted(r.id for r in ev.fold(ev.read_log(spark, path), 0).bookings.collect()) == ["a", "c"]
    assert any(f.startswith("snapshot-") for f in os.listdir(path))


def test_log_folders(spark, tmp_path):
    path = str(tmp_path / "log")
    ev.append_log(log(spark, CREATED, BOOKED), path)
    ev.append_log(log(spark, *[{**BOOKED, "id": f"b{i}", "seq": i} for i in range(5, 8)]), path)
    before = ev.fold(ev.read_log(spark, path), 0).bookings.count()
    ev.compact(spark, path, 0)
    ev.append_log(log(spark, {"type": "BookingCancelled", "id": "b5", "resource_id": "r", "seq": 8}), path)
    rows = ev.read_log(spark, path)
    assert before == 4 and ev.fold(ev.valid_prefix(rows), 0).bookings.count() == 3 and rows.count() == 6 and ev.valid_prefix(rows).count() == 6
    bad = rows.withColumn("label", F.when(F.col("type") == "BookingCancelled", F.lit("x")))
    assert ev.valid_prefix(bad).count() == 5  # its checksum differs
    ev.append_log(log(spark), str(tmp_path / "none"))
    ev.compact(spark, str(tmp_path / "none"), 0)
    assert ev.read_log(spark, str(tmp_path / "none")).count() == 0


def test_tenants(spark, tmp_path):
    t = Tenants(spark, str(tmp_path), Limits(tenants=2))
    t.append("one!", log(spark, CREATED))
    assert t.path("one!").endswith("/one") and t.state("one", 0).resources.count() == 1 and t.state("two", 0).resources.count() == 0
    with pytest.raises(ScheduleError):
        t.log("three")
    with pytest.raises(ScheduleError):
        t.path("!!")
    with pytest.raises(ScheduleError):
        t.path("x" * 257)


def test_scalars(spark):
    rows = spark.createDataFrame([(x,) for x in ["0" * 26, "8" + "0" * 25, "01arz3ndektsv4rrffq69g5fav", " 12", "-3", "1.5", "-0", "00", "T", "no", "99999999999999999999", None]], "x string")
    got = rows.select(spans.parse_ulid("x"), spans.parse_long("x"), spans.parse_u32("x"), spans.parse_bool("x")).collect()
    assert [r[0] for r in got][:3] == ["0" * 26, None, "01ARZ3NDEKTSV4RRFFQ69G5FAV"]
    assert [r[1] for r in got][3:] == [12, -3, None, 0, 0, None, None, None, None]
    assert [r[2] for r in got][3:5] == [12, None]
    assert [r[3] for r in got][3:] == [True, True, True, False, False, True, None, True, None]
    one = spark.range(1).select(spans.plus(F.lit(spans.MAX), F.lit(5).cast("bigint")), spans.minus(F.lit(3), F.lit(5)), spans.tenant_name(F.lit("a b!c")), spans.channel_resource(F.lit("resource_" + "0" * 26)), spans.channel_resource(F.lit("x"))).first()
    assert tuple(one) == (spans.MAX, 0, "abc", "0" * 26, None)


def test_validators(spark):
    rows = spark.createDataFrame([("a", 0, 1, 0, "x"), ("b", 1, 1, 0, "x"), ("c", -1, 1, 0, "x"), ("d", 0, 10**15, 0, "x"), ("e", 0, 1, -1, "x"), ("f", 0, 1, 0, "é" * 6), ("g", 0, 101, 0, "x")], "id string, start bigint, end bigint, expires_at bigint, label string")
    got = {r.id: r.error for r in conflict.validated(rows, Limits(label_bytes=10, span_ms=100)).collect()}
    assert got["a"] is None and got["b"] == "InvalidSpan" and "timestamp" in got["c"] and "timestamp" in got["d"] and "timestamp" in got["e"] and "label" in got["f"] and "wide" in got["g"]


def test_views(spark):
    s = Schedule(spark.createDataFrame([("r", None, None, 1, None)], RESOURCES), spark.createDataFrame([("u", "r", 0, 9, False)], RULES), spark.createDataFrame([], HOLDS), spark.createDataFrame([("b", "r", 3, 4, "x")], BOOKINGS), 0)
    views.register(s)
    views.register_availability(s, 0, 10)
    assert sorted(tuple(r) for r in spark.sql("select start, `end` from availability where resource_id = :r", args={"r": "r"}).collect()) == [(0, 3), (4, 9)]
    assert spark.sql("select count(*) from intervals").first()[0] == 2
    assert hierarchy.has_children(s.resources).count() == 0
