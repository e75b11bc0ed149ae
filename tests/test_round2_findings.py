"""Findings of round 2's review, each with the smallest case that failed before."""

import time

import pandas as pd
from test_log_and_streams import BOOKED, CREATED, log

from slotloom.operators import admission, availability as av, mutations, sweep
from slotloom.schema import BOOKINGS, HOLDS, RESOURCES, RULES, Schedule
from slotloom.sources import events as ev


def schedule(spark, resources, rules, bookings=()):
    return Schedule(spark.createDataFrame(resources, RESOURCES), spark.createDataFrame(rules, RULES), spark.createDataFrame([], HOLDS), spark.createDataFrame(list(bookings), BOOKINGS), 0)


def test_an_id_on_two_resources_is_two_intervals(spark):
    """the later one took the other's place."""
    other = {**CREATED, "id": "q"}
    both = [CREATED, other, BOOKED, {**BOOKED, "resource_id": "q", "end": 9}]
    ids = lambda *rows: sorted((r.id, r.resource_id, r.end) for r in ev.fold(log(spark, *rows), 0).bookings.collect())
    assert ids(*both) == [("b", "q", 9), ("b", "r", 2)]
    assert ids(*both, {"type": "BookingCancelled", "id": "b", "resource_id": "r"}) == [("b", "q", 9)]
    assert ids(*both, {**BOOKED, "end": 5}) == [("b", "q", 9), ("b", "r", 5)]


def test_the_events_of_a_state_are_numbered_once(spark):
    """each reader of the events ran the sort again, and its tasks numbered other rows."""
    rows = [CREATED, {**CREATED, "id": "q"}, *[{**BOOKED, "id": f"b{i}", "resource_id": "rq"[i % 2]} for i in range(40)]]
    made = ev.as_events(ev.fold(log(spark, *rows), 0))
    first = {(r.id, r.resource_id): r.seq for r in made.collect()}
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            assert {(r.id, r.resource_id): r.seq for r in made.collect()} == first
            assert ev.fold(made, 0).bookings.count() == 40
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_segments_end_where_any_rule_above_does(spark):
    """the ends of a parent's open rule did not show where the resource has open rules of its own."""
    s = schedule(spark, [("p", None, None, 1, None), ("c", "p", None, 2, None)], [("x", "p", 3, 5, False), ("y", "c", 0, 10, False)], [("b", "c", 4, 7, None)])
    rows = av.remaining_capacity(s, 0, 100).where("resource_id = 'c'")
    assert sorted((r.start, r.end, r.remaining) for r in rows.collect()) == [(0, 3, 2), (3, 4, 2), (4, 5, 1), (5, 7, 1), (7, 10, 2)]
    assert [(r.start, r.end) for r in av.availability(s, 0, 100).where("resource_id = 'c'").collect()] == [(0, 10)]


def test_an_updated_rule_is_told_apart_by_its_resource(spark):
    """two updates of one id on two resources gave four rows, and one's missing cover was the other's."""
    s = schedule(spark, [("p", None, None, 1, None), ("c", "p", None, 1, None), ("d", None, None, 1, None)], [("o", "p", 0, 10, False), ("x", "c", 1, 2, False), ("x", "d", 1, 2, False)])
    kind = "seq bigint, id string, resource_id string, start bigint, end bigint, blocking boolean"
    asked = spark.createDataFrame([(1, "x", "c", 20, 30, False), (1, "x", "d", 20, 30, False), (2, "x", "p", 1, 2, False), (3, "o", None, 1, 2, False)], kind)
    found = mutations.update_rules(s, asked)
    assert sorted(map(str, found.collect())) == sorted(map(str, spark.createDataFrame([(1, "x", "c", "NotCoveredByParent"), (1, "x", "d", None), (2, "x", None, "NotFound"), (3, "o", "p", None)], found.schema).collect()))
    assert mutations.events_of("update_rules", asked.where("seq = 3"), found.where("seq = 3"), 5).first().resource_id == "p"


def test_more_spans_are_swept_in_more_tasks(spark, monkeypatch):
    """the tasks were as many whatever the input, and each one's memory grew with it."""
    monkeypatch.setattr(sweep, "ROWS", 50)
    rows = spark.range(1000).selectExpr("concat('r', id % 40) as resource_id", "id * 10 as start", "id * 10 + 5 as end", "1L as capacity")
    assert sweep.tasks_of(rows) == 20 and sweep.tasks_of(rows.limit(1)) == 1 and sweep.tasks_of(rows.limit(0)) == 1
    assert sweep.tasks_of(rows.selectExpr("resource_id", "0L as start", "100L as end").limit(10), 10) == 2  # a row for each bucket
    for found in (sweep.merge_overlapping(rows), sweep.saturated_spans(rows)):
        assert found.rdd.getNumPartitions() == 20 and found.count() == 1000


def test_small_pieces_are_judged_without_a_frame_each():
    """each resource's piece cost some 17 ms of pandas calls. The same rows in any batches give the same verdicts."""
    n = 3000
    rows = pd.DataFrame({"resource_id": [f"r{i // 2:05}" for i in range(n)], "piece": 0, "id": [f"q{i:05}" for i in range(n)], "seq": [None if i % 2 == 0 else float(i) for i in range(n)], "k": range(n)})
    rows = rows.assign(start=0, end=[5 + i % 4 for i in range(n)], capacity=[1 + i // 2 % 2 for i in range(n)], ghost=False, held=rows.seq.isna(), crossing=False)
    began = time.process_time()
    told = pd.concat(admission.judge_pieces(iter([rows])))
    assert time.process_time() - began < 3
    assert told.k.tolist() == list(range(1, n, 2)) and set(told.held) == {1} and told.first_id.dropna().tolist() == [f"q{i:05}" for i in range(0, n, 4)]
    for size in (1, 7):
        assert pd.concat(admission.judge_pieces(rows[i : i + size] for i in range(0, 300, size))).values.tolist() == told[:150].values.tolist()
