"""Scenarios in hours, one resource tree each; all are computed in one job for each window."""

import pytest

from slotloom.operators import availability as av, sweep
from slotloom.schema import BOOKINGS, HOLDS, RESOURCES, RULES, Limits, Schedule, ScheduleError

H = 3_600_000
DAY = (0, 24)


def hours(spans):
    return [(int(a * H), int(b * H)) for a, b in spans]


def schedule(spark, resources, rules=(), holds=(), bookings=(), now=1000):
    """resources: (id, parent, capacity, buffer hours); rules: (resource, start, end, blocking); holds: (.., expires); bookings: (..)."""
    of = lambda rows: [(f"i{n}", r[0], int(r[1] * H), int(r[2] * H), *r[3:]) for n, r in enumerate(rows)]
    return Schedule(
        spark.createDataFrame([(i, p, None, c, None if b is None else int(b * H)) for i, p, c, b in resources], RESOURCES),
        spark.createDataFrame(of(rules), RULES), spark.createDataFrame(of(holds), HOLDS), spark.createDataFrame([(*b, None) for b in of(bookings)], BOOKINGS), now,
    )


def free(s, window=DAY, **more):
    out = {}
    for r in av.availability(s, int(window[0] * H), int(window[1] * H), **more).collect():
        out.setdefault(r.resource_id, []).append((r.start, r.end))
    return {k: sorted(v) for k, v in out.items()}


def test_trees(spark):
    one = lambda i: (i, None, 1, None)
    s = schedule(
        spark,
        [one("flat"), one("closed"), one("p1"), ("own", "p1", 1, None), one("p2"), ("block", "p2", 1, None), one("g3"), ("p3", "g3", 1, None), ("c3", "p3", 1, None), one("p4"), ("c4", "p4", 1, None), one("zero"), ("two", None, 2, None)],
        [("flat", 9, 12, False), ("p1", 9, 17, False), ("own", 14, 16, False), ("p2", 9, 17, False), ("block", 12, 13, True), ("g3", 9, 17, False), ("p3", 12, 13, True), ("p4", 9, 17, False), ("p4", 14, 15, True), ("zero", 0, 24, False), ("two", 0, 24, False)],
        bookings=[("flat", 10, 10.5), ("c4", 10, 11), ("p4", 9, 10), ("zero", 1, 2), ("two", 1, 2), ("two", 1.5, 3)],
    )
    got = free(s)
    assert got["flat"] == hours([(9, 10), (10.5, 12)])
    assert "closed" not in got
    assert got["own"] == hours([(14, 16)])
    assert got["block"] == hours([(9, 12), (13, 17)])
    assert got["c3"] == hours([(9, 12), (13, 17)])
    assert got["c4"] == hours([(9, 10), (11, 14), (15, 17)])  # the parent's booking is not inherited
    assert got["zero"] == hours([(0, 1), (2, 24)])
    assert got["two"] == hours([(0, 1.5), (2, 24)])


def test_override_depends_on_the_window(spark):
    s = schedule(spark, [("p", None, 1, None), ("c", "p", 1, None)], [("p", 0, 24, False), ("c", 14, 16, False)])
    assert free(s, (0, 12))["c"] == hours([(0, 12)])
    assert free(s, (0, 24))["c"] == hours([(14, 16)])


def test_buffers_and_holds(spark):
    s = schedule(spark, [("a", None, 1, 0.5), ("b", None, 1, None), ("c", None, 1, 1e12)], [("a", 0, 24, False), ("b", 9, 10, False), ("c", 0, 24, False)], [("b", 9, 10, 1)], [("a", 10, 11), ("c", 10, 11)])
    assert free(s, (11 + 5 / 60, 12))["a"] == hours([(11.5, 12)])
    assert free(s, (0, 12))["c"] == hours([(0, 10)])
    assert free(s)["b"] == hours([(9, 10)])  # expired
    assert "b" not in free(Schedule(s.resources, s.rules, s.holds, s.bookings, 0))
    assert free(Schedule(s.resources, s.rules, s.holds, s.bookings, 1))["b"] == hours([(9, 10)])  # expires_at = now


def test_garage_and_min_duration(spark):
    s = schedule(
        spark, [("g", None, 1, None), ("f1", "g", 1, None), ("f2", "g", 1, None), ("spot", "f1", 1, None), ("ev", "f2", 1, None)],
        [("g", 6, 24, False), ("f2", 8, 20, False), ("f1", 10, 11, True)], bookings=[("spot", 9, 17)],
    )
    got = free(s)
    assert got["spot"] == hours([(6, 9), (17, 24)]) and got["ev"] == hours([(8, 20)])
    assert free(s, min_duration=4 * H)["spot"] == hours([(17, 24)])


def test_k_of_n(spark):
    s = schedule(spark, [(i, None, 1, None) for i in "abcde"], [("a", 8, 12, False), ("b", 11, 16, False), ("c", 15, 20, False), ("d", 12, 16, False), ("e", 8, 17, False)])
    of = lambda ids, k, **m: sorted((r.start, r.end) for r in av.merged_availability(s, list(ids), k, 0, 24 * H, **m).collect())
    assert of("abc", 1) == hours([(8, 20)]) and of("abc", 2) == hours([(11, 12), (15, 16)]) and of("abc", 3) == []
    assert of("ad", 1, min_duration=6 * H) == hours([(8, 16)])  # merged before the duration counts
    assert of("ee", 2) == hours([(8, 17)])  # named twice
    assert of("ab", 0) == [] and of("ab", 3) == [] and of(["nobody"], 1) == []


def test_limits(spark):
    s = schedule(spark, [("a", None, 1, None)])
    with pytest.raises(ScheduleError, match="too wide"):
        av.availability(s, 0, 91 * 86_400_000)
    with pytest.raises(ScheduleError, match="too many"):
        av.availability(s, 0, 1, ids=[str(i) for i in range(1001)])
    assert av.availability(s, 5, 5).count() == 0
    assert av.availability(s, 0, 91 * 86_400_000, limits=Limits(window_ms=None)).count() == 0


def test_span_algebra(spark):
    rows = lambda x: spark.createDataFrame([("r", a, b) for a, b in x], "resource_id string, start bigint, end bigint")
    got = lambda df: sorted((r.start, r.end) for r in df.collect())
    assert got(sweep.merge_overlapping(rows([(0, 10), (10, 20), (15, 18), (30, 40), (50, 50)]), bucket=7)) == [(0, 20), (30, 40)]
    assert got(sweep.subtract_intervals(rows([(0, 100)]), rows([(10, 20), (15, 30), (90, 120)]), bucket=9)) == [(0, 10), (30, 90)]
    three = rows([(0, 100), (25, 75), (50, 150)]).selectExpr("*", "3L as capacity")
    assert got(sweep.saturated_spans(three, bucket=11)) == [(50, 75)]
    assert got(sweep.saturated_spans(three.drop("capacity").selectExpr("*", "0L as capacity"))) == []
