"""Random small cases against brute force at every instant; many cases are one job."""

import random

from slotloom.operators import admission, availability as av, conflict, hierarchy
from slotloom.schema import BOOKINGS, HOLDS, RESOURCES, RULES, Limits, Schedule

SPAN, NOW = 60, 1000


def random_schedule(spark, cases, seed):
    """Each case is a chain of three resources with a few intervals; holds expire about ``NOW``."""
    rnd = random.Random(seed)
    resources, rules, holds, bookings = [], [], [], []
    for c in range(cases):
        for depth in range(3):
            resources.append((f"{c}.{depth}", f"{c}.{depth - 1}" if depth else None, None, rnd.randint(0, 3), rnd.choice([None, rnd.randint(0, 8)])))
        for n in range(rnd.randint(0, 12)):
            start = rnd.randrange(SPAN)
            row = (f"{c}/{n}", f"{c}.{rnd.choice([0, 1, 2, 2])}", start, start + rnd.randint(1, 12))
            kind = rnd.randrange(4)
            if kind < 2:
                rules.append((*row, kind == 1))
            elif kind == 2:
                holds.append((*row, NOW + rnd.randint(-2, 2)))
            else:
                bookings.append((*row, None))
    return resources, rules, holds, bookings, Schedule(*[spark.createDataFrame(r, t) for r, t in ((resources, RESOURCES), (rules, RULES), (holds, HOLDS), (bookings, BOOKINGS))], NOW)


def brute_free(data, qs, qe):
    resources, rules, holds, bookings, _ = data
    parent = {r[0]: r[1] for r in resources}
    taken = [(b[1], b[2], b[3]) for b in bookings] + [(h[1], h[2], h[3]) for h in holds if h[4] > NOW]
    out = {}
    for rid, _, _, capacity, buffer in resources:
        line, at = [], rid
        while at:
            line.append(at)
            at = parent[at]
        near = [[r for r in rules if r[1] == a and r[2] < qe and r[3] > qs] for a in line]
        opened = next((o for o in ([r for r in rs if not r[4]] for rs in near) if o), [])
        blocked = [r for rs in near for r in rs if r[4]]
        ok = lambda t: any(r[2] <= t < r[3] for r in opened) and not any(r[2] <= t < r[3] for r in blocked) and sum(a == rid and s <= t < e + (buffer or 0) for a, s, e in taken) < max(capacity, 1)  # noqa: B023, E731
        good = [ok(t) for t in range(qs, qe)] + [False]
        start = None
        for t, g in enumerate(good, qs):
            if g and start is None:
                start = t
            elif not g and start is not None:
                out.setdefault(rid, []).append((start, t))
                start = None
    return out


def test_availability(spark):
    data = random_schedule(spark, 120, 1)
    for qs, qe, bucket in ((0, 72, 10), (29, 41, 3)):
        got = {}
        for r in av.availability(data[-1], qs, qe, bucket=bucket).collect():
            got.setdefault(r.resource_id, []).append((r.start, r.end))
        assert {k: sorted(v) for k, v in got.items()} == brute_free(data, qs, qe)


def test_what_if_and_admission(spark):
    data = random_schedule(spark, 60, 2)
    resources, _, holds, bookings, s = data
    rnd = random.Random(3)
    asked = []
    for n in range(240):
        start = rnd.randrange(SPAN)
        asked.append((n, f"q{n}", f"{rnd.randrange(60)}.{rnd.choice([0, 2])}" if n % 40 else "nobody", start, start + rnd.choice([0, 1, 5, 9])))
    requests = spark.createDataFrame(asked, "seq bigint, id string, resource_id string, start bigint, end bigint")
    of = {r[0]: (r[3], r[4] or 0) for r in resources}
    taken = [(b[0], b[1], b[2], b[3]) for b in bookings] + [(h[0], h[1], h[2], h[3]) for h in holds if h[4] > NOW]

    def judge(rid, start, end, held):
        if start >= end:
            return 0, "InvalidSpan"
        if rid not in of:
            return 0, "NotFound"
        capacity, buffer = of[rid]
        near = sorted((s, i, e + buffer) for i, r, s, e in held if r == rid and s < end + buffer and start < e + buffer)
        peak = max((sum(s <= t < e for s, _, e in near) for t in range(start, end + buffer)), default=0)
        error = None if peak < max(capacity, 1) else f"Conflict: {near[0][1]}" if capacity <= 1 else f"CapacityExceeded: {capacity}"
        return peak, error

    got = {r.id: (r.peak, r.error) for r in conflict.what_if(s, requests, bucket=7).collect()}
    assert got == {i: judge(r, a, b, taken) for _, i, r, a, b in asked}
    held, expected = list(taken), {}
    for _, i, r, a, b in asked:
        _, error = judge(r, a, b, held)
        expected[i] = (error is None, error)
        if error is None:
            held.append((i, r, a, b))
    assert {r.id: (r.admitted, r.error) for r in admission.admit(s, requests).collect()} == expected


def test_contention(spark):
    s = Schedule(spark.createDataFrame([("one", None, None, 1, None), ("two", None, None, 2, 30)], RESOURCES), *[spark.createDataFrame([], t) for t in (RULES, HOLDS, BOOKINGS)], NOW)
    asked = [(n, f"{r}{n}", r, 100, 200) for r in ("one", "two") for n in range(8)]
    got = admission.admit(s, spark.createDataFrame(asked, "seq bigint, id string, resource_id string, start bigint, end bigint")).where("admitted")
    assert sorted(r.id for r in got.collect()) == ["one0", "two0", "two1"]


def test_buffer_in_batches(spark):
    s = Schedule(spark.createDataFrame([("r", None, None, 1, 30), ("w", None, None, 2, None)], RESOURCES), *[spark.createDataFrame([], t) for t in (RULES, HOLDS, BOOKINGS)], NOW)
    rows = [("near", "a", "r", 0, 60), ("near", "b", "r", 75, 90), ("far", "a", "r", 0, 60), ("far", "b", "r", 90, 99), ("wide", "a", "w", 0, 9), ("wide", "b", "w", 0, 9), ("over", "a", "w", 0, 9), ("over", "b", "w", 0, 9), ("over", "c", "w", 8, 9)]
    got = admission.batch_what_if(s, spark.createDataFrame(rows, "batch_id string, id string, resource_id string, start bigint, end bigint"))
    assert {r.batch_id: r.error for r in got.collect()} == {"near": "Conflict", "far": None, "wide": None, "over": "CapacityExceeded: 2"}


def test_trees_that_are_wrong(spark):
    rows = [("a", "b"), ("b", "a"), ("c", "a"), ("d", "gone"), ("ok", None)] + [(f"n{i}", f"n{i - 1}" if i else None) for i in range(8)]
    resources, limits = spark.createDataFrame([(i, p, None, 1, None) for i, p in rows], RESOURCES), Limits(depth=5)
    got = {r.id: r.error for r in hierarchy.tree_errors(resources, hierarchy.closure(resources, limits), limits).collect()}
    assert got == {"a": "CycleDetected", "b": "CycleDetected", "c": "CycleDetected", "d": "NotFound", "n6": "LimitExceeded: hierarchy too deep", "n7": "LimitExceeded: hierarchy too deep"}
