import random

import pandas as pd
import pytest

from slotloom.operators import admission
from slotloom.schema import BOOKINGS, HOLDS, RESOURCES, RULES, Schedule


@pytest.mark.parametrize("piece", [7, 40])
def test_a_busy_line_is_decided_in_pieces(spark, piece):
    """Spans that chain into one island, cut into many pieces, against a plain loop; no task gets the island."""
    rnd = random.Random(piece)
    capacity = {"one": 1, "two": 2, "five": 5, "none": 0}
    bookings = [(f"b{i:03}", r, t, t + rnd.randrange(1, 9), None) for i, (r, t) in enumerate((rnd.choice(list(capacity)), rnd.randrange(600)) for _ in range(60))]
    asked = []
    for n in range(700):
        t = rnd.randrange(600)
        asked.append((rnd.randrange(300), f"q{n:03}", rnd.choice(list(capacity)), t, t + rnd.choice([1, 3, 8, 20, 120])))
    s = Schedule(spark.createDataFrame([(r, None, None, c, 1) for r, c in capacity.items()], RESOURCES), spark.createDataFrame([], RULES), spark.createDataFrame([], HOLDS), spark.createDataFrame(bookings, BOOKINGS), 0)
    held = {r: [(a, b + 1, i) for i, x, a, b, _ in bookings if x == r] for r in capacity}
    expected = {}
    for _, i, r, a, b in sorted(asked):
        met = sorted(h for h in held[r] if h[0] < b + 1 and h[1] > a)
        peak = max((sum(x <= t < y for x, y, _ in met) for t in range(a, b + 1)), default=0)
        full = peak >= max(capacity[r], 1)
        expected[i] = (not full, None if not full else f"Conflict: {met[0][2]}" if capacity[r] <= 1 else f"CapacityExceeded: {capacity[r]}")
        if not full:
            held[r].append((a, b + 1, i))
    requests = spark.createDataFrame(asked, "seq bigint, id string, resource_id string, start bigint, end bigint")
    assert {r.id: (r.admitted, r.error) for r in admission.admit(s, requests, piece=piece).collect()} == expected


def test_pieces_are_bounded(spark):
    rows = [("r", f"q{i}", i, i, i + 3, 1, i) for i in range(1000)]
    spans = spark.createDataFrame(rows, "resource_id string, id string, seq bigint, start bigint, end bigint, capacity bigint, k bigint")
    placed: pd.DataFrame = admission._placed(spans, 50).toPandas()
    assert placed.groupby("piece").size().max() <= 50 + 3 and placed.k.nunique() == 1000
    assert (placed[placed.crossing].groupby("k").size() > 1).all() and (placed[~placed.crossing].groupby("k").size() == 1).all()
