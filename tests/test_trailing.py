import datetime
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.operators.trailing import TwoStackQueue, sliding, trailing_totals


@given(st.lists(st.integers(-100, 100), max_size=60), st.integers(1, 9))
def test_queue_and_matrix_agree_with_brute_force(values, period):
    for combine, op, identity in ((lambda a, b: a + b, np.add, 0), (max, np.maximum, -(10**9)), (lambda a, b: a | b, np.bitwise_or, 0)):
        queue, seen = TwoStackQueue(combine, identity), []
        for v in values:
            queue.push(v)
            if len(queue) > period:
                queue.pop()
            seen.append(queue.value())
        expected = []
        for i in range(len(values)):
            total = identity
            for v in values[max(0, i - period + 1) : i + 1]:
                total = combine(total, v)
            expected.append(total)
        assert seen == expected
        matrix = sliding(np.array([values, values[::-1]], np.int64).reshape(2, -1), period, op, identity)
        assert matrix[0].tolist() == expected


def brute(rows, lo, hi, periods):
    out = {}
    for entity in {r[0] for r in rows if r[1] is not None and lo <= r[1] <= hi}:
        daily = defaultdict(list)
        for e, d, v in rows:
            if e == entity and d is not None:
                daily[d].append(v)
        for d in range(lo, hi + 1):
            for p in periods:
                inside = [v for x in range(max(lo, d - p + 1), d + 1) for v in daily[x]]
                values = [v for v in inside if v is not None]
                out[entity, d, p] = (len(inside), sum(values), sum(values) / min(p, d - lo + 1), sum(values) / len(values) if values else None, max(values, default=None))
    return out


def check(spark, rows, periods=(2, 5), calendar=None):
    df = spark.createDataFrame(rows, "entity string, day int, v bigint")
    got = trailing_totals(df, "entity", "day", ["v"], periods, calendar).collect()
    days = [r[1] for r in rows if r[1] is not None]
    lo, hi = calendar or (min(days), max(days))
    expected = brute(rows, lo, hi, periods)
    assert len(got) * len(periods) == len(expected)
    for r in got:
        d = (r["day"] - datetime.date(1970, 1, 1)).days
        for p in periods:
            n, total, per_day, per_row, most = expected[r["entity"], d, p]
            assert (r[f"n_{p}"], int(r[f"v_sum_{p}"]), r[f"v_max_{p}"]) == (n, total, most)
            assert r[f"v_avg_day_{p}"] == pytest.approx(per_day)
            assert r[f"v_avg_row_{p}"] == (None if per_row is None else pytest.approx(per_row))


def test_gaps_nulls_ties_and_extremes(spark):
    big = 2**63 - 1
    check(spark, [("a", 3, 1), ("a", 3, 1), ("a", 9, None), ("b", 4, big), ("b", 4, big), ("b", 5, -(2**63)), (None, 6, 2), (None, 4, 1), ("c", None, 7)])


def test_random_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(f"e{rng.integers(40)}" if k % 3 else "hot", int(rng.integers(100, 160)), int(rng.integers(-50, 50))) for k in range(3000)]
    check(spark, rows, (7, 30))


def test_rows_outside_the_calendar_are_left_out(spark):
    check(spark, [("a", 1, 5), ("a", 4, 7), ("b", 9, 1)], calendar=(3, 6))


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "entity string, day int, v bigint")
    assert trailing_totals(df, "entity", "day", ["v"]).count() == 0
    clash = spark.createDataFrame([("x", 1, 2, 3, "m")], "n string, day int, entity bigint, m0 bigint, m0_hi string")
    r = trailing_totals(clash, "n", "day", ["entity", "m0"], (7,)).first()
    assert int(r["entity_sum_7"]) == 2 and int(r["m0_sum_7"]) == 3
