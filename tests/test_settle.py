from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from gridloom.operators import settle as S
from gridloom.operators import state

SCHEMA = "id bigint, event_id string, consumer string, operator string, resource_type string, units_drawn bigint, cost bigint, meter_sequence bigint, time bigint"


def fold(rows):
    last, seen, out = {}, set(), {}
    for r in sorted(rows):
        i, ev, c, seq = r[0], r[1], r[2], r[7] or 0
        if r[5] is None or r[6] is None:
            out[i] = S.QUARANTINED
        elif c in last and seq > 0 and seq <= last[c]:
            out[i] = S.REPLAY
        elif ev is not None and ev in seen:
            out[i] = S.DUPLICATE
        else:
            out[i] = S.OK
            last[c] = seq
            seen.add(ev)
    return out


def rows_of(parts):
    return [(k + 1, f"e{e}" if e >= 0 else None, None if c == 3 else f"c{c}", "o", "SOLAR", 1 if u else None, 5, s, k) for k, (e, c, s, u) in enumerate(parts)]


one = st.tuples(st.integers(-1, 12), st.integers(0, 3), st.integers(-1, 6), st.sampled_from([True] * 9 + [False]))


@settings(max_examples=12, deadline=None, phases=[Phase.explicit, Phase.reuse, Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(one, max_size=60), st.sampled_from([4, 7, 1000]))
def test_settlement_equals_the_sequential_fold(spark, parts, block):
    before, S.BLOCK = S.BLOCK, block
    try:
        rows = rows_of(parts)
        got = {r["id"]: r["verdict"] for r in S.settle(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got == fold(rows)
    finally:
        S.BLOCK = before


@settings(max_examples=8, deadline=None, phases=[Phase.explicit, Phase.reuse, Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(one, min_size=2, max_size=50), st.integers(1, 49))
def test_two_parts_settle_as_one(spark, parts, cut):
    rows = [r for r in rows_of(parts) if r[2] is not None]
    cut = min(cut, len(rows))
    first = S.settle(spark.createDataFrame(rows[:cut], SCHEMA))
    accepted = first.filter("verdict = 'OK'")
    initial = state.consumer_state(accepted).select(state.F.col("address").alias("consumer"), "last_meter_sequence")
    got = {r["id"]: r["verdict"] for r in first.collect()}
    got |= {r["id"]: r["verdict"] for r in S.settle(spark.createDataFrame(rows[cut:], SCHEMA), initial, accepted.select("event_id")).collect()}
    assert got == fold(rows)


def test_scenario_and_states(spark):
    tick = lambda i, ev, units, cost, seq, ts: (i, ev, "GC1", "GO1", "SOLAR", units, cost, seq, ts)
    rows = [tick(1, "evt-1", 25, 25000, 1, 1000), tick(2, "evt-replay", 25, 25000, 1, 1001), tick(3, "evt-1", 1, 1, 2, 1002), tick(4, "evt-4", 10, 10000, 2, 900)]
    done = S.settle(spark.createDataFrame(rows, SCHEMA))
    assert [r["verdict"] for r in done.orderBy("id").collect()] == [S.OK, S.REPLAY, S.DUPLICATE, S.OK]
    accepted = done.filter("verdict = 'OK'").drop("verdict")
    c = state.consumer_state(accepted).first()
    assert (c["total_units_consumed"], c["last_meter_sequence"], int(c["escrow_balance"]), c["last_seen"]) == (35, 2, 9_965_000, 900)
    o = state.operator_state(accepted)
    assert (int(o.first()["total_earned"]), o.first()["resource_type"]) == (35_000, "SOLAR")
    merged = state.upsert_operators(o, spark.createDataFrame([("GO1", None, 7), ("GO2", "GAS", None)], "address string, resource_type string, staked_amount bigint"))
    assert {(r["address"], r["resource_type"], int(r["staked_amount"]), int(r["total_earned"])) for r in merged.collect()} == {("GO1", "UNKNOWN", 7, 35_000), ("GO2", "GAS", 0, 0)}
    assert [int(r["balance"]) for r in S.running_balance(accepted, 10_000_000).orderBy("id").collect()] == [9_975_000, 9_965_000]
    assert [(r["id"], r["place"]) for r in state.history(accepted, "GC1", 1).collect()] == [(4, 1)]
    assert state.history(accepted, "GC_NONE", 50).count() == 0
    metrics = state.grid_metrics(accepted, state.consumer_state(accepted), o)
    m = metrics.first()
    assert (m["total_ticks"], m["active_consumers"], m["active_operators"], m["total_settled"]) == (2, 1, 1, "35000")
    nested = state.history_nested(state.consumer_state(accepted), state.history(accepted, "GC1", 50)).first()
    assert [h["event_id"] for h in nested["history"]] == ["evt-4", "evt-1"] and nested["address"] == "GC1"
    full = state.grid_summary(metrics, state.leaderboard(o, True), state.distribution(accepted)).first()
    assert full["distribution"] == {"SOLAR": 35} and [x["address"] for x in full["operators"]] == ["GO1"]


def test_reset_reuse_and_prior_state(spark):
    base = lambda i, ev, seq: (i, ev, "c", "o", "R", 1, 1, seq, i)
    rows = [base(1, "a", 5), base(2, "b", 4), base(3, "b", 6), base(4, "z", 0), base(5, "d", 3), base(6, "a", 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r["id"]: r["verdict"] for r in S.settle(df).collect()} == fold(rows)
    prior = spark.createDataFrame([("c", 5)], "consumer string, last_meter_sequence bigint")
    got = {r["id"]: r["verdict"] for r in S.settle(df, prior).collect()}
    assert got[1] == S.REPLAY and got[3] == S.OK


def test_empty_ledger(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert S.settle(df).count() == 0
    m = state.grid_metrics(df, state.consumer_state(df), state.operator_state(df)).first()
    assert (m["total_ticks"], m["total_settled"], m["active_consumers"], m["total_units"], m["total_earned"]) == (0, "0", 0, 0, "0")


def test_leaderboard_as_text_and_number(spark):
    ops = spark.createDataFrame([("x", "R", 0, 9), ("y", "R", 0, 10000)], "address string, resource_type string, staked_amount bigint, total_earned bigint")
    assert [r["address"] for r in state.leaderboard(ops, True).orderBy("place").collect()] == ["x", "y"]
    assert [r["address"] for r in state.leaderboard(ops, False).orderBy("place").collect()] == ["y", "x"]
