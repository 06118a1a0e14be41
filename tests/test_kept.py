"""The kept ledger: deliveries settled onto stored state equal one fold; look-ups, upserts, cursors, broken-off batches."""

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from gridloom.operators import kept, settle, state
from gridloom.streaming import settlement
from tests.test_settle import SCHEMA, fold, one, rows_of


@settings(max_examples=3, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(one, min_size=6, max_size=50), st.lists(st.integers(1, 49), min_size=1, max_size=2))
def test_deliveries_settle_as_one(spark, tmp_path_factory, parts, cuts):
    rows = [r for r in rows_of(parts) if r[2] is not None]
    ledger = kept.Ledger(spark, f"file://{tmp_path_factory.mktemp('kept')}/l")
    cuts = [0, *sorted({min(c, len(rows)) for c in cuts}), len(rows)]
    got = {}
    for a, b in zip(cuts, cuts[1:]):
        got |= {r["id"]: r["verdict"] for r in ledger.append(spark.createDataFrame(rows[a:b], SCHEMA)).collect()}
    want = fold(rows)
    assert got == want and ledger.version == len(cuts) - 1
    accepted = spark.createDataFrame([r for r in rows if want[r[0]] == settle.OK], SCHEMA)
    assert sorted(map(tuple, ledger.consumers().collect())) == sorted(map(tuple, state.consumer_state(accepted).collect()))
    assert sorted(map(tuple, ledger.operators().collect())) == sorted(map(tuple, state.operator_state(accepted).collect()))
    assert {r["id"] for r in ledger.rejected().collect()} == {k for k, v in want.items() if v != settle.OK}


def test_scenario_over_kept_state(spark, tmp_path):
    tick = lambda i, ev, units, cost, seq, ts: (i, ev, "GC1", "GO1", "SOLAR", units, cost, seq, ts)
    ledger = kept.Ledger(spark, f"file://{tmp_path}/l", buckets=7)
    assert ledger.version == 0 and ledger.consumer("GC1").count() == 0 and ledger.ticks().count() == 0 and ledger.cursor("K:cursor") is None
    for n, (rows, verdict) in enumerate([([tick(1, "evt-1", 25, 25000, 1, 1000)], "OK"), ([tick(2, "evt-replay", 25, 25000, 1, 1001)], "REPLAY"), ([tick(3, "evt-1", 1, 1, 2, 1002)], "DUPLICATE_EVENT")]):
        assert ledger.append(spark.createDataFrame(rows, SCHEMA), {"K:cursor": f"c{n}"}).first()["verdict"] == verdict
    c = ledger.consumer("GC1").first()
    assert (c["total_units_consumed"], c["last_meter_sequence"], int(c["escrow_balance"])) == (25, 1, 9_975_000)
    assert ledger.cursor("K:cursor") == "c2" and ledger.cursor("other") is None
    ledger.set_cursor("K:cursor", "last")
    assert ledger.cursor("K:cursor") == "last"
    ledger.register_operators(spark.createDataFrame([("GO1", "WIND", 5, 1), ("GO1", None, 7, 2), ("GO2", "GAS", None, 3)], "address string, resource_type string, staked_amount bigint, k bigint"), "k")
    assert {(r[0], r[1], int(r[2]), int(r[3])) for r in ledger.operators().collect()} == {("GO1", "UNKNOWN", 7, 25_000), ("GO2", "GAS", 0, 0)}
    ledger.append(spark.createDataFrame([tick(4, "evt-4", 10, 10000, 2, 900)], SCHEMA))
    assert tuple(map(str, ledger.operator("GO1").first())) == ("GO1", "SOLAR", "7", "35000")
    ledger = kept.Ledger(spark, f"file://{tmp_path}/l")  # opened again: it keeps its number of buckets
    assert ledger.buckets == 7
    full = ledger.detail("GC1", 50).first()
    assert int(full["escrow_balance"]) == 9_965_000 and [h["event_id"] for h in full["history"]] == ["evt-4", "evt-1"]
    assert ledger.detail("GDOES_NOT_EXIST", 50).count() == 0 and [r["event_id"] for r in ledger.history("GC1", 1).collect()] == ["evt-4"]
    plan = ledger._of("GC1")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1][:200]
    # a batch that broke off before its commit is not seen, and is written over
    ledger._write(spark.createDataFrame([tick(9, "broken", 1, 1, 99, 1)], SCHEMA), "ticks", ledger.version + 1)
    assert ledger.ticks().count() == 2
    ledger.append(spark.createDataFrame([tick(10, "evt-10", 1, 1, 3, 1)], SCHEMA))
    assert {r["event_id"] for r in ledger.ticks().collect()} == {"evt-1", "evt-4", "evt-10"}
    # a repeated batch changes nothing
    assert ledger.append(spark.createDataFrame([tick(11, "evt-11", 1, 1, 4, 1)], SCHEMA), batch=ledger.version).count() == 0 and ledger.ticks().count() == 3


def test_stream_refuses_events_of_other_consumers(spark, tmp_path):
    from gridloom.schemas import TICK

    first = [(1, "a", "c", "o", "R", 1, "5", 5, 10), (2, "b", "d", "o", "R", 1, "5", 4, 11)]
    second = [(3, "a", "d", "o", "R", 1, "5", 6, 12), (4, "x", "c", "o", "R", 1, "bad", 7, 13), (5, "y", "d", "o", "R", 1, "6", 5, 14)]
    ledger, sent = kept.Ledger(spark, f"file://{tmp_path}/l"), []
    for part in (first, second):
        spark.createDataFrame(part, TICK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = settlement.read_ticks(spark, str(tmp_path / "in"), 1)
        settlement.settle_into(ledger, stream, str(tmp_path / "cp"), available=True, accepted=lambda df: sent.extend(r["event_id"] for r in df.collect())).awaitTermination()
    assert {r["id"]: r["verdict"] for r in ledger.rejected().collect()} == {3: "DUPLICATE_EVENT", 4: "QUARANTINED"}
    assert sorted(sent) == ["a", "b", "y"]
    assert {r["address"]: int(r["escrow_balance"]) for r in ledger.consumers().collect()} == {"c": 9_999_995, "d": 9_999_989}


def test_intermediate_tables_go_with_their_scope(spark):
    from gridloom import shared

    outer = shared.written(spark.range(3).toDF("x"), "outer")
    with shared.scratch(spark):
        inner = shared.written(spark.range(3).toDF("x"), "inner")
        where = inner.inputFiles()[0]
    fs, p = shared.file_system(spark, where)
    assert not fs.exists(p) and outer.count() == 3
