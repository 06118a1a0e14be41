"""Wire forms, coercions, ingest validation, the page source and the stream."""

import json

from pyspark.sql import functions as F

from gridloom.functions import normalize as N
from gridloom.functions import scalars as S
from gridloom.operators import ingest
from gridloom.schemas import TICK
from gridloom.sources import events
from gridloom.streaming import settlement


def test_normalize(spark):
    cost = {" 12 ": 12, "+7": 7, "-3": -3, "007": 7, "0x10": 16, "": None, "n/a": None, "1.5": None, "1e3": None, "1,000": None, "9" * 38: int("9" * 38), "9" * 39: None, None: None}
    df = spark.createDataFrame([(k,) for k in cost], "c string")
    got = {r["c"]: r["v"] for r in df.select("c", N.integer_text("c").alias("v")).collect()}
    assert {k: None if v is None else int(v) for k, v in got.items()} == cost
    long = {r["c"]: r["v"] for r in df.select("c", N.integer64("c").alias("v")).collect()}
    assert long["9" * 38] is None and long["0x10"] == 16
    r = spark.createDataFrame([("  gcA\t", " wind-flex  z1", 1_736_214_693_000)], "a string, r string, t bigint").select(N.address("a"), N.resource("r"), N.epoch_seconds("t")).first()
    assert tuple(r) == ("GCA", "WIND_FLEX_Z1", 1_736_214_693)
    odd = spark.createDataFrame([(None, 0), ("", -5), ("unknown", None)], "r string, t bigint").select(N.resource("r"), N.epoch_seconds("t")).collect()
    assert all(tuple(x) == ("UNKNOWN", None) for x in odd)


def test_hex_symbols(spark):
    want = {"61zz62": "a", "616": "a", "6100": "a", "7574696c5f7469636b0000": "util_tick", "": "", "zz": ""}
    df = spark.createDataFrame([(k,) for k in want], "h string")
    assert {r["h"]: r["v"] for r in df.select("h", S.hex_text(F.col("h")).alias("v")).collect()} == want


def test_history_limit():
    assert [S.history_limit(x) for x in ("-1", "0", "abc", "10abc", "9999", None, "7")] == [None, 50, 50, 10, 500, 50, 7]


def test_decode(spark):
    full = {"topics": [{"sym": "7574696c5f7469636b"}, {"address": "GC1"}, {"sym": "534f4c4152"}], "data": [{"address": "GO1"}, 25, "25000", 1_700_000_000], "id": "e1"}
    wrapped = {"topics": ["util_tick", {"type": "Address", "value": "GC2"}, "WIND"], "data": {"type": "Vec", "value": ["GO2", "0x10", " 7 ", None]}, "txHash": "h1", "meterSequence": "3"}
    bare = {"topics": ["util_tick", 5, None], "data": [None, True, None, 12]}
    rows = [json.dumps(x) for x in (full, wrapped, bare, {"topics": ["other_event", "a", "b"], "data": [1, 2, 3, 4]}, {"topics": ["util_tick", "a"], "data": [1, 2, 3, 4]}, {"topics": ["util_tick", "a", "b"], "data": [1, 2, 3]}, {})] + ['{"topics": ["util', "null", None, "[]"]
    got = events.decode_ticks(spark.createDataFrame(list(enumerate(rows)), "ingest_ordinal bigint, payload string")).orderBy("ingest_ordinal").collect()
    assert [tuple(r)[1:] for r in got] == [
        ("e1", "GC1", "GO1", "SOLAR", 25, "25000", 0, 1_700_000_000),
        ("h1", "GC2", "GO2", "WIND", 16, " 7 ", 3, 0),
        ("util_tick-12", "", "", "", 1, "0", 0, 12),
    ]


def test_ingest(spark):
    good = {"consumer": "c", "operator": "o", "units_drawn": 7, "meter_sequence": 1, "timestamp": 5, "event_id": "e1"}
    cases = [
        (good, None, 7000), ({**good, "cost": "0x10"}, None, 16), ({**good, "cost": ""}, None, 0), ({**good, "cost": "1.5"}, "cost", None), ({**good, "cost": -1}, "negative cost", -1),
        ({**good, "units_drawn": "abc"}, "units_drawn", None), ({**good, "units_drawn": "25"}, None, 25000), ({**good, "units_drawn": 2.5}, "units_drawn", None), ({**good, "units_drawn": True}, None, 1000),
        ({**good, "meter_sequence": 0}, "meter_sequence", 7000), ({**good, "timestamp": None}, None, 7000), ({**good, "timestamp": "x"}, "timestamp", 7000), ({**good, "consumer": ""}, "consumer, operator", 7000),
        ({**good, "resource_type": None}, "null field", 7000), ({k: v for k, v in good.items() if k != "event_id"}, None, 7000), ([], "consumer, operator", None),
        ({**good, "consumer": 0}, "consumer, operator", 7000), ({**good, "operator": False}, "consumer, operator", 7000), ({**good, "consumer": True}, "unreadable consumer", 7000), ({**good, "operator": {}}, "null field", 7000),
        ({**good, "units_drawn": 1e21, "consumer": "d", "event_id": "big"}, None, 10**24), ({**good, "units_drawn": 1e300}, "units_drawn", None), ({**good, "event_id": None, "consumer": "e"}, "null field", 7000),
    ]
    df = spark.createDataFrame([(k, json.dumps(c[0])) for k, c in enumerate(cases)] + [(99, None), (98, '{"a')], "request_id bigint, body string").withColumn("received_at", F.lit("2025-01-01 00:00:01").cast("timestamp_ntz"))
    got = {r["id"]: r for r in ingest.validate(df).collect()}
    for k, (_, error, cost) in enumerate(cases):
        assert got[k]["error"] == error, k
        assert (None if got[k]["cost"] is None else int(got[k]["cost"])) == cost, k
    assert got[14]["event_id"] == "sim-1735689601000-14" and got[98]["status"] == 500 and (got[99]["status"], got[99]["error"]) == (400, "consumer, operator")
    status = {r["id"]: r["status"] for r in ingest.outcomes(ingest.validate(df)).collect()}
    assert status[0] == 201 and status[1] == 409 and status[3] == 400 and len(status) == len(cases) + 2
    assert status[13] == status[19] == 409  # the guard comes first: the sequence is replayed
    assert status[18] == status[22] == 500 and status[20] == 201
    assert {r["status"] for r in ingest.validate(df, production=True).collect()} == {403}


def test_acknowledgements_and_fields_that_cannot_be_stored(spark):
    base = {"consumer": "c", "operator": "o", "units_drawn": 10, "cost": "10000", "timestamp": 5}
    bodies = [{**base, "meter_sequence": 2, "event_id": "a"}, {**base, "meter_sequence": 9, "event_id": "b", "resource_type": None}, {**base, "meter_sequence": 3, "event_id": "b"}, {**base, "meter_sequence": 3, "event_id": None}, {**base, "meter_sequence": 4, "event_id": "kept"}]
    df = spark.createDataFrame([(k, json.dumps(b)) for k, b in enumerate(bodies)], "request_id bigint, body string").withColumn("received_at", F.lit("2025-01-01 00:00:01").cast("timestamp_ntz"))
    known = spark.createDataFrame([("kept",)], "event_id string")
    initial = spark.createDataFrame([("c", 1)], "consumer string, last_meter_sequence bigint")
    done = ingest.outcomes(ingest.validate(df), initial, known)
    # 1: can't be stored and changes nothing, so 2 is accepted; 3: the guard refuses before the field does
    assert [(r["status"], r["error"]) for r in done.orderBy("id").collect()] == [(201, None), (500, "null field"), (201, None), (409, "REPLAY"), (409, "DUPLICATE_EVENT")]
    answers = ingest.acknowledgements(done, spark.createDataFrame([("c", 9_975_000)], "address string, escrow_balance bigint")).orderBy("id").collect()
    assert [tuple(r) for r in answers] == [(0, "ingested", "a", "c", "o", "10000", 2, "9965000"), (2, "ingested", "b", "c", "o", "10000", 3, "9955000")]


def test_integer_prefix(spark):
    want = {"12": 12, " -7x": -7, "+3.9": 3, "1e3": 1, "abc": 0, "": 0, "-": 0, "9223372036854775808": 2**63 - 1, "-99999999999999999999999999999999999999999": -(2**63), "-9223372036854775808": -(2**63), "000000000000000000000000000005": 5, None: None}
    df = spark.createDataFrame([(k,) for k in want], "c string")
    assert {r["c"]: r["v"] for r in df.select("c", N.integer_prefix("c").alias("v")).collect()} == want


def test_page_source(spark, tmp_path):
    pages = {None: (["a", "b"], "c1"), "c1": (["c"], None), "x": ([], "c9")}

    def poll(url, params):
        assert params["pagination"] == {"limit": 200} and params["contractIds"] == ["K"]
        names, cursor = {None: (["a", "b"], "c1"), "c1": (["c"], "x"), "x": ([], "c9")}[params.get("cursor")]
        return {"events": [{"id": n} for n in names], "cursor": cursor}

    reader = events._PageReader({"url": "u", "contract": "K"}, poll)
    offset, seen = reader.initialOffset(), []
    for _ in range(3):
        rows, end = reader.read(offset)
        assert list(reader.readBetweenOffsets(offset, end)) == (rows := list(rows))
        seen += [json.loads(p)["id"] for _, _, p in rows]
        assert len({n for _, n, _ in rows}) <= 1 and all(n == offset["pages"] for _, n, _ in rows)
        offset = end
    assert seen == ["a", "b", "c"] and offset == {"cursor": "x", "read": 3, "pages": 2}
    spark.dataSource.register(events.event_source(poll, "test_pages"))
    query = spark.readStream.format("test_pages").option("url", "u").option("contract", "K").load().writeStream.format("memory").queryName("pages").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
        assert settlement.health(query)["status"] == "ok"
    finally:
        query.stop()
    assert [r["ingest_ordinal"] for r in spark.table("pages").orderBy("ingest_ordinal").collect()] == [0, 1, 2]


def test_stream_resumes(spark, tmp_path):
    first = [(1, "a", "c", "o", "R", 1, "5", 5, 10), (2, "b", "c", "o", "R", 1, "5", 4, 11)]
    second = [(3, "b", "c", "o", "R", 1, "5", 6, 12), (4, "a", "c", "o", "R", 1, "5", 7, 13), (5, "z", None, "o", "R", 1, "5", None, 14)]
    for part in (first, second):
        spark.createDataFrame(part, TICK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = settlement.settle_stream(settlement.read_ticks(spark, str(tmp_path / "in"), 1))
        out = settlement.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [(r["id"], r["verdict"]) for r in out.orderBy("id").collect()] == [(1, "OK"), (2, "REPLAY"), (3, "OK"), (4, "DUPLICATE_EVENT"), (5, "OK")]
    frames = []
    query = settlement.broadcast_frames(settlement.settle_stream(settlement.read_ticks(spark, str(tmp_path / "in"))), lambda df: frames.extend(df.collect()), str(tmp_path / "cp2"), 0)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert len(frames) == 3 and json.loads(frames[0]["frame"])["type"] == "UTIL_TICK"
