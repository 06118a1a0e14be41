"""The poll loop, its cursor and retries, and the listeners."""

import json
import time

from gridloom.operators import kept
from gridloom.sources import events
from gridloom.streaming.service import Listeners, PollLoop


def raw(name, consumer, units, sequence):
    return {"id": name, "topics": ["util_tick", consumer, "SOLAR"], "data": ["GO1", units, str(units * 1000), 1000], "meterSequence": sequence}


PAGES = {
    None: ([raw("a", "GC1", 5, 1), {"topics": ["other"], "data": []}, raw("a", "GC2", 5, 1)], "c1"),
    "c1": ([raw("b", "GC1", 7, 1), raw("c", "GC1", 7, 2)], None),
    "c2": ([], "c9"),
}


def test_pages_listeners_and_resume(spark, tmp_path):
    ledger, got = kept.Ledger(spark, f"file://{tmp_path}/l"), []
    loop = PollLoop(ledger, "u", "K", lambda url, params: dict(zip(("events", "cursor"), PAGES[params.get("cursor")])), start_cursor=None)
    loop.listeners.attach("here", got.append)

    def dead(text):
        if "UTIL_TICK" in text:
            raise OSError("gone")

    loop.listeners.attach("dead", dead)
    assert loop.listeners.count() == 2 and json.loads(got[0])["type"] == "CONNECTED"
    assert loop.poll_once() == {"indexed": 3, "cursor": "c1"} and loop.resume_cursor() == "c1"
    assert loop.listeners.count() == 1 and [json.loads(f)["data"]["event_id"] for f in got[1:]] == ["a"]
    assert loop.poll_once() == {"indexed": 2, "cursor": "c1"}  # a page without a cursor keeps the one before
    assert [json.loads(f)["data"]["event_id"] for f in got[1:]] == ["a", "c"]
    assert {r["event_id"]: r["verdict"] for r in ledger.rejected().collect()} == {"a": "DUPLICATE_EVENT", "b": "REPLAY"}
    again = PollLoop(ledger, "u", "K", lambda url, params: {"events": [], "cursor": "c9"})
    assert again.cursor == "c1" and again.poll_once() == {"indexed": 0, "cursor": "c1"}
    assert loop.health() | {"uptime_s": 0} == {"status": "ok", "running": False, "rpc_reachable": True, "cursor": "c1", "cursor_lag": None, "clients": 1, "uptime_s": 0, "indexed": 5, "failures": 0}


def test_errors_are_retried_at_the_same_cursor(spark, tmp_path):
    ledger, asked, said = kept.Ledger(spark, f"file://{tmp_path}/l"), [], []

    def poll(url, params):
        asked.append(params.get("cursor"))
        if len(asked) < 3:
            raise RuntimeError("down")
        return {"events": [raw("a", "GC1", 5, 1)] if len(asked) == 3 else [], "cursor": "c1"}

    loop = PollLoop(ledger, "u", "K", poll, seconds=0.01, log=said.append)
    loop.start()
    until = time.time() + 60
    while (len(asked) < 5) and time.time() < until:
        time.sleep(0.05)
    loop.stop()
    assert asked[:4] == [None, None, None, "c1"] and loop.failures == 2 and "down" in said[0]
    assert ledger.consumer("GC1").count() == 1 and not loop.health()["running"]
    asked_then = len(asked)
    time.sleep(0.1)
    assert len(asked) == asked_then


def test_listeners():
    listeners, got = Listeners(), []
    assert listeners.broadcast("x") == 0
    listeners.attach("a", got.append)
    listeners.attach("b", got.append)
    assert listeners.broadcast("x") == 2 and listeners.reap() == 2
    listeners.detach("a")
    assert listeners.broadcast("y") == 1
    listeners.close()
    assert listeners.count() == 0


def test_cursor_store(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 3), ("a", 9, 2), ("b", None, 5), ("b", 4, 4)], "key string, value bigint, order bigint")
    assert {r["key"]: r["value"] for r in events.cursor_store(df).collect()} == {"a": "2", "b": None}
    assert events.cursor_store(df.limit(0)).count() == 0
