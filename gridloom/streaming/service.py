"""The serial poll loop over a paged source, the listeners that accepted ticks are sent to, and their health."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.normalize import integer_text
from gridloom.operators.kept import Ledger
from gridloom.operators.settle import OK
from gridloom.operators.state import frame_json, public_frame
from gridloom.schemas import GREETING_TYPE, PAGE_LIMIT
from gridloom.sources.events import PollFn, decode_ticks, http_poll, page_params


class Listeners:
    """Whoever wants the accepted ticks' frames: functions that take a text. One that raises is dropped, as a dead connection is."""

    def __init__(self) -> None:
        self._send: dict[str, Callable[[str], object]] = {}
        self._lock = threading.Lock()

    def attach(self, name: str, send: Callable[[str], object]) -> None:
        """Add a listener; it is greeted with its name and the time."""
        send(json.dumps({"type": GREETING_TYPE, "data": {"remote": name, "at": int(time.time())}}, separators=(",", ":")))
        with self._lock:
            self._send[name] = send

    def detach(self, name: str) -> None:
        with self._lock:
            self._send.pop(name, None)

    def count(self) -> int:
        return len(self._send)

    def close(self) -> None:
        with self._lock:
            self._send.clear()

    def _each(self, call: Callable[[Callable[[str], object]], object]) -> int:
        reached = 0
        for name, send in list(self._send.items()):
            try:
                call(send)
                reached += 1
            except Exception:  # noqa: BLE001 - whatever is wrong with it, the listener is gone
                self.detach(name)
        return reached

    def broadcast(self, frame: str) -> int:
        """Send one frame to all; gives how many got it, 0 without listeners. Nothing is kept for those who come later."""
        return self._each(lambda send: send(frame))

    def reap(self) -> int:
        """Probe all listeners with an empty text and drop the dead ones; gives how many are left."""
        return self._each(lambda send: send(""))

    def send_ticks(self, accepted: DataFrame) -> int:
        """Send the frames of a batch of accepted ticks, in order of arrival; gives the number of frames sent."""
        if not self.count():
            return 0
        frames = frame_json(public_frame(accepted.orderBy("id")))
        return sum(self.broadcast(r["frame"]) for r in frames.toLocalIterator())


class PollLoop:
    """One page after the other: decode, settle onto the kept ledger, send what was accepted.

    The next poll starts ``seconds`` after the one before has ended. An error is reported to ``log`` and the same cursor is
    polled again after the same time. The cursor is committed with the page's ticks, under '<contract>:cursor'; a loop over
    the same ledger goes on from there unless it is given ``start_cursor``. A page holds at most ``limit`` events.
    """

    def __init__(self, ledger: Ledger, url: str, contract: str, poll: PollFn = http_poll, limit: int = PAGE_LIMIT, seconds: float = 2.0, start_cursor: str | None = None, listeners: Listeners | None = None, log: Callable[[str], object] = print):
        self.ledger, self.url, self.contract, self.poll, self.limit, self.seconds, self.log = ledger, url, contract, poll, limit, seconds, log
        self.listeners = listeners or Listeners()
        self.cursor = start_cursor or self.resume_cursor()
        self.indexed, self.failures, self.began = 0, 0, time.monotonic()
        self._arrived: int | None = None
        self._stop, self._thread = threading.Event(), None

    def resume_cursor(self) -> str | None:
        """The cursor that the ledger keeps."""
        return self.ledger.cursor(f"{self.contract}:cursor")

    def poll_once(self) -> dict[str, Any]:
        """One page; gives its number of raw events and the cursor. An error leaves cursor and ledger as they were."""
        answer = self.poll(self.url, page_params(self.contract, self.cursor, self.limit)) or {}
        events = answer.get("events") or []
        if events:
            if self._arrived is None:  # ids go on from the ledger's last arrival
                last = [t.agg(F.max("id")).first()[0] for t in (self.ledger.ticks(), self.ledger.rejected())]
                self._arrived = max((x for x in last if x is not None), default=0)
            cursor = answer.get("cursor") or self.cursor
            raw = self.ledger.spark.createDataFrame([(self._arrived + 1 + k, json.dumps(e)) for k, e in enumerate(events)], "id bigint, payload string")
            ticks = decode_ticks(raw, "id").withColumn("cost", integer_text("cost", blank=0)).withColumnRenamed("timestamp", "time")
            verdicts = self.ledger.append(ticks, {f"{self.contract}:cursor": cursor} if cursor else None)
            self._arrived += len(events)
            self.cursor, self.indexed = cursor, self.indexed + len(events)
            self.listeners.send_ticks(verdicts.filter(F.col("verdict") == OK))
        return {"indexed": len(events), "cursor": self.cursor}

    def _run(self) -> None:
        while not self._stop.is_set():
            try:
                self.poll_once()
            except Exception as e:  # noqa: BLE001 - the loop outlives every poll
                self.failures += 1
                self.log(f"poll failed: {e}")
            self._stop.wait(self.seconds)

    def start(self) -> None:
        if self._thread is None or not self._thread.is_alive():
            self._stop.clear()
            self._thread = threading.Thread(target=self._run, daemon=True)
            self._thread.start()

    def stop(self, timeout: float = 30.0) -> None:
        """No further poll; waits for the one under way."""
        self._stop.set()
        if self._thread:
            self._thread.join(timeout)

    def health(self) -> dict[str, Any]:
        return {
            "status": "ok", "running": bool(self._thread and self._thread.is_alive()), "rpc_reachable": bool(self.url), "cursor": self.cursor, "cursor_lag": None, "clients": self.listeners.count(),
            "uptime_s": round(time.monotonic() - self.began), "indexed": self.indexed, "failures": self.failures,
        }
