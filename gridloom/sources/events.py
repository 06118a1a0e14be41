"""Raw chain events: decoding of the wire forms, and the paged stream source."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from gridloom.functions import scalars as S
from gridloom.schemas import PAGE_LIMIT, TOPIC


def decode_ticks(events: DataFrame, order: str = "ingest_ordinal", payload: str = "payload") -> DataFrame:
    """Flat ticks of the events that are one; other topics, short, null and unreadable events are left out.

    Defined cases: undecodable addresses and resources are ''; units, time and sequence that are no whole number are
    NULL (settlement sets such ticks aside); without id and transaction hash the id is 'util_tick-<time as sent>'.
    """
    at = lambda a, i: F.try_variant_get(a, f"$[{i}]", "variant")
    head = lambda c: F.schema_of_variant(c).startswith("ARRAY")
    # each step's columns are used several times by the next, so that no expression is repeated in the generated code
    rows = events.select(order, F.try_parse_json(payload).alias("v")).filter(F.col("v").isNotNull())
    rows = rows.select(order, "v", S.field(F.col("v"), "$.topics").alias("topics"), S.field(F.col("v"), "$.data").alias("sent"))
    rows = rows.select(order, "v", "topics", S.unwrap(F.col("sent")).alias("data")).filter(head(F.col("topics")) & head(F.col("data")))
    topics, data = F.col("topics"), F.col("data")
    rows = rows.select(order, "v", at(topics, 0).alias("name"), at(topics, 1).alias("c0"), at(topics, 2).alias("r0"), at(data, 0).alias("o0"), at(data, 1).alias("u"), at(data, 2).alias("k"), at(data, 3).alias("t"), S.field(F.col("v"), "$.meterSequence").alias("s"))
    rows = rows.filter(F.col("r0").isNotNull() & F.col("t").isNotNull())
    rows = rows.select(order, "v", "u", "k", "t", "s", S.unwrap(F.col("name")).alias("n"), S.unwrap(F.col("c0")).alias("c"), S.unwrap(F.col("r0")).alias("r"), S.unwrap(F.col("o0")).alias("o"))
    rows = rows.filter(S.symbol(F.col("n")) == TOPIC)
    named = F.coalesce(S.text_of(S.field(F.col("v"), "$.id")), S.text_of(S.field(F.col("v"), "$.txHash")), F.concat(F.lit(TOPIC + "-"), F.coalesce(S.text_of(F.col("t")), F.lit("null"))))
    return rows.select(
        order,
        named.alias("event_id"),
        S.address_of(F.col("c")).alias("consumer"),
        S.address_of(F.col("o")).alias("operator"),
        S.symbol(F.col("r")).alias("resource_type"),
        S.whole(S.number(F.col("u"))).alias("units_drawn"),
        F.coalesce(S.text_of(F.col("k")), F.lit("0")).alias("cost"),
        F.when(F.col("s").isNull(), F.lit(0).cast("bigint")).otherwise(S.whole(S.number(F.col("s")))).alias("meter_sequence"),
        S.whole(S.number(F.col("t"))).alias("timestamp"),
    )


PollFn = Callable[[str, dict[str, Any]], dict[str, Any]]


def http_poll(url: str, params: dict[str, Any], timeout: float = 30.0) -> dict[str, Any]:
    """One JSON-RPC page; HTTP failures and error bodies raise."""
    body = json.dumps({"jsonrpc": "2.0", "id": 1, "method": "getEvents", "params": params}).encode()
    request = urllib.request.Request(url, data=body, headers={"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as response:
        answer = json.load(response)
    if answer.get("error"):
        raise RuntimeError(f"the event source answered with an error: {answer['error']}")
    return answer.get("result") or {}


def page_params(contract: str, cursor: str | None, limit: int = PAGE_LIMIT) -> dict[str, Any]:
    """The contract filter is pushed to the source, the page size is the admission control, topics are filtered after decoding."""
    params: dict[str, Any] = {"contractIds": [contract], "topics": [], "pagination": {"limit": limit}}
    if cursor:
        params["cursor"] = cursor
    return params


class _PageReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str], poll: PollFn):
        self.url, self.contract = options.get("url", ""), options.get("contract", "")
        self.limit = int(options.get("limit", PAGE_LIMIT))
        self.start_cursor, self.poll = options.get("startcursor"), poll

    def initialOffset(self) -> dict[str, Any]:
        return {"cursor": self.start_cursor, "read": 0, "pages": 0}

    def _page(self, start: dict[str, Any]) -> tuple[list[tuple[int, int, str]], dict[str, Any]]:
        answer = self.poll(self.url, page_params(self.contract, start["cursor"], self.limit)) or {}
        events = answer.get("events") or []
        rows = [(start["read"] + k, start["pages"], json.dumps(e)) for k, e in enumerate(events)]
        # a page without events leaves the cursor as it was, even if it names one
        cursor = (answer.get("cursor") or start["cursor"]) if events else start["cursor"]
        return rows, {"cursor": cursor, "read": start["read"] + len(events), "pages": start["pages"] + bool(events)}

    def read(self, start: dict[str, Any]) -> tuple[Iterator[tuple[int, int, str]], dict[str, Any]]:
        rows, end = self._page(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict[str, Any], end: dict[str, Any]) -> Iterator[tuple[int, int, str]]:
        rows, _ = self._page(start)
        return iter(rows[: end["read"] - start["read"]])


def event_source(poll: PollFn = http_poll, name: str = "metering_events") -> type[DataSource]:
    """A data source class to register: ``spark.dataSource.register(event_source(poll))``; one page is one micro-batch.

    Options: url, contract, limit, startCursor. The offset holds the cursor, so the checkpoint resumes where it stopped.
    """

    class MeteringEvents(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "ingest_ordinal bigint, page_no bigint, payload string"

        def simpleStreamReader(self, schema: Any) -> SimpleDataSourceStreamReader:
            return _PageReader({k.lower(): v for k, v in self.options.items()}, poll)

    return MeteringEvents


def cursor_latest(events: DataFrame, key: str = "cursor", page: str = "page_no", order: str = "ingest_ordinal", payload: str = "payload") -> DataFrame:
    """(key, value, indexed): the last non-empty page's cursor (its last event) and the events indexed so far, accepted or not."""
    return events.agg(F.max_by(page, order).alias("page"), F.max(order).alias("last"), F.count(payload).alias("indexed")).select(
        F.lit(key).alias("key"), F.concat_ws(":", F.col("page").cast("string"), F.col("last").cast("string")).alias("value"), "indexed"
    )


def cursor_store(writes: DataFrame, key: str = "key", value: str = "value", order: str = "order") -> DataFrame:
    """(key, value): a key-value store from all its writes; the last value of a key wins, as text. NULL values are values."""
    return writes.groupBy(key).agg(F.max_by(F.struct(F.col(value).cast("string").alias("v")), order).alias("last")).select(key, F.col("last.v").alias(value))
