"""Explicit schemas and fixed values of the metering ledger."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the wire format and the ledger.
TOPIC = "util_tick"
FRAME_TYPE, GREETING_TYPE = "UTIL_TICK", "CONNECTED"
ACKNOWLEDGED = "ingested"
INITIAL_ESCROW = 10_000_000
PAGE_LIMIT = 200
HISTORY_DEFAULT, HISTORY_CAP = 50, 500
DEFAULT_RESOURCE = "SOLAR"
DEFAULT_RATE = 1_000

TICK = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("event_id", T.StringType()),
        T.StructField("consumer", T.StringType()),
        T.StructField("operator", T.StringType()),
        T.StructField("resource_type", T.StringType()),
        T.StructField("units_drawn", T.LongType()),
        T.StructField("cost", T.StringType()),
        T.StructField("meter_sequence", T.LongType()),
        T.StructField("timestamp", T.LongType()),
    ]
)
RAW_EVENT = T.StructType([T.StructField("ingest_ordinal", T.LongType(), False), T.StructField("page_no", T.LongType()), T.StructField("payload", T.StringType())])
FRAME_FIELDS = ("event_id", "consumer", "operator", "resource_type", "units_drawn", "cost", "meter_sequence", "timestamp")
