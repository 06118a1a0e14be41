"""Continuous settlement: micro-batches onto a kept ledger (events unique over all consumers), or keyed state per consumer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gridloom.functions.normalize import integer_text
from gridloom.operators.kept import Ledger
from gridloom.operators.settle import DUPLICATE, OK, REPLAY

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VERDICT_SCHEMA = "id bigint, event_id string, consumer string, operator string, resource_type string, units_drawn bigint, cost string, meter_sequence bigint, timestamp bigint, verdict string"


class Settler(StatefulProcessor):
    """Per consumer: the last accepted sequence and the accepted events, kept without expiry.

    Exact while every event id belongs to one consumer and batches arrive in order of ``id``; where events may come from
    several consumers use :func:`settle_into`. A batch's rows of one
    consumer are ordered in memory; the source's admission control (page size, files per trigger) bounds them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.guard = handle.getValueState("guard", StructType([StructField("last", LongType())]))
        self.events = handle.getMapState("events", StructType([StructField("event", StringType())]), StructType([StructField("id", LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("id")
        last = self.guard.get()[0] if self.guard.exists() else None
        verdicts = []
        for seq, event, row in zip(frame["meter_sequence"], frame["event_id"], frame["id"]):
            seq = 0 if pd.isna(seq) else int(seq)
            event = f"\0{row}" if event is None else event
            if seq > 0 and last is not None and seq <= last:
                verdicts.append(REPLAY)
            elif self.events.containsKey((event,)):
                verdicts.append(DUPLICATE)
            else:
                verdicts.append(OK)
                self.events.updateValue((event,), (int(row),))
                last = seq
        if last is not None:
            self.guard.update((last,))
        yield frame.assign(verdict=verdicts)

    def close(self) -> None:
        pass


def settle_stream(ticks: DataFrame) -> DataFrame:
    """A streaming DataFrame of ticks (schema TICK) with ``verdict``; accepted and rejected rows alike come out."""
    ticks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return ticks.groupBy("consumer").transformWithStateInPandas(Settler(), VERDICT_SCHEMA, "Append", "None")


def settle_into(ledger: Ledger, stream: DataFrame, checkpoint: str, available: bool = False, seconds: int = 2, accepted: Callable[[DataFrame], object] | None = None) -> StreamingQuery:
    """Settle every micro-batch (schema TICK) of a stream onto a kept ledger, under both guards over all consumers.

    A micro-batch is one batch of the ledger, under the number that the stream gives it: if it is repeated after a failure,
    the ledger has it already and it changes nothing. The ledger must take nothing else. ``accepted`` gets each batch's
    accepted ticks after they are stored; a repeated batch sends none again. ``available``: settle what is there and stop.
    """

    def batch(frame: DataFrame, number: int) -> None:
        ticks = frame.select("id", "event_id", "consumer", "operator", "resource_type", "units_drawn", integer_text("cost").alias("cost"), F.coalesce("meter_sequence", F.lit(0)).alias("meter_sequence"), F.col("timestamp").alias("time"))
        verdicts = ledger.append(ticks, batch=number + 1)
        if accepted:
            accepted(verdicts.filter(verdicts["verdict"] == OK).drop("verdict"))

    out = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available else out.trigger(processingTime=f"{seconds} seconds")).start()


def run_available(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Settle what is there and stop: rows go to Parquet files under ``out``; a second run resumes from the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(out)


def broadcast_frames(stream: DataFrame, send: Callable[[DataFrame], None], checkpoint: str, seconds: int = 2):
    """Hand the accepted ticks' frames to ``send``, batch by batch; a failing sink repeats the batch, not the settlement."""
    from gridloom.operators.state import frame_json, public_frame

    def batch(frame: DataFrame, _: int) -> None:
        send(frame_json(public_frame(frame.filter(frame["verdict"] == OK), "timestamp")))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def health(query) -> dict:
    """Status, rows of the last batch and offsets of a running query."""
    progress = query.lastProgress or {}
    return {"status": "ok" if query.isActive else "stopped", "indexed": progress.get("numInputRows", 0), "cursor": [s.get("endOffset") for s in progress.get("sources", [])], "message": query.status["message"]}


def read_ticks(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A file replay of recorded ticks with the ledger's schema."""
    from gridloom.schemas import TICK

    reader = spark.readStream.schema(TICK)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)
