"""States and summaries derived from the accepted ledger: everything is one decomposable aggregate per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.ranking import numbered
from gridloom.schemas import FRAME_TYPE, INITIAL_ESCROW


def _sum(c: str) -> Column:
    return F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)")


def consumer_state(accepted: DataFrame, initial: int = INITIAL_ESCROW) -> DataFrame:
    """Balance, total units, last accepted (not largest) sequence and time per consumer."""
    return accepted.groupBy(F.col("consumer").alias("address")).agg(
        (F.lit(initial).cast("decimal(38,0)") - _sum("cost")).cast("decimal(38,0)").alias("escrow_balance"),
        F.coalesce(F.sum("units_drawn"), F.lit(0)).cast("bigint").alias("total_units_consumed"),
        F.max_by("meter_sequence", "id").alias("last_meter_sequence"),
        F.max_by("time", "id").alias("last_seen"),
    )


def operator_state(accepted: DataFrame) -> DataFrame:
    """Last accepted resource and earnings per operator; the stake of an operator that only settled is 0."""
    return accepted.groupBy(F.col("operator").alias("address")).agg(
        F.max_by("resource_type", "id").alias("resource_type"), F.lit(0).cast("decimal(38,0)").alias("staked_amount"), _sum("cost").alias("total_earned")
    )


def merge_consumers(before: DataFrame, delivered: DataFrame, initial: int = INITIAL_ESCROW) -> DataFrame:
    """New states of the consumers in ``delivered`` (their states from a delivery alone), going on from ``before``."""
    b, d = before.alias("b"), delivered.alias("d")
    spent = F.lit(initial).cast("decimal(38,0)") - F.col("d.escrow_balance")
    return d.join(b, F.col("d.address").eqNullSafe(F.col("b.address")), "left").select(
        "d.address",
        F.coalesce(F.col("b.escrow_balance") - spent, F.col("d.escrow_balance")).cast("decimal(38,0)").alias("escrow_balance"),
        (F.coalesce("b.total_units_consumed", F.lit(0)) + F.col("d.total_units_consumed")).alias("total_units_consumed"),
        "d.last_meter_sequence",
        "d.last_seen",
    )


def merge_operators(before: DataFrame, delivered: DataFrame) -> DataFrame:
    """New states of the operators in ``delivered``: the last resource, the stake as before, earnings added."""
    b, d = before.alias("b"), delivered.alias("d")
    return d.join(b, F.col("d.address").eqNullSafe(F.col("b.address")), "left").select(
        "d.address",
        "d.resource_type",
        F.coalesce("b.staked_amount", "d.staked_amount").alias("staked_amount"),
        (F.coalesce("b.total_earned", F.lit(0)) + F.col("d.total_earned")).cast("decimal(38,0)").alias("total_earned"),
    )


def upsert_operators(state: DataFrame, registrations: DataFrame, order: str | None = None) -> DataFrame:
    """Merge (address, resource_type, staked_amount) into the operators: resource and stake are replaced, earnings kept.

    Of several registrations of an address the last in ``order`` counts; without an order they must be unique, and of
    repeated ones the largest (resource_type, staked_amount) is taken, so the result is the same on every run.
    """
    fields = F.struct("resource_type", F.col("staked_amount").cast("decimal(38,0)").alias("staked_amount"))
    r = registrations.groupBy("address").agg((F.max_by(fields, order) if order else F.max(fields)).alias("r")).select("address", "r.*").alias("r")
    s = state.alias("s")
    known = F.col("r.address").isNotNull()
    return s.join(r, F.col("s.address") == F.col("r.address"), "full").select(
        F.coalesce("s.address", "r.address").alias("address"),
        F.when(known, F.coalesce(F.when(F.col("r.resource_type") != "", F.col("r.resource_type")), F.lit("UNKNOWN"))).otherwise(F.col("s.resource_type")).alias("resource_type"),
        F.when(known, F.coalesce("r.staked_amount", F.lit(0))).otherwise(F.col("s.staked_amount")).cast("decimal(38,0)").alias("staked_amount"),
        F.coalesce("s.total_earned", F.lit(0)).cast("decimal(38,0)").alias("total_earned"),
    )


def lookup(table: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of one key; empty if there is none. The filter reaches the scan."""
    return table.filter(F.col(key) == value)


def history(accepted: DataFrame, consumer: str, limit: int | None) -> DataFrame:
    """A consumer's accepted ticks, newest accepted first, with their place; ``limit`` None is unlimited."""
    rows = accepted.filter(F.col("consumer") == consumer)
    columns = ["id", "event_id", "operator", "resource_type", "units_drawn", "cost", "meter_sequence", "time"]
    if limit is not None:
        rows = rows.select(*columns).orderBy(F.desc("id")).limit(limit)  # a top-k, no full sort; a page's rows are few
        return rows.select("*", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("id"))).alias("place"))
    return numbered(rows.select(*columns), F.desc("id"))


def history_nested(state: DataFrame, recent: DataFrame) -> DataFrame:
    """The consumer's state with its history as an array, newest first."""
    fields = [c for c in recent.columns if c not in ("id", "place")]
    nested = recent.groupBy().agg(F.array_sort(F.collect_list(F.struct("place", *fields))).alias("history"))
    return _beside(state, nested)


def _beside(rows: DataFrame, one_row: DataFrame) -> DataFrame:
    """``rows`` with the columns of a one-row table."""
    one = F.lit(1).alias("__one")
    return rows.select("*", one).join(F.broadcast(one_row.select("*", one)), "__one", "left").drop("__one")


def summary_of(table: DataFrame, count: str, sums: dict[str, str]) -> DataFrame:
    """One row: the row count and sums that are 0 for an empty table."""
    return table.agg(F.count(F.lit(1)).alias(count), *(_sum(c).alias(name) for name, c in sums.items()))


def distribution(accepted: DataFrame) -> DataFrame:
    return accepted.groupBy("resource_type").agg(F.coalesce(F.sum("units_drawn"), F.lit(0)).cast("bigint").alias("units"))


def leaderboard(state: DataFrame, as_text: bool) -> DataFrame:
    """Operators by earnings with their place: as text ('9' before '10000') or as numbers; ties by address.

    Places come from a distributed sort, see :func:`gridloom.operators.ranking.numbered`.
    """
    key = F.col("total_earned").cast("string") if as_text else F.col("total_earned")
    return numbered(state, key.desc(), F.col("address"))


def grid_metrics(accepted: DataFrame, consumers: DataFrame, operators: DataFrame) -> DataFrame:
    """One row of totals; the units are those of the consumers, sums of money are texts."""
    t = summary_of(accepted, "total_ticks", {"total_settled": "cost"})
    c = summary_of(consumers, "active_consumers", {"total_units": "total_units_consumed"})
    o = summary_of(operators, "active_operators", {"total_earned": "total_earned"})
    return _beside(_beside(t, c), o).select("total_ticks", F.col("total_settled").cast("string").alias("total_settled"), "active_consumers", F.col("total_units").cast("bigint").alias("total_units"), "active_operators", F.col("total_earned").cast("string").alias("total_earned"))


def grid_summary(metrics: DataFrame, operators: DataFrame, shares: DataFrame) -> DataFrame:
    """The metrics with the operators as an array of rows and the distribution as a map.

    One document with all operators and types is what is asked for here, so one task holds these (merged) rows; where they
    may be many, the leaderboard and the distribution give the same as tables.
    """
    ops = operators.groupBy().agg(F.array_sort(F.collect_list(F.struct("place", "address", "resource_type", "staked_amount", "total_earned"))).alias("operators"))
    dist = shares.groupBy().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("resource_type", F.lit("")), "units")))).alias("distribution"))
    return _beside(_beside(metrics, ops), dist)


def public_frame(ticks: DataFrame, time: str = "time") -> DataFrame:
    """The eight fields that are sent out."""
    return ticks.select("event_id", "consumer", "operator", "resource_type", "units_drawn", F.col("cost").cast("string").alias("cost"), "meter_sequence", F.col(time).alias("timestamp"))


def frame_json(frames: DataFrame) -> DataFrame:
    """(event_id, frame): the frame as JSON text of {type, data}."""
    data = F.struct(*frames.columns)
    return frames.select("event_id", F.to_json(F.struct(F.lit(FRAME_TYPE).alias("type"), data.alias("data")), {"ignoreNullFields": "false"}).alias("frame"))
