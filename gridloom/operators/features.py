"""Per-entity feature table from events: counts, recency and totals for each event type."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.deliveries import first_deliveries
from gridloom.shared import written

#: A group of entity and type with more than max(SALT_ROWS, rows / HEAVY_PARTS) rows is spread, so that no salt holds
#: many more; there are fewer than HEAVY_PARTS such groups, which bounds what is broadcast.
SALT_ROWS = 5_000
HEAVY_PARTS = 100_000
#: The complete type list is part of every row; beyond this many types use the long layout, which has no such bound.
MAX_TYPES = 20_000
#: Cells (entities x types) expanded at once in a Python worker.
CELLS = 1_000_000


def type_groups(df: DataFrame, entity: str, kind: str, time: str) -> DataFrame:
    """(entity, kind, n, last): delivered rows and latest time of each group, written. Its aggregates answer every question that comes before the statistics."""
    rows = df.select(F.col(entity).alias("entity"), F.col(kind).alias("kind"), F.col(time).cast("bigint").alias("time"))
    return written(rows.groupBy("entity", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("time").alias("last")), "groups")


def type_statistics(df: DataFrame, entity: str, kind: str, time: str, value: str, event: str | None = None, order: str | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(entity, kind, n, last, total) by two-stage salted aggregation.

    Of repeated deliveries of an ``event`` the one with the smallest ``order`` counts, whatever entity or type the others
    name: rows meet once, on the event, and no entity's size matters there. Heavy groups of entity and kind (the only
    thing broadcast; fewer than HEAVY_PARTS) are then spread over as many salts as keep each near SALT_ROWS rows; partial
    statistics per salt are formed before they are sent, and the second stage merges them.

    NULL entity or kind is a group of its own; NULL times and values count as rows only; ``total`` is DECIMAL(38,0), 0
    where no value is readable; an empty table gives no rows. ``groups``: of :func:`type_groups`, if at hand.
    """
    groups = type_groups(df, entity, kind, time) if groups is None else groups
    rows = df.select(F.col(entity).alias("entity"), F.col(kind).alias("kind"), F.col(time).cast("bigint").alias("time"), F.col(value).cast("bigint").alias("value"), *([F.col(event).alias("event"), F.col(order).alias("ord")] if event else []))
    drawn = F.monotonically_increasing_id()
    if event:
        rows, drawn = first_deliveries(rows, "event", "ord"), F.col("r.ord")
    most = max(SALT_ROWS, (groups.agg(F.sum("n")).first()[0] or 0) // HEAVY_PARTS)
    heavy = groups.filter(F.col("n") > most).select("entity", "kind", F.ceil(F.col("n") / most).alias("salts"))
    same = F.col("r.entity").eqNullSafe(F.col("h.entity")) & F.col("r.kind").eqNullSafe(F.col("h.kind"))
    salt = F.coalesce(F.pmod(F.xxhash64(drawn), F.col("h.salts")), F.lit(0)).cast("int")
    rows = rows.alias("r").join(F.broadcast(heavy.alias("h")), same, "left").select("r.entity", "r.kind", "r.time", "r.value", salt.alias("salt"))
    partial = rows.groupBy("entity", "kind", "salt").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("time").alias("last"),
        F.sum(F.shiftright("value", 30)).alias("hi"),
        F.sum(F.col("value").bitwiseAND(F.lit(2**30 - 1))).alias("lo"),
    )
    merged = partial.groupBy("entity", "kind").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.sum("hi").alias("hi"), F.sum("lo").alias("lo"))
    total = F.coalesce(F.col("hi"), F.lit(0)).cast("decimal(20,0)") * F.lit(2**30) + F.coalesce(F.col("lo"), F.lit(0))
    return merged.select(F.col("entity").alias(entity), F.col("kind").alias(kind), "n", "last", total.cast("decimal(38,0)").alias("total"))


def all_types(df: DataFrame, kind: str) -> list[str]:
    """The complete, sorted type list; an error beyond MAX_TYPES, never a shortened list."""
    found = df.select(kind).distinct().limit(MAX_TYPES + 1).collect()
    if len(found) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} values of {kind}: use entity_features_long")
    return sorted(r[0] for r in found if r[0] is not None)


def entity_features(df: DataFrame, entity: str, kind: str, time: str, value: str, event: str | None = None, order: str | None = None, types: list[str] | None = None, as_of: int | None = None) -> DataFrame:
    """One row per entity; arrays aligned with ``types`` hold count, seconds since the last event and total per type.

    Types the entity never had get count 0, recency NULL, total 0. ``as_of`` is by default the latest time in ``df``. Rows
    whose kind is NULL or outside ``types`` count in ``events_all`` only; entities none of whose deliveries counts as an
    event's first have no row. An entity is never spread over rows: what reaches one task per entity are its at most
    len(types) merged statistics, which are put in their places in one step each.
    """
    spark = df.sparkSession
    groups = type_groups(df, entity, kind, time)
    types = all_types(groups, "kind") if types is None else types
    as_of = groups.agg(F.max("last")).first()[0] if as_of is None else as_of
    stats = type_statistics(df, entity, kind, time, value, event, order, groups).select(F.col(entity).alias("entity"), F.col(kind).alias("kind"), "n", "last", "total")
    places = spark.createDataFrame([(t, k) for k, t in enumerate(types)], "kind string, place int")
    since = F.lit(as_of).cast("bigint") - F.col("last")
    entry = F.when(F.col("place").isNotNull(), F.struct("place", "n", since.alias("since"), "total"))
    per = stats.join(F.broadcast(places), "kind", "left").groupBy("entity").agg(F.sum("n").alias("events_all"), F.min(since).alias("seconds_since_any"), F.collect_list(entry).alias("s"))
    width = len(types)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // max(1, width))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                s = batch.column("s")
                size = s.value_lengths().to_numpy()
                flat = s.flatten()
                cell = np.repeat(np.arange(len(size)), size) * width + flat.field("place").to_numpy()
                source = np.zeros(len(size) * width, np.int64)
                source[cell] = np.arange(len(cell))
                empty = np.ones(len(source), bool)
                empty[cell] = False
                taken = pa.array(source, mask=empty)
                offsets = pa.array(np.arange(len(size) + 1, dtype=np.int32) * width)
                columns = [flat.field("n").take(taken).fill_null(0), flat.field("since").take(taken), flat.field("total").take(taken).fill_null(0)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("entity", "events_all", "seconds_since_any")), *(pa.ListArray.from_arrays(offsets, c) for c in columns)], names=["entity", "events_all", "seconds_since_any", "counts", "seconds_since_last", "totals"])

    name = per.schema["entity"].dataType.simpleString()
    out = per.mapInArrow(expand, f"entity {name}, events_all bigint, seconds_since_any bigint, counts array<bigint>, seconds_since_last array<bigint>, totals array<decimal(38,0)>")
    listed = F.array(*(F.lit(t) for t in types)).cast("array<string>")
    return out.select(F.col("entity").alias(entity), "events_all", "seconds_since_any", listed.alias("types"), "counts", "seconds_since_last", "totals")


def entity_features_long(df: DataFrame, entity: str, kind: str, time: str, value: str, event: str | None = None, order: str | None = None, as_of: int | None = None) -> DataFrame:
    """(entity, type, n, seconds_since_last, total): the feature table with one row per entity and type, for any number of types.

    Straight from the statistics: every entity meets the complete type list (which is joined, not collected), types it
    never had get count 0, recency NULL, total 0.
    """
    groups = type_groups(df, entity, kind, time)
    as_of = groups.agg(F.max("last")).first()[0] if as_of is None else as_of
    stats = written(type_statistics(df, entity, kind, time, value, event, order, groups).select(F.col(entity).alias("entity"), F.col(kind).alias("kind"), "n", "last", "total"), "statistics")
    kinds = groups.filter("kind IS NOT NULL").select("kind").distinct()
    listed = kinds.groupBy((F.xxhash64("kind") % 64).alias("bucket")).agg(F.collect_list("kind").alias("kinds"))
    buckets = F.explode(F.sequence(F.lit(-63), F.lit(63)).cast("array<bigint>"))
    # every entity takes each of the buckets of types, which are joined on their number
    grid = stats.select("entity").distinct().select("entity", buckets.alias("bucket")).join(listed, "bucket").select("entity", F.explode("kinds").alias("kind"))
    g, s = grid.alias("g"), stats.alias("s")
    out = g.join(s, F.col("g.entity").eqNullSafe(F.col("s.entity")) & (F.col("g.kind") == F.col("s.kind")), "left")
    return out.select(
        F.col("g.entity").alias(entity), F.col("g.kind").alias("type"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), (F.lit(as_of).cast("bigint") - F.col("last")).alias("seconds_since_last"),
        F.coalesce("total", F.lit(0)).cast("decimal(38,0)").alias("total"),
    )
