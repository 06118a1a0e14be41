"""Rolling totals over trailing periods: a two-stack monoid queue per entity on dense days."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sums are carried as two limbs, value = high * 2**LIMB_BITS + low, so that no 64-bit sum can overflow.
LIMB_BITS = 30
#: Cells (entities x days) handled at once in a Python worker.
CELLS = 1_000_000


class TwoStackQueue:
    """Sliding aggregate of any monoid, invertible or not, in amortised constant time per step.

    The back stack keeps one running aggregate, the front stack keeps suffix aggregates; when the front is empty the
    back is turned over into it.
    """

    def __init__(self, combine: Callable[[Any, Any], Any], identity: Any):
        self.combine, self.identity = combine, identity
        self.front: list[Any] = []
        self.back: list[Any] = []
        self.running = identity

    def push(self, value: Any) -> None:
        self.back.append(value)
        self.running = self.combine(self.running, value)

    def pop(self) -> None:
        if not self.front:
            total = self.identity
            while self.back:
                total = self.combine(self.back.pop(), total)
                self.front.append(total)
            self.running = self.identity
        self.front.pop()

    def value(self) -> Any:
        return self.combine(self.front[-1], self.running) if self.front else self.running

    def __len__(self) -> int:
        return len(self.front) + len(self.back)


def sliding(days: np.ndarray, period: int, op: np.ufunc, identity: int) -> np.ndarray:
    """Trailing aggregates over ``period`` days for a matrix of entities x days.

    The same queue for all entities in step: since every day pushes once and pops once, the back stack is turned over
    every ``period`` days. ``back`` holds its running aggregates, ``front`` the suffix aggregates after each turn.
    """
    rows, n = days.shape
    if n == 0 or rows == 0:
        return days.copy()
    blocks = -(-n // period)
    full = np.full((rows, blocks * period), identity, days.dtype)
    full[:, :n] = days
    cube = full.reshape(rows, blocks, period)
    back = op.accumulate(cube, axis=2).reshape(rows, -1)
    front = op.accumulate(cube[:, :, ::-1], axis=2)[:, :, ::-1].reshape(rows, -1)
    out = back[:, :n].copy()
    day = np.arange(period, n)
    day = day[(day + 1) % period != 0]
    if len(day):
        out[:, day] = op(front[:, day - period + 1], back[:, day])
    return out


def _dense(batches: Iterable[pa.RecordBatch], lo: int, hi: int, measures: Sequence[str], periods: Sequence[int], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches sorted by entity; each entity's daily rows become all days of [lo, hi] with its trailing aggregates."""
    span, held = hi - lo + 1, []
    at_once = max(1, CELLS // span)

    def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
        entity = table.column("entity").combine_chunks()
        codes = entity.dictionary_encode(null_encoding="encode")
        names, code = codes.dictionary, codes.indices.to_numpy()  # sorted input: an entity's rows lie together
        day = table.column("day").to_numpy() - lo
        inputs = {c: table.column(c).to_numpy() for c in table.column_names if c not in ("entity", "day")}
        for start in range(0, len(names), at_once):
            end = min(start + at_once, len(names))
            a, b = np.searchsorted(code, [start, end])
            r, d = code[a:b] - start, day[a:b]

            def matrix(c: str, empty: int) -> np.ndarray:
                m = np.full((end - start, span), empty, np.int64)
                m[r, d] = inputs[c][a:b]
                return m

            out: dict[str, Any] = {
                "entity": pa.DictionaryArray.from_arrays(np.repeat(np.arange(start, end, dtype=np.int32), span), names).cast(names.type),
                "day": np.tile(np.arange(lo, hi + 1, dtype=np.int32), end - start),
            }
            n = matrix("n", 0)
            out["n"] = n.ravel()
            for p in periods:
                out[f"n_{p}"] = sliding(n, p, np.add, 0).ravel()
            for m in measures:
                count = matrix(f"{m}_n", 0)
                out[f"{m}_n"] = count.ravel()
                counts = {p: sliding(count, p, np.add, 0) for p in periods}
                for p in periods:
                    out[f"{m}_n_{p}"] = counts[p].ravel()
                for limb in ("hi", "lo"):
                    x = matrix(f"{m}_{limb}", 0)
                    out[f"{m}_{limb}"] = x.ravel()
                    for p in periods:
                        out[f"{m}_{limb}_{p}"] = sliding(x, p, np.add, 0).ravel()
                least = np.iinfo(np.int64).min
                x = matrix(f"{m}_max", least)
                for p in periods:
                    out[f"{m}_max_{p}"] = pa.array(sliding(x, p, np.maximum, least).ravel(), mask=(counts[p] == 0).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name]) if not isinstance(out[f.name], pa.Array) else out[f.name] for f in schema], schema=schema)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        last, first = batch.column("entity")[batch.num_rows - 1], held[0].column("entity")[0]
        if last != first and sum(b.num_rows for b in held) * 2 > CELLS // max(1, span // 8):
            table = pa.Table.from_batches(held)
            names = table.column("entity").combine_chunks().dictionary_encode(null_encoding="encode")
            cut = int(np.searchsorted(names.indices.to_numpy(), len(names.dictionary) - 1))
            yield from emit(table.slice(0, cut))
            held = table.slice(cut).to_batches()
    if held:
        yield from emit(pa.Table.from_batches(held))


def trailing_totals(df: DataFrame, entity: str, day: str, measures: Sequence[str], periods: Sequence[int] = (7, 30), calendar: tuple[int, int] | None = None) -> DataFrame:
    """For every entity and every day of the calendar: totals, averages and maxima over trailing periods.

    ``df``: one row per event; ``day`` INT (days since 1970-01-01), ``measures`` BIGINT columns.
    ``calendar``: first and last day; by default those of ``df`` (two numbers, read with one aggregate).
    Result: entity, day (DATE), n, per measure its total of the day, and per period ``n_P``, ``M_sum_P``
    (DECIMAL(38,0)), ``M_avg_day_P`` (total / days of the period that lie in the calendar), ``M_avg_row_P`` (total / rows
    with a value, NULL without any) and ``M_max_P`` (not invertible, NULL without a value).

    Plan: partial daily sums before the one shuffle on the entity, so a hot entity sends at most one row a day and map
    task; then the queue runs over sorted partitions in Arrow batches. Defined cases: NULL entity is an entity of its
    own; rows with a NULL day or a day outside the calendar belong to no day and are left out; NULL measures count as
    rows but not as values; an empty table gives no rows. Other columns of ``df`` are ignored.
    """
    names = [f"m{i}" for i in range(len(measures))]
    daily = df.select(F.col(entity).alias("entity"), F.col(day).cast("int").alias("day"), *(F.col(m).cast("bigint").alias(k) for m, k in zip(measures, names)))
    if calendar is None:
        calendar = tuple(daily.agg(F.min("day"), F.max("day")).first())
    kind = daily.schema["entity"].dataType
    lo, hi = calendar
    if lo is None:
        lo, hi = 0, -1
    aggregates = [F.count(F.lit(1)).alias("n")]
    for k in names:
        aggregates += [
            F.count(k).alias(f"{k}_n"),
            F.coalesce(F.sum(F.shiftright(k, LIMB_BITS)), F.lit(0)).cast("bigint").alias(f"{k}_hi"),
            F.coalesce(F.sum(F.col(k).bitwiseAND(F.lit(2**LIMB_BITS - 1))), F.lit(0)).cast("bigint").alias(f"{k}_lo"),
        ]
        # the least value stands for a day without one
        aggregates.append(F.coalesce(F.max(k), F.lit(-(2**63)).cast("bigint")).alias(f"{k}_max"))
    daily = daily.filter(F.col("day").between(lo, hi)).groupBy("entity", "day").agg(*aggregates)

    fields = [T.StructField("entity", kind), T.StructField("day", T.IntegerType()), T.StructField("n", T.LongType())]
    fields += [T.StructField(f"n_{p}", T.LongType()) for p in periods]
    for k in names:
        fields += [T.StructField(f"{k}_{x}{'' if p is None else f'_{p}'}", T.LongType()) for p in (None, *periods) for x in ("n", "hi", "lo", "max") if (p, x) != (None, "max")]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        return _dense(batches, lo, hi, names, periods, to_arrow_schema(schema))

    dense = daily.repartition(F.col("entity")).sortWithinPartitions("entity", "day").mapInArrow(run, schema)

    def whole(k: str, p: str = "") -> Any:
        return (F.col(f"{k}_hi{p}").cast("decimal(20,0)") * F.lit(2**LIMB_BITS) + F.col(f"{k}_lo{p}")).cast("decimal(38,0)")

    out = [F.col("entity").alias(entity), F.date_from_unix_date("day").alias("day"), F.col("n")]
    out += [whole(k).alias(f"{m}_sum") for m, k in zip(measures, names)]
    for p in periods:
        there = F.least(F.lit(p), F.col("day") - F.lit(lo) + 1)
        out.append(F.col(f"n_{p}"))
        for m, k in zip(measures, names):
            total = whole(k, f"_{p}")
            out += [
                total.alias(f"{m}_sum_{p}"),
                (total.cast("double") / there.cast("double")).alias(f"{m}_avg_day_{p}"),
                F.when(F.col(f"{k}_n_{p}") > 0, total.cast("double") / F.col(f"{k}_n_{p}").cast("double")).alias(f"{m}_avg_row_{p}"),
                F.col(f"{k}_max_{p}").alias(f"{m}_max_{p}"),
            ]
    return dense.select(*out)
