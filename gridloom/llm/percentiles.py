"""Exact percentiles of very large numeric columns: full distributed sort with per-partition counts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.shared import written

PART_ROWS = 4_000_000  # rows of a partition of the sort
RUNS = ["grp", "metric", "value", "n", "part", "upto"]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (grp, metric, value, n, part) rows of one partition become runs of equal values.

    ``upto`` counts the rows of the group and metric up to the run's end, in this partition. Needs one batch at a time:
    between batches only the last run is carried.
    """
    carry: tuple | None = None  # grp, metric, value, n, upto before the run, part
    schema = None
    for batch in batches:
        if not batch.num_rows:
            continue
        schema = schema or pa.schema([*[batch.schema.field(c) for c in RUNS[:5]], pa.field("upto", pa.int64())])
        grp = batch.column("grp").dictionary_encode(null_encoding="encode")
        metric = batch.column("metric").dictionary_encode(null_encoding="encode")
        g = grp.indices.to_numpy().astype(np.int64) * len(metric.dictionary) + metric.indices.to_numpy()
        v, n = batch.column("value").to_numpy(), batch.column("n").to_numpy()
        new_group = np.r_[True, g[1:] != g[:-1]]
        start = np.flatnonzero(new_group | np.r_[True, v[1:] != v[:-1]])
        total = np.add.reduceat(n, start)
        upto = np.cumsum(total)
        first = np.maximum.accumulate(np.where(new_group[start], np.arange(len(start)), 0))
        upto -= (upto - total)[first]
        key = [grp.dictionary[int(grp.indices[0].as_py())].as_py(), metric.dictionary[int(metric.indices[0].as_py())].as_py()]
        part = batch.column("part")[0].as_py()
        if carry is not None:
            if carry[:2] == (key[0], key[1]):
                before = carry[4]
                same = carry[2] == v[0]
                if not same:
                    before += carry[3]
                upto = np.where(first == 0, upto + before + (carry[3] if same else 0), upto)
                if same:
                    total[0] += carry[3]
                    carry = None
            if carry is not None:
                yield _rows([carry], schema)
        rows = batch.take(pa.array(start))
        end = len(start) - 1
        if end:
            yield pa.RecordBatch.from_arrays([*(rows.column(c).slice(0, end) for c in RUNS[:3]), pa.array(total[:end]), rows.column("part").slice(0, end), pa.array(upto[:end])], schema=schema)
        carry = (rows.column("grp")[end].as_py(), rows.column("metric")[end].as_py(), rows.column("value")[end].as_py(), int(total[end]), int(upto[end] - total[end]), part)
    if carry is not None:
        yield _rows([carry], schema)


def _rows(carries: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [[c[0] for c in carries], [c[1] for c in carries], [c[2] for c in carries], [c[3] for c in carries], [c[5] for c in carries], [c[4] + c[3] for c in carries]]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)


def sorted_runs(df: DataFrame, group: str, metrics: Sequence[str], weight: str | None = None, partitions: int | None = None, spread: str | None = None) -> DataFrame:
    """The full distributed sort: runs (grp, metric, value, n) of all values, sorted over numbered partitions, written.

    This table is also the state to keep per day or partition: such tables can be united (:func:`combine_runs`) and
    give the same percentiles as all rows at once. NULL values are left out (they have no place in the order), NULL
    groups form a group. Metrics must be BIGINT. A hash of ``spread`` (a row id) or else a random number breaks ties between equal values, so one value that
    holds a third of all rows is spread over partitions, too.
    """
    w = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    tie = F.rand(7) * 1024 if spread is None else F.pmod(F.xxhash64(spread), F.lit(1024))
    # written, as the range shuffle reads its input twice: for the ranges' bounds and for the rows
    rows = written(df.select(F.col(group).cast("string").alias("grp"), w.alias("n"), tie.cast("int").alias("tie"), *(F.col(m).cast("bigint").alias(f"m{k}") for k, m in enumerate(metrics))), "rows")
    pair = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"m{k}").alias("value")) for k, m in enumerate(metrics))))
    long = rows.select("grp", "n", "tie", pair.alias("p")).select("grp", "p.metric", "p.value", "n", "tie")
    return _sort(long.filter(F.col("value").isNotNull() & (F.col("n") > 0)), partitions or _parts(rows, len(metrics)))


def _parts(rows: DataFrame, times: int = 1) -> int:
    """Partitions for a written table: the session's number, or more so that each gets about PART_ROWS rows."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() * times // PART_ROWS + 1)


def _sort(long: DataFrame, count: int) -> DataFrame:
    by = ["grp", "metric", "value", "tie"]
    parts = long.repartitionByRange(count, *by).sortWithinPartitions("grp", "metric", "value")
    numbered = parts.select("grp", "metric", "value", "n", F.spark_partition_id().alias("part"))
    return written(numbered.mapInArrow(_runs, "grp string, metric string, value bigint, n bigint, part int, upto bigint"), "runs")


def combine_runs(*states: DataFrame, partitions: int | None = None) -> DataFrame:
    """One sorted table of runs from several, of other days or partitions."""
    all_rows = states[0].select(RUNS[:4])
    for s in states[1:]:
        all_rows = all_rows.unionByName(s.select(RUNS[:4]))
    return _sort(all_rows.withColumn("tie", F.lit(0)), partitions or _parts(all_rows))


def percentiles_of_runs(runs: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """(grp, metric, n, q, value): exact percentiles, interpolated between neighbouring order statistics.

    Per partition, group and metric one count; their prefix sums are each partition's offset in the group; every
    quantile's position q * (n - 1) then lies in known partitions, and the run there that covers it holds the value. The
    error is 0 (besides the rounding of the interpolation in DOUBLE).
    """
    counts = runs.groupBy("grp", "metric", "part").agg(F.max("upto").alias("here"))
    inside = Window.partitionBy("grp", "metric")
    offsets = counts.select("*", (F.sum("here").over(inside.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("here")).alias("before"), F.sum("here").over(inside).alias("total"))
    q = F.explode(F.array(*(F.lit(float(x)) for x in quantiles)))
    wanted = offsets.withColumn("q", q).withColumn("at", F.col("q") * (F.col("total") - 1).cast("double"))
    place = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor("at").cast("bigint").alias("pos")), F.struct(F.lit(1).alias("side"), F.ceil("at").cast("bigint").alias("pos"))))
    wanted = wanted.withColumn("p", place).select("grp", "metric", "part", "total", "q", "at", F.col("p.side").alias("side"), (F.col("p.pos") - F.col("before")).alias("pos")).filter((F.col("pos") >= 0) & (F.col("pos") < F.col("here")))
    r, t = runs.alias("r"), wanted.alias("t")
    hit = F.col("r.grp").eqNullSafe(F.col("t.grp")) & (F.col("r.metric") == F.col("t.metric")) & (F.col("r.part") == F.col("t.part")) & (F.col("pos") < F.col("upto")) & (F.col("pos") >= F.col("upto") - F.col("n"))
    found = r.join(t, hit).select("t.grp", "t.metric", "t.total", "t.q", "t.at", "t.side", "r.value")
    both = found.groupBy("grp", "metric", "total", "q", "at").agg(F.max(F.when(F.col("side") == 0, F.col("value"))).alias("lo"), F.max(F.when(F.col("side") == 1, F.col("value"))).alias("hi"))
    low, high = F.col("lo").cast("double"), F.col("hi").cast("double")
    return both.select("grp", "metric", F.col("total").alias("n"), "q", (low + (high - low) * (F.col("at") - F.floor("at"))).alias("value"))


def group_percentiles(df: DataFrame, group: str, metrics: Sequence[str], quantiles: Sequence[float] = (0.5,), weight: str | None = None, partitions: int | None = None, spread: str | None = None) -> DataFrame:
    """Exact percentiles per group, straight from rows (weights allowed). Empty input gives no rows."""
    return percentiles_of_runs(sorted_runs(df, group, metrics, weight, partitions, spread), quantiles)
