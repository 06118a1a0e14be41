"""Implausible readings per source: peaks over threshold on seasonal residuals, stuck values, physical bounds.

Every source's readings are compared with its own behaviour:

* residual = log(reading) - local level - hour-of-day effect. The local level is the median of the source's 32
  consecutive positive readings around it, so lasting level changes and the daily rhythm are taken out.
* Peaks over threshold: exceedances of a high threshold, declustered (neighbouring exceedances count once), are fitted
  with a generalized Pareto tail by moments (trimmed against contamination). Scale and shape are each source's own, shrunk:
  the scale towards that of all sources by PRIOR exceedances, the shape towards PRIOR_SHAPE by SHAPE_WEIGHT exceedances. The
  cutoff is where the source's tail has probability RISK, and nothing else decides about spikes.
* A source with at least LEAST_BURSTS bursts (residuals of all of a tick's readings beyond BURST, declustered) that are at
  least BURST_SHARE of its ticks has bursts as its habit; its threshold then is the median of these bursts, otherwise the 90 % point of all residuals.
* Drops are the same on the other tail, with the residuals' sign turned: idle draws are a habit as bursts are.
* Stuck: a run of equal readings much longer than the source's other runs, on a value it hardly has elsewhere.
* Physical: a reading below zero.

Scale: a source's readings are split into time chunks before the one shuffle when it holds many rows, the sorted chunks
are streamed through Arrow batches, and all that leaves a chunk are histograms of residuals (bounded bins), candidate
rows, long runs and, of a source in several chunks, the counts of its values; runs that cross a chunk's edge are joined
again, and all that a run is compared with is of the whole source.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.shared import written

BLOCK = 32  # consecutive positive readings that share a local level
BINS = 16  # histogram bins per unit of log
BURST = float(np.log(3.5))
BURST_SHARE = 0.05
LEAST_BURSTS = 3
BULK_QUANTILE = 0.9
TRIM = float(np.log(4.0))  # excesses beyond are set aside when the tail is fitted
PRIOR = 10.0  # weight of all sources' scale, in exceedances
PRIOR_SHAPE, SHAPE_WEIGHT = -0.15, 300.0  # shape a source has before it is seen, and its weight in exceedances
LEAST_SHAPE, MOST_SHAPE = -0.2, 0.5  # moments of trimmed, binned excesses are no evidence of a shorter tail than that
RISK = 1e-5  # of a normal reading to lie beyond its source's cutoff
LEAST_TICKS = 30
STUCK_LENGTH = 9
STUCK_RATIO = 2.5  # against the source's longest other run
STUCK_ELSEWHERE = 0.05  # share of the other readings that may have the stuck value
STUCK_CHANCE = 3  # so many of them may have it in any case
STUCK_HABIT = 0.85
CHUNK_ROWS = 50_000
BUFFER_ROWS = 200_000
HEAVY_PARTS = 100_000  # fewer sources than this can hold more than 1 / HEAVY_PARTS of all rows: the broadcast's bound
PIECE_ROWS = 400_000

_SCHEMA = "kind int, source string, chunk int, piece int, metric int, id bigint, bin int, n bigint, r double, run int, value double, same bigint, other bigint, is_first boolean, is_last boolean, multi boolean"
_ARROW = pa.schema(
    [
        ("kind", pa.int32()), ("source", pa.string()), ("chunk", pa.int32()), ("piece", pa.int32()), ("metric", pa.int32()), ("id", pa.int64()), ("bin", pa.int32()), ("n", pa.int64()),
        ("r", pa.float64()), ("run", pa.int32()), ("value", pa.float64()), ("same", pa.int64()), ("other", pa.int64()), ("is_first", pa.bool_()), ("is_last", pa.bool_()), ("multi", pa.bool_()),
    ]
)
HISTOGRAM, CANDIDATE, RUN, MEMBER, TICKS, READINGS, VALUES = range(7)


def _medians(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Median per group; ``group`` is non-decreasing and has no gaps."""
    order = np.lexsort((values, group))
    v = values[order]
    size = np.bincount(group, minlength=groups)
    start = np.cumsum(size) - size
    return (v[start + (size - 1) // 2] + v[start + size // 2]) / 2


def residuals(value: np.ndarray, segment: np.ndarray, hour: np.ndarray) -> np.ndarray:
    """Seasonal residuals of positive readings in time order; ``segment`` numbers the sources, non-decreasing."""
    n = len(value)
    if n == 0:
        return np.zeros(0)
    log = np.log(value)
    seg = np.unique(segment, return_inverse=True)[1]
    size = np.bincount(seg)
    start = np.cumsum(size) - size
    rank = np.arange(n) - start[seg]
    blocks = np.maximum(1, (size + BLOCK // 2) // BLOCK)  # a rest of less than half a block joins the block before
    block = np.minimum(rank // BLOCK, blocks[seg] - 1) + (np.cumsum(blocks) - blocks)[seg]
    r = log - _medians(log, block, int(blocks.sum()))[block]
    cell = seg * 24 + hour
    count = np.bincount(cell, minlength=len(size) * 24)
    effect = np.bincount(cell, np.clip(r, -1, 1), minlength=len(size) * 24) / (count + 8)
    return r - effect[cell]


def _exceedances(r: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Which residuals are peaks: above their segment's BULK_QUANTILE, or beyond BURST."""
    if not len(r):
        return np.zeros(0, bool)
    seg = np.unique(segment, return_inverse=True)[1]
    order = np.lexsort((r, seg))
    size = np.bincount(seg)
    at = np.minimum(size - 1, np.ceil(BULK_QUANTILE * size).astype(np.int64) - 1)
    bulk = r[order][np.cumsum(size) - size + np.maximum(at, 0)]
    return (r > np.minimum(bulk[seg], BURST)) & (r > 0)


def _segments(t: pa.Table, piece: int, cut: bool, metrics: int, sides: int) -> Iterator[pa.RecordBatch]:
    """All results of complete (source, chunk) segments, or of one ``piece`` of a segment that is ``cut``.

    Peaks of the lower tail (``sides`` 2) have the metric's number plus ``metrics``.
    """
    n = t.num_rows
    source = t.column("source").combine_chunks().dictionary_encode()
    names, src = source.dictionary, source.indices.to_numpy().astype(np.int64)
    chunk, event, ids = (t.column(c).to_numpy() for c in ("chunk", "event", "id"))
    ts = t.column("ts").to_numpy()
    many = t.column("many").to_numpy(zero_copy_only=False) | cut | (piece > 0)
    new = np.r_[True, (src[1:] != src[:-1]) | (chunk[1:] != chunk[:-1])]
    first = new | np.r_[True, event[1:] != event[:-1]]
    owner = np.cumsum(first) - 1
    at = np.flatnonzero(first)
    seg = (np.cumsum(new) - 1)[at]
    src1, chunk1, ts1, multi1 = src[at], chunk[at], ts[at], many[at]
    seg_start = np.flatnonzero(new)

    def batch(kind: int, row_src: np.ndarray, row_chunk: np.ndarray, **cols: np.ndarray) -> pa.RecordBatch:
        m = len(row_src)
        arrays = []
        for f in _ARROW:
            if f.name == "kind":
                arrays.append(pa.array(np.full(m, kind, np.int32)))
            elif f.name == "source":
                arrays.append(pa.DictionaryArray.from_arrays(row_src.astype(np.int32), names).cast(pa.string()))
            elif f.name == "chunk":
                arrays.append(pa.array(row_chunk.astype(np.int32)))
            elif f.name == "piece":
                arrays.append(pa.array(np.full(m, piece, np.int32)))
            elif f.name in cols:
                arrays.append(pa.array(np.asarray(cols[f.name]), f.type))
            else:
                arrays.append(pa.nulls(m, f.type))
        return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)

    ticks = np.bincount(seg)
    yield batch(TICKS, src[seg_start], chunk[seg_start], n=ticks)

    # a burst raises all of a tick's readings together, a fault of the meter often only one
    taken: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    positive, high_ones = np.zeros(len(at), np.int64), np.zeros((sides, len(at)), np.int64)
    for metric in range(metrics):
        column = t.column(f"m{metric}").combine_chunks()
        there = column.is_valid().to_numpy(zero_copy_only=False)[at]
        v = column.fill_null(0).to_numpy().astype(np.float64)[at]
        on = np.flatnonzero(there & (ts1 > 0))
        change = np.r_[True, (seg[on][1:] != seg[on][:-1]) | (v[on][1:] != v[on][:-1])][: len(on)]
        start = np.flatnonzero(change)
        length = np.diff(np.r_[start, len(on)])
        # readings that may be stuck say nothing about levels, unless most of the source's readings are like that
        dull = np.zeros(len(at), bool)
        dull[on] = (length >= STUCK_LENGTH)[np.cumsum(change) - 1] if len(on) else False
        usual = np.bincount(seg, dull, minlength=len(ticks)) * 2 > ticks
        pos = np.flatnonzero(there & (v > 0) & (~dull | usual[seg]))
        r = residuals(v[pos], seg[pos], (np.maximum(ts1[pos], 0) // 3600) % 24)
        positive[pos] += 1
        for side in range(sides):
            high_ones[side, pos[(r if side == 0 else -r) > BURST]] += 1
        taken.append((there, v, pos, r, on, change, start, length))
    joint = high_ones == positive

    for metric, (there, v, pos, r, on, change, start, length) in enumerate(taken):
        for side in range(sides):
            x, number = (r, metric) if side == 0 else (-r, metric + metrics)
            high = x > BURST
            again = np.r_[False, high[:-1] & (seg[pos][1:] == seg[pos][:-1])] & high if len(pos) else high
            bins = np.clip(np.floor(x * BINS), -1, 60 * BINS).astype(np.int64)
            key, count = np.unique((seg[pos] * 4096 + bins + 1)[~again] * 2 + (high & joint[side, pos])[~again], return_counts=True)
            s = seg_start[key // 8192]
            yield batch(HISTOGRAM, src[s], chunk[s], metric=np.full(len(key), number), bin=key // 2 % 4096 - 1, n=count, run=key % 2)

            flagged = np.full(len(at), np.nan)
            flagged[pos] = np.where(_exceedances(x, seg[pos]), x, np.nan)
            if side == 0:
                flagged[there & (v < 0)] = np.inf
            rows = np.flatnonzero(~np.isnan(flagged[owner]))
            yield batch(CANDIDATE, src[rows], chunk[rows], metric=np.full(len(rows), number), id=ids[rows], r=flagged[owner[rows]])

        if not len(on):
            continue
        run_seg, run_value = seg[on][start], v[on][start]
        head = np.r_[True, run_seg[1:] != run_seg[:-1]]
        tail = np.r_[run_seg[1:] != run_seg[:-1], True]
        multi = multi1[on][start]
        long = length >= STUCK_LENGTH
        edge = multi & (head | tail)
        other = np.zeros(len(ticks), np.int64)
        np.maximum.at(other, run_seg, np.where(long | edge, 0, length))  # how long the runs at an edge are shows when they are joined
        total = np.bincount(seg[on], minlength=len(ticks))
        yield batch(READINGS, src[seg_start], chunk[seg_start], metric=np.full(len(ticks), metric), n=total, other=other)
        # how often a run's value stands elsewhere in its segment
        order = np.lexsort((run_value, run_seg))
        same_group = np.r_[True, (run_seg[order][1:] != run_seg[order][:-1]) | (run_value[order][1:] != run_value[order][:-1])]
        g = np.cumsum(same_group) - 1
        sums = np.bincount(g, length[order])
        elsewhere = np.zeros(len(start), np.int64)
        elsewhere[order] = sums[g]
        elsewhere -= length
        heads = order[same_group]
        parts = multi[heads]
        s = seg_start[run_seg[heads[parts]]]
        yield batch(VALUES, src[s], chunk[s], metric=np.full(len(s), metric), value=run_value[heads[parts]], n=sums[parts].astype(np.int64))
        keep = np.flatnonzero(long | edge)
        if not len(keep):
            continue
        s = seg_start[run_seg[keep]]
        yield batch(
            RUN, src[s], chunk[s], metric=np.full(len(keep), metric), run=keep, value=run_value[keep], n=length[keep], same=elsewhere[keep],
            is_first=head[keep], is_last=tail[keep], multi=multi[keep],
        )
        run_of = np.full(len(at), -1, np.int64)
        run_of[on] = np.cumsum(change) - 1
        kept = np.zeros(len(start), bool)
        kept[keep] = True
        member = run_of[owner]
        rows = np.flatnonzero((member >= 0) & kept[np.maximum(member, 0)])
        yield batch(MEMBER, src[rows], chunk[rows], metric=np.full(len(rows), metric), id=ids[rows], run=member[rows])


def _stream(batches: Iterator[pa.RecordBatch], metrics: int, sides: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows = piece = 0

    def last_start(t: pa.Table) -> int:
        """Row where the last (source, chunk) segment begins."""
        src, chunk = t.column("source").combine_chunks().dictionary_encode().indices.to_numpy(), t.column("chunk").to_numpy()
        new = np.flatnonzero((src[1:] != src[:-1]) | (chunk[1:] != chunk[:-1]))
        return int(new[-1] + 1) if len(new) else 0

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < BUFFER_ROWS:
            continue
        t = pa.Table.from_batches(held)
        cut = last_start(t)
        if cut:
            before = t.slice(0, cut)
            if piece:  # the first segment is the end of one that was cut
                src, chunk = before.column("source"), before.column("chunk").to_numpy()
                codes = src.combine_chunks().dictionary_encode().indices.to_numpy()
                new = np.flatnonzero((codes[1:] != codes[:-1]) | (chunk[1:] != chunk[:-1]))
                end = int(new[0] + 1) if len(new) else before.num_rows
                yield from _segments(before.slice(0, end), piece, True, metrics, sides)
                before = before.slice(end)
                piece = 0
            if before.num_rows:
                yield from _segments(before, 0, False, metrics, sides)
            held, rows = t.slice(cut).to_batches(), t.num_rows - cut
        elif rows >= PIECE_ROWS:
            event = t.column("event").to_numpy()
            end = t.num_rows - 1
            while end > 1 and event[end] == event[end - 1]:
                end -= 1
            yield from _segments(t.slice(0, end), piece, True, metrics, sides)
            piece += 1
            held, rows = t.slice(end).to_batches(), t.num_rows - end
    if rows:
        t = pa.Table.from_batches(held)
        if piece:
            src, chunk = t.column("source").combine_chunks().dictionary_encode().indices.to_numpy(), t.column("chunk").to_numpy()
            new = np.flatnonzero((src[1:] != src[:-1]) | (chunk[1:] != chunk[:-1]))
            end = int(new[0] + 1) if len(new) else t.num_rows
            yield from _segments(t.slice(0, end), piece, True, metrics, sides)
            t = t.slice(end)
        if t.num_rows:
            yield from _segments(t, 0, False, metrics, sides)


def scan_sources(df: DataFrame, source: str, time: str, event: str, row: str, metrics: Sequence[str], drops: bool = False) -> DataFrame:
    """The streamed pass: histograms, candidates, runs and their members, written as one table with a folder for each kind."""
    e = F.xxhash64(F.coalesce(F.col(event).cast("string"), F.concat(F.lit("\0"), F.col(row).cast("string"))))
    rows = df.filter(F.col(source).isNotNull()).select(
        F.col(source).alias("source"), F.coalesce(F.col(time), F.lit(0)).cast("bigint").alias("ts"), e.alias("event"), F.col(row).cast("bigint").alias("id"), *(F.col(m).cast("bigint").alias(f"m{i}") for i, m in enumerate(metrics))
    )
    per = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("ts") > 0, F.col("ts"))).alias("lo"), F.max("ts").alias("hi"))
    least = max(CHUNK_ROWS, rows.count() // HEAVY_PARTS)
    heavy = per.filter(F.col("n") > least).select("source", "lo", F.ceil(F.col("n") / least).alias("chunks"), ((F.col("hi") - F.col("lo") + 1) / F.ceil(F.col("n") / least)).alias("width"))
    # ticks without a time belong to no chunk in particular: they are spread by event
    at = F.when(F.col("ts") > 0, F.floor((F.col("ts") - F.col("lo")) / F.col("width"))).otherwise(F.pmod("event", "chunks")).cast("int")
    rows = rows.join(F.broadcast(heavy), "source", "left").select("source", F.coalesce(at, F.lit(0)).alias("chunk"), F.col("chunks").isNotNull().alias("many"), "ts", "event", "id", *(f"m{i}" for i in range(len(metrics))))
    sorted_rows = rows.repartition("source", "chunk").sortWithinPartitions("source", "chunk", "ts", "event", "id")
    count, sides = len(metrics), 2 if drops else 1
    return written(sorted_rows.mapInArrow(lambda it: _stream(it, count, sides), _SCHEMA), "sources", ["kind"])


def tail_cutoffs(scan: DataFrame) -> DataFrame:
    """(source, metric, cut): the log residual beyond which a reading is implausible for the source."""
    h = scan.filter(F.col("kind") == HISTOGRAM).groupBy("source", "metric", "bin").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("run")).alias("joint"))
    of = Window.partitionBy("source", "metric")
    x = (F.col("bin") + 0.5) / BINS
    burst = F.sum("joint").over(of)
    alone = F.sum(F.when(x > BURST, F.col("n") - F.col("joint")).otherwise(0)).over(of)
    h = h.select("source", "metric", "n", x.alias("x"), F.sum("n").over(of).alias("total"), burst.alias("burst"), alone.alias("alone"), F.sum("n").over(of.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    h = h.withColumn("bursty", (F.col("burst") >= BURST_SHARE * F.col("total")) & (F.col("burst") >= LEAST_BURSTS))
    rank = F.when(F.col("bursty"), F.col("total") - F.col("alone") - F.col("burst") / 2).otherwise(BULK_QUANTILE * F.col("total"))
    h = h.withColumn("u", F.min(F.when(F.col("upto") >= rank, F.greatest("x", F.lit(0.0)))).over(of))
    y = F.col("x") - F.col("u")
    fit = (y > 0) & (y < TRIM)
    per = h.groupBy("source", "metric", "bursty", "total", "u").agg(
        F.sum(F.when(fit, F.col("n") * y).otherwise(0.0)).alias("sum_y"), F.sum(F.when(fit, F.col("n") * y * y).otherwise(0.0)).alias("sum_yy"), F.sum(F.when(fit, F.col("n")).otherwise(0)).alias("n_y"), F.sum(F.when(y > 0, F.col("n")).otherwise(0)).alias("above")
    )
    # the mean that a source's own is shrunk towards, and the source's own shape from its excesses' mean and spread
    pool = per.groupBy("bursty", "metric").agg((F.sum("sum_y") / F.greatest(F.sum("n_y"), F.lit(1))).alias("mean0"))
    per = per.join(F.broadcast(pool), ["bursty", "metric"])
    n = F.greatest("n_y", F.lit(1))
    mean = F.col("sum_y") / n
    spread = F.greatest(F.col("sum_yy") / n - mean * mean, F.lit(1e-9))
    own = F.greatest(F.least(0.5 * (1 - mean * mean / spread), F.lit(MOST_SHAPE)), F.lit(-2.0))
    shape = (F.when(F.col("n_y") > 1, F.col("n_y") * own).otherwise(F.col("n_y") * PRIOR_SHAPE) + SHAPE_WEIGHT * PRIOR_SHAPE) / (F.col("n_y") + SHAPE_WEIGHT)
    per = per.withColumn("shape", F.greatest(F.least(shape, F.lit(MOST_SHAPE)), F.lit(LEAST_SHAPE)))
    scale = (F.col("sum_y") + PRIOR * F.col("mean0")) / (F.col("n_y") + PRIOR) * (1 - F.col("shape"))
    share = F.greatest(F.col("above"), F.lit(1)) / F.col("total")
    times = F.greatest(F.log(share / RISK), F.lit(0.0))
    beyond = F.when(F.abs("shape") > 1e-6, (F.exp(times * F.col("shape")) - 1) / F.col("shape")).otherwise(times)
    return per.select("source", "metric", "bursty", "u", "shape", scale.alias("scale"), (F.col("u") + scale * beyond).alias("cut"))


def stuck_rows(scan: DataFrame) -> DataFrame:
    """(source, id, metric) of all ticks in stuck stretches."""
    place = ["source", "chunk", "piece", "metric", "run"]
    runs = scan.filter(F.col("kind") == RUN).select(*place, "value", F.col("n").alias("length"), "same", (F.col("multi") & (F.col("is_first") | F.col("is_last"))).alias("edge"), "is_first", "is_last")
    along = Window.partitionBy("source", "metric").orderBy("chunk", "piece", "run")
    edges = runs.filter("edge")
    goes_on = F.col("is_first") & F.coalesce(F.lag("is_last").over(along), F.lit(False)) & F.coalesce(F.lag("value").over(along) == F.col("value"), F.lit(False))
    edges = edges.withColumn("root", F.sum(F.when(goes_on, 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    inner = runs.filter(~F.col("edge")).withColumn("root", F.lit(None).cast("bigint"))
    runs = edges.unionByName(inner).withColumn("key", F.when(F.col("root").isNotNull(), F.concat(F.lit("e"), F.col("root"))).otherwise(F.concat_ws("-", "chunk", "piece", "run")))
    whole = runs.groupBy("source", "metric", "key").agg(F.first("value").alias("value"), F.sum("length").alias("length"), F.sum("same").alias("same"))
    long = F.col("length") >= STUCK_LENGTH
    # a source in several segments: how often it has the value in all of them
    values = scan.filter(F.col("kind") == VALUES).select("source", "metric", "value", "n")
    values = values.join(whole.filter(long).select("source", "metric", "value").distinct(), ["source", "metric", "value"], "left_semi").groupBy("source", "metric", "value").agg(F.sum("n").alias("all"))
    whole = whole.join(values, ["source", "metric", "value"], "left").withColumn("same", F.coalesce(F.col("all") - F.col("length"), "same"))
    readings = scan.filter(F.col("kind") == READINGS).groupBy("source", "metric").agg(F.sum("n").alias("total"), F.max("other").alias("other"))
    whole = whole.join(readings, ["source", "metric"])
    rare = F.col("same") <= F.greatest(F.lit(STUCK_CHANCE), STUCK_ELSEWHERE * (F.col("total") - F.col("length")))
    habit = whole.groupBy("source", "metric").agg(
        F.sum(F.when(long, F.col("length")).otherwise(0)).alias("in_long"), F.max(F.when(long & ~rare, F.col("length")).otherwise(0)).alias("usual"), F.max(F.when(~long, F.col("length")).otherwise(0)).alias("short")
    )
    stuck = whole.join(habit, ["source", "metric"]).filter(long & rare & (F.col("length") >= STUCK_RATIO * F.greatest("other", "short", "usual")) & (F.col("in_long") <= STUCK_HABIT * F.col("total")))
    pieces = runs.join(stuck.select("source", "metric", "key"), ["source", "metric", "key"]).select(*place)
    return scan.filter(F.col("kind") == MEMBER).select(*place, "id").join(pieces, place).select("source", "id", "metric")


def implausible_rows(df: DataFrame, source: str, time: str, event: str, row: str, metrics: Sequence[str], drops: bool = False) -> DataFrame:
    """(id, source, metric, reason): rows with a spiking, impossible or stuck reading; with ``drops`` also those far below.

    ``df``: delivered rows; repeated deliveries of an ``event`` count once in all statistics and are flagged together.
    ``time``: epoch seconds, NULL if unknown (such a tick takes part in all but the stretches). Sources with fewer than
    LEAST_TICKS different ticks have no cases; NULL sources are left out; NULL readings are no readings (they neither
    break nor count in a stretch). A row may have several reasons; an empty table gives none. Reasons: 'spike', 'drop'
    (a positive reading beyond the lower tail's cutoff), 'impossible' (below zero), 'stuck'.
    """
    scan = scan_sources(df, source, time, event, row, metrics, drops)
    enough = scan.filter(F.col("kind") == TICKS).groupBy("source").agg(F.sum("n").alias("ticks")).filter(F.col("ticks") >= LEAST_TICKS).select("source")
    cuts = written(tail_cutoffs(scan).select("source", "metric", "cut"), "cutoffs")
    lowest = cuts.agg(F.min("cut")).first()[0]  # readings below every cutoff need not move
    peaks = scan.filter(F.col("kind") == CANDIDATE).select("source", "metric", "id", "r")
    peaks = peaks.filter((F.col("r") == float("inf")) | (F.col("r") > F.lit(lowest)))
    peaks = peaks.join(cuts, ["source", "metric"], "left")
    impossible = F.col("r") == float("inf")
    reason = F.when(impossible, "impossible").when(F.col("metric") < len(metrics), "spike").otherwise("drop")
    peaks = peaks.filter(impossible | (F.col("r") > F.col("cut"))).select("source", "id", (F.col("metric") % len(metrics)).alias("metric"), reason.alias("reason"))
    found = peaks.unionByName(stuck_rows(scan).withColumn("reason", F.lit("stuck")))
    names: Column = F.element_at(F.array(*(F.lit(m) for m in metrics)), F.col("metric") + 1)
    return found.join(enough, "source", "left_semi").select("id", F.col("source").alias(source), names.alias("metric"), "reason")
