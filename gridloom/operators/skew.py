"""Per-key results when a few keys hold most records: value-frequency compression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.shared import written

BANDS = 64
#: A band with more different values of a key is split again, into SPLIT parts of equal width, until none has more.
BAND_VALUES = 1_000_000
SPLIT = 4_096


def value_frequencies(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(key_field, key_value, value, n): how often each key has each value.

    One pass over the rows for all key fields. Grouping by key AND value first is what removes the imbalance: partial
    counts are formed before the shuffle, and a hot key's values spread over all partitions. NULL keys and NULL values
    are groups of their own.
    """
    pair = F.explode(F.array(*(F.struct(F.lit(k).alias("key_field"), F.col(k).cast("string").alias("key_value")) for k in keys)))
    rows = df.select(F.col(value).cast("bigint").alias("value"), pair.alias("p")).select("p.key_field", "p.key_value", "value")
    return rows.groupBy("key_field", "key_value", "value").agg(F.count(F.lit(1)).alias("n"))


def key_counts(frequencies: DataFrame) -> DataFrame:
    """(key_field, key_value, rows, distinct_values, mode, mode_rows) from weighted values; exact.

    The mode is the most frequent value, the smallest of them on a tie, NULL if the key has no value. All aggregates
    are decomposable, so a key's partial results merge before the shuffle.
    """
    best = F.when(F.col("value").isNotNull(), F.struct(F.col("n"), F.negative(F.col("value").cast("decimal(20,0)")).alias("v")))
    return (
        frequencies.groupBy("key_field", "key_value")
        .agg(F.sum("n").alias("rows"), F.count("value").alias("distinct_values"), F.max(best).alias("m"))
        .select("key_field", "key_value", "rows", "distinct_values", F.negative(F.col("m.v")).cast("bigint").alias("mode"), F.col("m.n").alias("mode_rows"))
    )


def _band(value: Column) -> Column:
    """An order-preserving coarse code of a number: BANDS to an octave, so a key has a bounded number of bands."""
    size = 1 + F.floor(F.log2(F.abs(value.cast("double"))) * BANDS)
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value.cast("double")) * size).cast("int")


def weighted_percentiles(frequencies: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """(key_field, key_value, q, value): exact percentiles of the weighted values, interpolated between neighbours.

    ``frequencies`` hold each key and value once. First the counts per band of values (decomposable; at most some thousand
    bands per key) give each band's offset and so the bands that hold the wanted positions; of these, bands with more
    than BAND_VALUES different values are split again (fewer than values / BAND_VALUES exist, so they are broadcast)
    until all are smaller; only these bands' values are then put in order, per key and band. So a hot key is never sorted
    in one task, however close its values lie. Keys without values have no rows.
    """
    keys = ["key_field", "key_value"]
    f = frequencies.filter(F.col("value").isNotNull()).select(*(F.coalesce(k, F.lit("\0null")).alias(k) for k in keys), "value", "n", _band(F.col("value")).alias("band"))
    f = f.withColumn("part", F.lit(0).cast("bigint"))

    def counted(rows: DataFrame, *extra: str) -> DataFrame:
        return rows.groupBy(*keys, "band", "part", *extra).agg(F.sum("n").alias("here"), F.count(F.lit(1)).alias("values"), F.min("value").alias("lo"), F.max("value").alias("hi"))

    of = Window.partitionBy(*keys)
    bands = counted(f)
    bands = bands.select("*", F.sum("here").over(of).alias("total"), (F.sum("here").over(of.orderBy("band").rowsBetween(Window.unboundedPreceding, 0)) - F.col("here")).alias("before"))
    wanted = bands.withColumn("q", F.explode(F.array(*(F.lit(float(q)) for q in quantiles)))).withColumn("at", F.col("q") * (F.col("total") - 1).cast("double"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor("at").cast("bigint").alias("pos")), F.struct(F.lit(1).alias("side"), F.ceil("at").cast("bigint").alias("pos"))))
    columns = [*keys, "band", "part", "before", "here", "values", "lo", "hi", "q", "at", "side", "pos"]
    holds = (F.col("pos") >= F.col("before")) & (F.col("pos") < F.col("before") + F.col("here"))
    wanted = written(wanted.withColumn("s", sides).select(*columns[:-2], "s.side", "s.pos").filter(holds), "bands")
    small, large = wanted.filter(F.col("values") <= BAND_VALUES), wanted.filter(F.col("values") > BAND_VALUES)
    found = [_within(f, small, broadcast=False)]
    while large.limit(1).count():
        # inside the large bands: parts of equal width, and the one that holds each position
        place = [*keys, "band", "lo", "hi", "before"]
        l, r = large.select(*place).distinct().alias("l"), f.drop("part").alias("r")
        inside = r.join(F.broadcast(l), [*keys, "band"]).filter((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")))
        width = F.expr(f"(hi - lo) div {SPLIT} + 1")
        parts = inside.select(*keys, "band", "before", F.col("lo").alias("from"), F.expr("value").alias("value"), "n", ((F.col("value") - F.col("lo")) / width).cast("bigint").alias("part"))
        parts = counted(parts, "from", "before")
        along = Window.partitionBy(*keys, "band", "from").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        parts = parts.withColumn("before", F.col("before") + F.sum("here").over(along) - F.col("here"))
        p, w = parts.alias("p"), large.alias("w")
        same = (F.col("p.key_field") == F.col("w.key_field")) & (F.col("p.key_value") == F.col("w.key_value")) & (F.col("p.band") == F.col("w.band")) & (F.col("p.from") == F.col("w.lo"))
        finer = p.join(w, same).select("p.key_field", "p.key_value", "p.band", "p.part", "p.before", "p.here", "p.values", "p.lo", "p.hi", "w.q", "w.at", "w.side", "w.pos").filter(holds)
        finer = written(finer, "bands")
        found.append(_within(f, finer.filter(F.col("values") <= BAND_VALUES), broadcast=True))
        large = finer.filter(F.col("values") > BAND_VALUES)
    hit = found[0]
    for more in found[1:]:
        hit = hit.unionByName(more)
    both = hit.groupBy(*keys, "q", "at").agg(F.max(F.when(F.col("side") == 0, F.col("value"))).alias("lo"), F.max(F.when(F.col("side") == 1, F.col("value"))).alias("hi"))
    low, high = F.col("lo").cast("double"), F.col("hi").cast("double")
    return both.select("key_field", F.when(F.col("key_value") != "\0null", F.col("key_value")).alias("key_value"), "q", (low + (high - low) * (F.col("at") - F.floor("at"))).alias("value"))


def _within(f: DataFrame, wanted: DataFrame, broadcast: bool) -> DataFrame:
    """(keys, q, at, side, value) of the positions ``wanted`` in bands small enough to be put in order."""
    on = ["key_field", "key_value", "band"]
    places = wanted.select(*on, "lo", "hi", "before").distinct()
    inside = f.join(F.broadcast(places) if broadcast else places, on).filter((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")))
    upto = F.sum("n").over(Window.partitionBy(*on, "lo").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.select(*on, "lo", "value", "n", (F.col("before") + upto).alias("upto"))
    hit = inside.join(wanted.select(*on, "lo", "q", "at", "side", "pos"), [*on, "lo"])
    return hit.filter((F.col("pos") < F.col("upto")) & (F.col("pos") >= F.col("upto") - F.col("n"))).select("key_field", "key_value", "q", "at", "side", "value")


def key_profiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """Per key: rows, exact distinct count, mode and exact percentiles of ``value``, however the rows are spread.

    Result columns: those of :func:`key_counts` and p<100q> for each quantile (NULL for a key without values).
    """
    f = written(value_frequencies(df, keys, value), "frequencies")
    p = weighted_percentiles(f, quantiles)
    names = {float(q): f"p{round(q * 100)}" for q in quantiles}
    wide = p.groupBy("key_field", "key_value").agg(*(F.max(F.when(F.col("q") == q, F.col("value"))).alias(name) for q, name in names.items())).alias("w")
    c = key_counts(f).alias("c")
    same = (F.col("c.key_field") == F.col("w.key_field")) & F.col("c.key_value").eqNullSafe(F.col("w.key_value"))
    return c.join(wide, same, "left").select("c.*", *names.values())


def heavy_keys(counts: DataFrame, share: float) -> DataFrame:
    """Keys of :func:`key_counts` that hold at least ``share`` of all rows: exact, fewer than 1 / share per field.

    The counts are written, one row per key, so that the rows are read once.
    """
    counts = written(counts, "key_counts")
    per_field = counts.groupBy("key_field").agg(F.sum("rows").alias("all_rows"))
    return counts.join(F.broadcast(per_field), "key_field").filter(F.col("rows") >= F.lit(share) * F.col("all_rows")).drop("all_rows")
