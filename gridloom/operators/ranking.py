"""Places in a total order without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.shared import written


def numbered(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """``df`` with the place (1, 2, ...) of every row in the order given; ties get neighbouring places.

    A range shuffle and a sort inside each partition; a row's place is its partition's offset (a sum over one count per
    partition, which is all that is broadcast) plus its index there. An empty table stays empty.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = "__at"
    rows = written(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(at, 33)
    counts = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))
    joined = rows.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return joined.withColumn(name, F.col("__before") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__part", "__before", at)
