"""Events delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_deliveries(df: DataFrame, event: str = "event_id", order: str = "id") -> DataFrame:
    """One row per event: the delivery with the smallest ``order``.

    One shuffle on the event itself, so no entity's size matters. A NULL event is an event of its own. Ties in
    ``order`` (not possible while it is unique) keep one of the tied rows. Columns stay as they are.
    """
    key, rank = "__event", "__delivery"
    own = F.coalesce(F.col(event).cast("string"), F.concat(F.lit("\0"), F.col(order).cast("string")))
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn(key, own).repartition(F.col(key)).withColumn(rank, F.row_number().over(w)).filter(F.col(rank) == 1).drop(key, rank)
