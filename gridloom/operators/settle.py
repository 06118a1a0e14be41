"""Settlement of delivered ticks in order of arrival: sequence guard and unique events, exact, in windows of bounded size.

A tick is accepted unless (REPLAY) its sequence is above zero and not above the consumer's last accepted one, or
(DUPLICATE_EVENT) its event was accepted before; the guard is tested first and a replayed event stays free. A sequence of
zero or less always passes the guard and resets it. Both rules interact only at events delivered several times with a
sequence above zero ("knots"), at one consumer or several. Everything between two knots is one associative step of the
guard (a segmented maximum):

1. repeated events whose every delivery has a sequence <= 0: the first arrival wins, later ones are duplicates;
2. a consumer with many rows is cut into blocks by arrival; per consumer, block and stretch between knots: the stretch's step;
3. which delivery of a knot's event is accepted is found by iteration: with the deliveries taken for duplicates set aside,
   windows give the guard before every knot, and of each event's deliveries that pass the first is the accepted one,
   until nothing changes. A tick's verdict depends on earlier ticks only, so what doesn't change is the sequential
   fold's result. Replayed deliveries never change the guard, so a few rounds are enough unless knots decide about knots;
4. with the duplicates and the guard at each block's beginning as additional rows, a running maximum decides about every tick.

No window spans more than a block of one consumer, one event's deliveries, or one row per block of one consumer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.shared import written

BLOCK = 100_000  # rows of a consumer beyond which it is cut into blocks; fewer than rows / BLOCK consumers are, which bounds what is broadcast
OK, REPLAY, DUPLICATE, QUARANTINED = "OK", "REPLAY", "DUPLICATE_EVENT", "QUARANTINED"
_BEFORE = -(2**63)  # in the place of ``id``: before all rows


def _bad(ticks: DataFrame):
    bad = F.lit(False)
    for c in ("units_drawn", "cost"):
        if c in ticks.columns:
            bad = bad | F.col(c).isNull()
    return bad


def heavy_consumers(rows: DataFrame, consumer: str = "consumer", order: str = "id") -> DataFrame:
    """(__consumer, __lo, __width): consumers with more than BLOCK rows, and the arrivals each of their blocks spans; written."""
    per = rows.groupBy(F.col(consumer).alias("__consumer")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("__lo"), F.max(order).alias("hi"))
    return written(per.filter(F.col("n") > BLOCK).select("__consumer", "__lo", F.expr(f"(hi - __lo) div ceil(n / {BLOCK}) + 1").cast("bigint").alias("__width")), "heavy")


def in_blocks(rows: DataFrame, heavy: DataFrame, consumer: str = "consumer", order: str = "id", name: str = "block") -> DataFrame:
    """``rows`` with a column ``name``: 0, or for a consumer with many rows the part by arrival, of about BLOCK rows if these arrive evenly."""
    out = rows.join(F.broadcast(heavy), F.col(consumer).eqNullSafe(F.col("__consumer")), "left")
    return out.withColumn(name, F.coalesce(F.expr(f"({order} - __lo) div __width"), F.lit(0).cast("bigint"))).drop("__consumer", "__lo", "__width")


def _repeated(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """(id, consumer, block, event, seq, known, knot): the deliveries of events that are delivered again or known, written. Others need no look at events."""
    of_event = Window.partitionBy("event")
    good = rows.select("*", F.count(F.lit(1)).over(of_event).alias("copies"), F.max("seq").over(of_event).alias("top_seq"))
    if known is None:
        good = good.withColumn("known", F.lit(False))
    else:
        before = known.select(F.col("event_id").alias("event"), F.lit(True).alias("k")).filter("event IS NOT NULL").distinct()
        good = good.join(before, "event", "left").withColumn("known", F.coalesce("k", F.lit(False))).drop("k")
    good = good.filter(F.col("known") | (F.col("copies") > 1))
    return written(good.select("id", "consumer", "block", "event", "seq", "known", (F.col("known") | (F.col("top_seq") > 0)).alias("knot")), "repeated")


def _guards(steps: DataFrame, knots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Guard before every knot, and before every block, given which knots are set aside (``aside``)."""
    key = ["consumer", "block"]
    none = F.lit(None)
    row = steps.select(*key, "id", none.cast("string").alias("event"), none.cast("bigint").alias("seq"), none.cast("boolean").alias("known"), none.cast("boolean").alias("aside"), "resets", F.when(F.col("resets"), F.col("tail")).otherwise(F.col("top")).alias("value"))
    knot = knots.select(*key, "id", "event", "seq", "known", "aside", (~F.col("aside") & (F.col("seq") <= 0)).alias("resets"), F.when(~F.col("aside"), F.col("seq")).alias("value"))
    here = Window.partitionBy(*key).orderBy("id")
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = row.unionByName(knot).withColumn("segment", F.sum(F.col("resets").cast("int")).over(upto))
    inside = Window.partitionBy(*key, "segment").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("floor", F.max("value").over(inside))
    blocks = rows.groupBy(*key).agg((F.max("segment") > 0).alias("resets"), F.max(F.when(F.col("value").isNotNull(), F.struct("segment", "value")))["value"].alias("tail"), F.max("value").alias("top"))
    along = Window.partitionBy("consumer").orderBy("block")
    blocks = blocks.withColumn("segment", F.sum(F.col("resets").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    after = F.max(F.when(F.col("resets"), F.col("tail")).otherwise(F.col("top"))).over(Window.partitionBy("consumer", "segment").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    blocks = blocks.withColumn("after", after).select(*key, F.lag("after").over(along).alias("carry"))
    at_knots = rows.filter("event IS NOT NULL").join(blocks, key, "left")
    guard = F.greatest("floor", F.when(F.col("segment") == 0, F.col("carry")))
    return at_knots.select(*key, "id", "event", "seq", "known", "aside", guard.alias("guard")), blocks.filter("carry IS NOT NULL")


def _resolved(good: DataFrame, knots: DataFrame, early: DataFrame, seeds: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(consumer, block, id) of the knots that are duplicates, and the guard at each block's beginning (``carry``)."""
    key = ["consumer", "block"]
    none = F.lit(None)
    rows = good.select(*key, "id", "seq", none.cast("string").alias("mark"))
    marks = knots.select(*key, "id", "seq", F.lit("knot").alias("mark")).unionByName(early.select(*key, "id", none.cast("bigint").alias("seq"), F.lit("early").alias("mark")))
    if seeds is not None:
        rows = rows.unionByName(seeds.withColumn("mark", none.cast("string")))
    # a row's mark stands next to it: no join with the marks
    both = Window.partitionBy(*key).orderBy("id", F.col("mark").isNull())
    marked = rows.unionByName(marks).withColumn("own", F.when(F.lag("id").over(both) == F.col("id"), F.lag("mark").over(both)))
    upto = both.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = F.col("mark").isNull() & F.col("own").isNull()
    marked = marked.withColumn("part", F.count(F.when(F.col("mark") == "knot", 1)).over(upto)).withColumn("segment", F.count(F.when(plain & (F.col("seq") <= 0), 1)).over(upto))
    # one window gives the maximum since the last reset, as segments only grow
    marked = marked.withColumn("since", F.max(F.when(plain, F.struct("segment", "seq"))).over(upto)["seq"])
    steps = marked.filter(plain).groupBy(*key, "part").agg(
        F.max(F.col("seq") <= 0).alias("resets"),
        F.max_by("since", "id").alias("tail"),  # of use where there is a reset in this stretch
        F.max("seq").alias("top"),
        F.min("id").alias("id"),
    )
    steps = written(steps.select(*key, "id", "resets", "tail", "top"), "steps")

    nth = F.row_number().over(Window.partitionBy("event").orderBy("id"))
    state = written(knots.select(*key, "id", "event", "seq", "known", (F.col("known") | (nth > 1)).alias("aside")), "knots")
    replayed = (F.col("seq") > 0) & F.coalesce(F.col("seq") <= F.col("guard"), F.lit(False))
    while True:
        at_knots, blocks = _guards(steps, state)
        passing = F.min(F.when(~replayed & ~F.col("known"), F.col("id"))).over(Window.partitionBy("event"))
        new = at_knots.withColumn("first", passing).withColumn("now", ~F.coalesce(F.col("id") == F.col("first"), F.lit(False)))
        new = written(new.select(*key, "id", "event", "seq", "known", F.col("now").alias("aside"), (F.col("now") != F.col("aside")).alias("changed"), (F.col("now") & ~replayed).alias("duplicate")), "knots")
        settled = not new.filter("changed").limit(1).count()
        state = new.drop("changed", "duplicate")
        if settled:
            return new.filter("duplicate").select(*key, "id"), blocks


def settle(ticks: DataFrame, initial: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """``ticks`` (id, event_id, consumer, meter_sequence and any others) with a column ``verdict``.

    ``id`` is the unique order of arrival. Rows where a column named in ``ticks`` as units_drawn or cost is NULL cannot be
    settled and are QUARANTINED without touching the guard. NULL events are events of their own, NULL consumers one
    consumer, a NULL sequence counts as 0. To go on from an earlier ledger, ``initial`` (consumer, last_meter_sequence) seeds
    the guard and ``known`` (event_id) names the events accepted before; a known event never changes the guard.
    """
    who = F.coalesce(F.col("consumer"), F.lit("\0"))
    sequence = F.coalesce(F.col("meter_sequence"), F.lit(0)).cast("bigint")
    event = F.coalesce(F.col("event_id"), F.concat(F.lit("\0"), F.col("id").cast("string")))
    slim = ticks.select(F.col("id").cast("bigint").alias("id"), who.alias("consumer"), event.alias("event"), sequence.alias("seq"), _bad(ticks).alias("bad"))
    good = slim.filter(~F.col("bad")).drop("bad")
    heavy = heavy_consumers(good)
    good = in_blocks(good, heavy)
    key = ["consumer", "block"]
    repeated = _repeated(good, known)
    knots = repeated.filter("knot")
    early = repeated.filter(~F.col("knot")).withColumn("nth", F.row_number().over(Window.partitionBy("event").orderBy("id"))).filter("nth > 1").select(*key, "id")

    none = F.lit(None)
    seeds = None
    if initial is not None:
        first = good.groupBy("consumer").agg(F.min("block").alias("block"))
        seeds = initial.filter("last_meter_sequence IS NOT NULL").select(F.coalesce("consumer", F.lit("\0")).alias("consumer"), F.col("last_meter_sequence").cast("bigint").alias("seq")).join(first, "consumer").select(*key, F.lit(_BEFORE).alias("id"), "seq")
    if knots.limit(1).count() or heavy.limit(1).count():
        duplicates, begins = _resolved(good, knots, early, seeds)
        duplicates = duplicates.unionByName(early)
    else:  # every consumer is one block, and nothing but its own rows decides
        duplicates, begins = early, None

    # every tick beside its mark and its block's beginning
    empty = none.cast(ticks.schema)
    full = ticks.select(F.struct(*ticks.columns).alias("tick"), F.col("id").cast("bigint").alias("id"), who.alias("consumer"), F.when(~_bad(ticks), sequence).alias("seq"))
    full = in_blocks(full, heavy).withColumn("mark", F.lit(False))
    full = full.unionByName(duplicates.select(empty.alias("tick"), "id", "consumer", none.cast("bigint").alias("seq"), "block", F.lit(True).alias("mark")))
    for at_begin in (None if begins is None else begins.select(*key, F.col("carry").alias("seq")), seeds):
        if at_begin is not None:
            full = full.unionByName(at_begin.select(empty.alias("tick"), F.lit(_BEFORE).alias("id"), "consumer", "seq", "block", F.lit(False).alias("mark")))
    both = Window.partitionBy(*key).orderBy("id", F.desc("mark"))
    full = full.withColumn("duplicate", F.coalesce((F.lag("id").over(both) == F.col("id")) & F.lag("mark").over(both), F.lit(False))).filter(~F.col("mark"))
    full = full.withColumn("counts", F.when(~F.col("duplicate"), F.col("seq")))
    along = Window.partitionBy(*key).orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = full.withColumn("segment", F.count(F.when(F.col("counts") <= 0, 1)).over(along))
    # the largest since the last reset: segments only grow, so it is the largest pair's
    before = F.max(F.when(F.col("counts").isNotNull(), F.struct("segment", "counts"))).over(Window.partitionBy(*key).orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    full = full.withColumn("before", before)
    floor = F.when(F.col("before.segment") == F.col("segment"), F.col("before.counts"))
    verdict = F.when(F.col("seq").isNull(), QUARANTINED).when(F.col("duplicate"), DUPLICATE).when((F.col("seq") > 0) & (F.col("seq") <= floor), REPLAY).otherwise(OK)
    return full.withColumn("verdict", verdict).filter(F.col("tick").isNotNull()).select("tick.*", "verdict")


def running_balance(accepted: DataFrame, initial: int, balances: DataFrame | None = None) -> DataFrame:
    """``accepted`` with ``balance``: initial minus the consumer's costs up to the tick, in order of arrival.

    ``balances`` (address, escrow_balance): what consumers seen before have left; the others begin with ``initial``. Sums
    per block of arrivals first, so the windows hold a block's rows of a consumer, or one row per block.
    """
    columns = [F.col(c) for c in accepted.columns]
    heavy = heavy_consumers(accepted)
    rows = in_blocks(accepted, heavy, name="__block")
    per = rows.groupBy("consumer", "__block").agg(F.sum(F.col("cost").cast("decimal(38,0)")).alias("spent")).join(F.broadcast(heavy), F.col("consumer").eqNullSafe(F.col("__consumer")), "left_semi")
    earlier = Window.partitionBy("consumer").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("consumer").alias("__c"), F.col("__block").alias("__b"), F.coalesce(F.sum("spent").over(earlier), F.lit(0)).alias("__before"))  # of heavy consumers only
    out = rows.join(F.broadcast(per), F.col("consumer").eqNullSafe(F.col("__c")) & (F.col("__block") == F.col("__b")), "left")
    begin = F.lit(initial).cast("decimal(38,0)")
    if balances is not None:
        out = out.join(balances.select(F.col("address").alias("__a"), F.col("escrow_balance").alias("__e")), F.col("consumer").eqNullSafe(F.col("__a")), "left")
        begin = F.coalesce(F.col("__e").cast("decimal(38,0)"), begin)
    inside = Window.partitionBy("consumer", "__block").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    balance = begin - F.coalesce("__before", F.lit(0)) - F.sum(F.col("cost").cast("decimal(38,0)")).over(inside)
    return out.select(*columns, balance.cast("decimal(38,0)").alias("balance"))
