"""Queries of the data-processing problems 1, 2, 3 and 5 over utility_ticks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import normalize as N
from gridloom.operators import features, outliers, skew, trailing
from gridloom.plans.ticks import clean_ticks, different_ticks, table, with_day

PERIODS = (7, 30)
HEAVY_SHARE = 0.03


def p1_trailing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every consumer and calendar day: totals, averages and maxima of units and cost over 7 and 30 days."""
    lo, hi = table(spark, sf_dir, "utility_ticks").select(N.epoch_day(N.epoch_seconds("timestamp")).alias("d")).agg(F.min("d"), F.max("d")).first()
    out = trailing.trailing_totals(with_day(different_ticks(spark, sf_dir)), "consumer", "day", ["units_drawn", "cost"], PERIODS, (lo, hi))
    kinds = {"day": "string"} | {c: "bigint" for c in out.columns if "_sum" in c}
    return out.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in out.columns))


def _p2(spark: SparkSession, sf_dir: str, build: Callable[..., DataFrame]) -> DataFrame:
    ticks = clean_ticks(spark, sf_dir).select("consumer", "resource_type", "time", "units_drawn", "event_id", "id")
    return build(ticks, "consumer", "resource_type", "time", "units_drawn", event="event_id", order="id")


def p2_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per consumer with count, recency and total of every resource type."""
    return _p2(spark, sf_dir, features.entity_features)


def p2_features_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, one row per consumer and resource type."""
    return _p2(spark, sf_dir, features.entity_features_long).withColumn("total", F.col("total").cast("bigint"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys holding at least 3 % of all rows, from the value-frequency compressed counts."""
    f = skew.value_frequencies(clean_ticks(spark, sf_dir), ["consumer", "operator"], "units_drawn")
    found = skew.heavy_keys(skew.key_counts(f), HEAVY_SHARE)
    return found.filter(F.col("key_value") != "").select("key_field", "key_value")


def p3_key_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per operator and per consumer: rows, distinct values, mode and percentiles of units_drawn."""
    return skew.key_profiles(clean_ticks(spark, sf_dir), ["consumer", "operator"], "units_drawn", (0.5, 0.9))


def _p5(spark: SparkSession, sf_dir: str, drops: bool) -> DataFrame:
    ticks = clean_ticks(spark, sf_dir).filter(F.col("consumer") != "")
    return outliers.implausible_rows(ticks, "consumer", "time", "event_id", "id", ["units_drawn", "cost"], drops)


def p5_implausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every implausible reading with its reason, readings far below the source's others included."""
    return _p5(spark, sf_dir, True)


def p5_impossible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings that no meter can deliver."""
    return _p5(spark, sf_dir, False).filter(F.col("reason") == "impossible")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of utility_ticks with at least one implausible reading: far above, impossible or stuck (idle draws are usual)."""
    return _p5(spark, sf_dir, False).select("id").distinct()


QUERIES = {
    f.__name__: f for f in (p1_trailing_totals, p2_features, p2_features_long, p3_found, p3_key_profiles, p5_found, p5_implausible, p5_impossible)
}

CLEAN_SQL = r"""
raw AS (
  SELECT id, event_id,
         upper(trim(consumer, ' ' || chr(9) || chr(10) || chr(13))) AS consumer,
         upper(trim(operator, ' ' || chr(9) || chr(10) || chr(13))) AS operator,
         coalesce(nullif(regexp_replace(upper(trim(resource_type)), '[\s\-_]+', '_', 'g'), ''), 'UNKNOWN') AS resource_type,
         units_drawn, trim(cost) AS cost_text, meter_sequence,
         CASE WHEN "timestamp" >= 100000000000 THEN "timestamp" // 1000 WHEN "timestamp" > 0 THEN "timestamp" END AS time
  FROM utility_ticks),
clean AS (
  SELECT * EXCLUDE (cost_text),
         CASE WHEN regexp_full_match(cost_text, '[+-]?[0-9]+') THEN TRY_CAST(ltrim(cost_text, '+') AS BIGINT)
              WHEN regexp_full_match(cost_text, '0[xX][0-9a-fA-F]{1,15}') THEN TRY_CAST('0x' || substr(cost_text, 3) AS BIGINT) END AS cost,
         CAST(time // 86400 AS INTEGER) AS day
  FROM raw),
ticks AS (
  SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY coalesce(event_id, 'null-' || id) ORDER BY id) = 1)
"""


def _trailing_sql() -> str:
    frame = "OVER (PARTITION BY consumer ORDER BY d ROWS BETWEEN {p} PRECEDING AND CURRENT ROW)"
    cols = []
    for p in PERIODS:
        w = frame.format(p=p - 1)
        cols.append(f"CAST(sum(n) {w} AS BIGINT) AS n_{p}")
        for m in ("units_drawn", "cost"):
            total = f"CAST(sum({m}_sum) {w} AS BIGINT)"
            values = f"sum({m}_n) {w}"
            cols += [
                f"{total} AS {m}_sum_{p}",
                f"CAST({total} AS DOUBLE) / CAST(least({p}, d - lo + 1) AS DOUBLE) AS {m}_avg_day_{p}",
                f"CASE WHEN {values} > 0 THEN CAST({total} AS DOUBLE) / CAST({values} AS DOUBLE) END AS {m}_avg_row_{p}",
                f"max({m}_max) {w} AS {m}_max_{p}",
            ]
    return f"""WITH {CLEAN_SQL},
span AS (SELECT min(day) AS lo, max(day) AS hi FROM clean),
grid AS (SELECT consumer, d, lo FROM (SELECT DISTINCT consumer FROM ticks WHERE day IS NOT NULL), span, range(0, 100000) r(x),
         LATERAL (SELECT CAST(lo + x AS INTEGER) AS d) WHERE d <= hi),
daily AS (SELECT consumer, day, count(*) AS n, sum(units_drawn) AS units_drawn_sum, count(units_drawn) AS units_drawn_n, max(units_drawn) AS units_drawn_max,
          sum(cost) AS cost_sum, count(cost) AS cost_n, max(cost) AS cost_max FROM ticks GROUP BY ALL),
dense AS (SELECT g.consumer, g.d, g.lo, coalesce(n, 0) AS n, coalesce(units_drawn_sum, 0) AS units_drawn_sum, coalesce(units_drawn_n, 0) AS units_drawn_n, units_drawn_max,
          coalesce(cost_sum, 0) AS cost_sum, coalesce(cost_n, 0) AS cost_n, cost_max
          FROM grid g LEFT JOIN daily ON daily.consumer = g.consumer AND daily.day = g.d)
SELECT consumer, CAST(DATE '1970-01-01' + d AS VARCHAR) AS day, CAST(n AS BIGINT) AS n, CAST(units_drawn_sum AS BIGINT) AS units_drawn_sum, CAST(cost_sum AS BIGINT) AS cost_sum, {', '.join(cols)} FROM dense"""


_P2_SQL = f"""WITH {CLEAN_SQL},
s AS (SELECT consumer, resource_type, count(*) AS n, max(time) AS last, sum(units_drawn) AS total FROM ticks GROUP BY ALL),
g AS (SELECT consumer, resource_type FROM (SELECT DISTINCT consumer FROM ticks), (SELECT DISTINCT resource_type FROM clean))
SELECT g.consumer, g.resource_type AS type, coalesce(n, 0) AS n, (SELECT max(time) FROM clean) - last AS seconds_since_last, CAST(coalesce(total, 0) AS BIGINT) AS total
FROM g LEFT JOIN s ON s.consumer = g.consumer AND s.resource_type = g.resource_type"""

_KEYS = """k AS (SELECT 'consumer' AS key_field, consumer AS key_value, units_drawn AS value FROM clean
      UNION ALL SELECT 'operator', operator, units_drawn FROM clean)"""

_P3_FOUND_SQL = f"""WITH {CLEAN_SQL}, {_KEYS}
SELECT key_field, key_value FROM k WHERE key_value <> '' GROUP BY ALL HAVING count(*) >= 0.03 * (SELECT count(*) FROM clean)"""


def percentile_sql(rows: str, group: str, quantiles: tuple[float, ...]) -> str:
    values = ", ".join(f"(CAST({q} AS DOUBLE))" for q in quantiles)
    return f"""r AS (SELECT {group}, list_sort(list(CAST(value AS DOUBLE))) AS vs, count(*) AS cnt FROM {rows} WHERE value IS NOT NULL GROUP BY {group}),
w AS (SELECT *, q * CAST(cnt - 1 AS DOUBLE) AS place FROM r, (VALUES {values}) v(q)),
pct AS (SELECT {group}, cnt, q, vs[CAST(floor(place) AS BIGINT) + 1] + (vs[CAST(ceil(place) AS BIGINT) + 1] - vs[CAST(floor(place) AS BIGINT) + 1]) * (place - floor(place)) AS value FROM w)"""


_P3_SQL = f"""WITH {CLEAN_SQL}, {_KEYS}, {percentile_sql('k', 'key_field, key_value', (0.5, 0.9))},
f AS (SELECT key_field, key_value, value, count(*) AS n FROM k GROUP BY ALL),
b AS (SELECT key_field, key_value, value AS mode, n AS mode_rows FROM f WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key_field, key_value ORDER BY n DESC, value) = 1),
c AS (SELECT key_field, key_value, CAST(sum(n) AS BIGINT) AS "rows", count(value) AS distinct_values FROM f GROUP BY ALL)
SELECT c.*, b.mode, b.mode_rows, x.value AS p50, y.value AS p90 FROM c
LEFT JOIN b USING (key_field, key_value)
LEFT JOIN (SELECT * FROM pct WHERE q = 0.5) x USING (key_field, key_value)
LEFT JOIN (SELECT * FROM pct WHERE q = 0.9) y USING (key_field, key_value)"""

_P5_SQL = f"""WITH {CLEAN_SQL},
enough AS (SELECT consumer FROM ticks GROUP BY consumer HAVING count(*) >= 30)
SELECT id, consumer, 'units_drawn' AS metric, 'impossible' AS reason FROM clean WHERE units_drawn < 0 AND consumer <> '' AND consumer IN (FROM enough)
UNION ALL SELECT id, consumer, 'cost', 'impossible' FROM clean WHERE cost < 0 AND consumer <> '' AND consumer IN (FROM enough)"""

ORACLES = {
    "p1_trailing_totals": _trailing_sql(),
    "p2_features_long": _P2_SQL,
    "p3_found": _P3_FOUND_SQL,
    "p3_key_profiles": _P3_SQL,
    "p5_impossible": _P5_SQL,
}
