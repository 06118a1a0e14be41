"""Queries over the metering ledger: decoding, settlement, states, lookups, summaries, ingest, streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import normalize as N
from gridloom.functions import scalars as S
from gridloom.operators import ingest, kept, settle, state
from gridloom.operators.deliveries import first_deliveries
from gridloom.plans.problems import CLEAN_SQL
from gridloom.plans.ticks import clean_ticks, table
from gridloom.schemas import HISTORY_DEFAULT, INITIAL_ESCROW
from gridloom.shared import file_system, temporary, written
from gridloom.sources import events


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_ticks(spark, sf_dir).withColumn("time", F.coalesce("time", F.lit(0).cast("bigint")))


#: Kept ledgers of this process, by source folder and the state of its tick files.
_kept: dict[tuple, kept.Ledger] = {}


def kept_ledger(spark: SparkSession, sf_dir: str) -> kept.Ledger:
    """The ledger of a folder's ticks: settled once and kept in the shared folder, anew if the tick files have changed."""
    fs, p = file_system(spark, f"{sf_dir}/utility_ticks.parquet")
    files = tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(p)))
    key = (spark.sparkContext.applicationId, sf_dir, files)
    if key not in _kept or not _kept[key].version:
        _kept[key] = kept.build(spark, temporary(spark, "ledger"), _ticks(spark, sf_dir))
    return _kept[key]


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_ledger(spark, sf_dir).ticks().withColumn("cost", F.col("cost").cast("bigint"))


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.col(c).cast("bigint").alias(c) if c in columns else F.col(c) for c in df.columns))


def _consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_ledger(spark, sf_dir).consumers()


def _operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_ledger(spark, sf_dir).operators()


def decode_ticks(spark, sf_dir):
    """Flat ticks of raw_chain_events."""
    return events.decode_ticks(table(spark, sf_dir, "raw_chain_events"))


def symbol_decode(spark, sf_dir):
    """Hexadecimal symbols of the raw events' topics as text."""
    raw = table(spark, sf_dir, "raw_chain_events").select("ingest_ordinal", F.try_parse_json("payload").alias("v"))
    sym = F.try_variant_get("v", "$.topics[0].sym", "string")
    return raw.select("ingest_ordinal", sym.alias("hex")).filter("hex IS NOT NULL").select("ingest_ordinal", "hex", S.hex_text(F.col("hex")).alias("symbol"))


def public_frame(spark, sf_dir):
    """The eight public fields of the accepted ticks."""
    return state.public_frame(_accepted(spark, sf_dir))


def frame_json(spark, sf_dir):
    """Accepted ticks as JSON frames."""
    return state.frame_json(state.public_frame(_accepted(spark, sf_dir)))


def replay_guard(spark, sf_dir):
    """Rows that the sequence guard rejects."""
    return kept_ledger(spark, sf_dir).rejected().filter(F.col("verdict") == settle.REPLAY).select("id", "consumer", "meter_sequence")


def dedup_events(spark, sf_dir):
    """The first delivery of every event."""
    return first_deliveries(clean_ticks(spark, sf_dir), "event_id", "id").select("id", "event_id", "consumer")


def rejections(spark, sf_dir):
    """Rejected rows with the reason."""
    return kept_ledger(spark, sf_dir).rejected().select("id", "event_id", "verdict")


def settled_ledger(spark, sf_dir):
    """Accepted ticks, settled from the delivered ones."""
    return settle.settle(_ticks(spark, sf_dir)).filter(F.col("verdict") == settle.OK).drop("verdict")


def running_balance(spark, sf_dir):
    """Every accepted tick with the consumer's balance after it."""
    return _long(settle.running_balance(_accepted(spark, sf_dir), INITIAL_ESCROW), "balance").select("id", "consumer", "balance")


def consumer_state(spark, sf_dir):
    return _long(_consumers(spark, sf_dir), "escrow_balance")


def operator_state(spark, sf_dir):
    return _long(_operators(spark, sf_dir), "staked_amount", "total_earned")


def upsert_operator(spark, sf_dir):
    """Operators from the ledger, with the registered ones merged in."""
    registered = table(spark, sf_dir, "operators").select(N.address("address").alias("address"), "resource_type", N.integer_text("staked_amount").alias("staked_amount"))
    return _long(state.upsert_operators(_operators(spark, sf_dir), registered), "staked_amount", "total_earned")


def _first(df: DataFrame, column: str) -> str:
    return df.filter(F.col(column) != "").agg(F.min(column)).first()[0] or ""


def consumer_lookup(spark, sf_dir):
    """The registered consumer with the first address."""
    t = table(spark, sf_dir, "consumers")
    return state.lookup(t, "address", _first(t, "address"))


def operator_lookup(spark, sf_dir):
    t = table(spark, sf_dir, "operators")
    return state.lookup(t, "address", _first(t, "address"))


def _history(spark, sf_dir, limit):
    rows = kept_ledger(spark, sf_dir).history(_first(clean_ticks(spark, sf_dir), "consumer"), limit)
    return rows.withColumn("cost", F.col("cost").cast("bigint"))


def consumer_history(spark, sf_dir):
    """The newest accepted ticks of one consumer (the default page)."""
    return _history(spark, sf_dir, HISTORY_DEFAULT)


def history_unbounded(spark, sf_dir):
    """All accepted ticks of one consumer, newest first."""
    return _history(spark, sf_dir, S.history_limit("-1"))


def consumer_detail(spark, sf_dir):
    """One consumer's state joined to its newest ticks (flat)."""
    ledger, who = kept_ledger(spark, sf_dir), _first(clean_ticks(spark, sf_dir), "consumer")
    recent = ledger.history(who, HISTORY_DEFAULT).select("place", "event_id", F.lit(who).alias("address"))
    return _long(ledger.consumer(who), "escrow_balance").join(recent, "address")


def consumer_response(spark, sf_dir):
    """One consumer's state with its newest ticks nested (as JSON text), money as texts."""
    full = kept_ledger(spark, sf_dir).detail(_first(clean_ticks(spark, sf_dir), "consumer"), HISTORY_DEFAULT)
    tick = lambda t: F.struct(t.event_id, t.operator, t.resource_type, t.units_drawn, t.cost.cast("string").alias("cost"), t.meter_sequence, t.time.alias("timestamp"))
    history = F.to_json(F.transform("history", tick), {"ignoreNullFields": "false"})
    return full.select("address", F.col("escrow_balance").cast("string").alias("escrow_balance"), "total_units_consumed", "last_meter_sequence", "last_seen", history.alias("history"))


def consumer_unknown(spark, sf_dir):
    """Looking up a consumer that the ledger doesn't know gives no rows."""
    return _long(kept_ledger(spark, sf_dir).consumer("NO SUCH CONSUMER"), "escrow_balance")


def consumers_summary(spark, sf_dir):
    return _long(state.summary_of(table(spark, sf_dir, "consumers"), "active_consumers", {"total_units": "total_units_consumed"}), "total_units")


def operators_summary(spark, sf_dir):
    t = table(spark, sf_dir, "operators").select(N.integer_text("total_earned").alias("total_earned"))
    return _long(state.summary_of(t, "active_operators", {"total_earned": "total_earned"}), "total_earned")


def ledger_totals(spark, sf_dir):
    return _long(state.summary_of(_accepted(spark, sf_dir), "total_ticks", {"total_units": "units_drawn", "total_settled": "cost"}), "total_units", "total_settled")


def distribution(spark, sf_dir):
    return state.distribution(_accepted(spark, sf_dir))


def operator_leaderboard_text(spark, sf_dir):
    return _long(state.leaderboard(_operators(spark, sf_dir), True), "total_earned").select("place", "address", "resource_type", "total_earned")


def operator_leaderboard_numeric(spark, sf_dir):
    return _long(state.leaderboard(_operators(spark, sf_dir), False), "total_earned").select("place", "address", "resource_type", "total_earned")


def grid_metrics(spark, sf_dir):
    return state.grid_metrics(_accepted(spark, sf_dir), _consumers(spark, sf_dir), _operators(spark, sf_dir))


def grid_summary(spark, sf_dir):
    """The metrics with operators and distribution nested (as JSON texts)."""
    operators = _operators(spark, sf_dir)
    full = state.grid_summary(grid_metrics(spark, sf_dir), state.leaderboard(operators, True), state.distribution(_accepted(spark, sf_dir)))
    return full.withColumns({"operators": F.to_json("operators"), "distribution": F.to_json("distribution")})


def _validated(spark, sf_dir):
    return ingest.validate(table(spark, sf_dir, "ingest_requests"))


def validate_ingest(spark, sf_dir):
    """Every ingest request with its first error."""
    return _validated(spark, sf_dir).select("id", "error", "status")


def default_cost(spark, sf_dir):
    """Cost of the valid requests, given or derived."""
    # written once: as a filter, the error's expression would be generated twice
    return _long(written(_validated(spark, sf_dir), "requests").filter(F.col("error").isNull()), "cost", "units_drawn").select("id", "units_drawn", "cost")


def ingest_outcomes(spark, sf_dir):
    """Status of every ingest request after settlement."""
    return ingest.outcomes(_validated(spark, sf_dir)).select("id", "event_id", "status", "error")


def ingest_acknowledgements(spark, sf_dir):
    """What the accepted ingest requests are answered with: seven fields, the balance after the tick among them."""
    return ingest.acknowledgements(ingest.outcomes(_validated(spark, sf_dir)))


def two_deliveries(spark, sf_dir):
    """Consumers after the ticks came in two deliveries, the second settled onto the kept first one."""
    ticks = _ticks(spark, sf_dir)
    middle = ticks.agg(F.expr("(min(id) + max(id)) div 2")).first()[0] or 0
    ledger = kept.Ledger(spark, temporary(spark, "ledger"))
    ledger.append(ticks.filter(F.col("id") <= middle))
    ledger.append(ticks.filter(F.col("id") > middle))
    return _long(ledger.consumers(), "escrow_balance")


def cursor_latest(spark, sf_dir):
    """Cursor after the last page of raw events, and the raw events indexed."""
    return events.cursor_latest(table(spark, sf_dir, "raw_chain_events"))


def cursor_history(spark, sf_dir):
    """The cursor store after every page wrote its last event under the page's parity: the last value of each key."""
    pages = table(spark, sf_dir, "raw_chain_events").groupBy("page_no").agg(F.max("ingest_ordinal").alias("value"))
    writes = pages.select(F.concat(F.lit("contract-"), (F.col("page_no") % 2).cast("string"), F.lit(":cursor")).alias("key"), "value", F.col("page_no").alias("order"))
    return events.cursor_store(writes)


def page_counts(spark, sf_dir):
    """Raw events per page (the poller's count), and how many of them are ticks."""
    raw = table(spark, sf_dir, "raw_chain_events")
    ticks = events.decode_ticks(raw).select("ingest_ordinal", F.lit(1).alias("tick"))
    return raw.join(ticks, "ingest_ordinal", "left").groupBy("page_no").agg(F.count(F.lit(1)).alias("indexed"), F.count("tick").alias("ticks"))


def _recorded(spark, sf_dir):
    base = temporary(spark, "stream")
    rows = _ticks(spark, sf_dir).filter("units_drawn IS NOT NULL AND cost IS NOT NULL")
    rows.select("id", "event_id", "consumer", "operator", "resource_type", "units_drawn", F.col("cost").cast("string").alias("cost"), "meter_sequence", F.col("time").alias("timestamp")).write.parquet(f"{base}/in")
    return base


def stream_settle(spark, sf_dir):
    """The ledger settled by the keyed-state streaming operator from a file replay: accepted ticks per consumer."""
    from gridloom.streaming import settlement

    base = _recorded(spark, sf_dir)
    rows = settlement.run_available(settlement.settle_stream(settlement.read_ticks(spark, f"{base}/in")), f"{base}/out", f"{base}/checkpoint")
    ok = rows.filter(F.col("verdict") == settle.OK).withColumn("time", F.col("timestamp"))
    return _long(state.consumer_state(ok), "escrow_balance")


def stream_ledger(spark, sf_dir):
    """The same replay, every micro-batch settled onto a kept ledger: events are unique over all consumers."""
    from gridloom.streaming import settlement

    base = _recorded(spark, sf_dir)
    ledger = kept.Ledger(spark, f"{base}/ledger")
    settlement.settle_into(ledger, settlement.read_ticks(spark, f"{base}/in"), f"{base}/checkpoint", available=True).awaitTermination()
    return _long(ledger.consumers(), "escrow_balance")


QUERIES = {
    f.__name__: f
    for f in (
        decode_ticks, symbol_decode, public_frame, frame_json, replay_guard, dedup_events, rejections, settled_ledger, running_balance, consumer_state, operator_state,
        upsert_operator, consumer_lookup, operator_lookup, consumer_history, history_unbounded, consumer_detail, consumer_response, consumer_unknown, consumers_summary, operators_summary, ledger_totals, distribution,
        operator_leaderboard_text, operator_leaderboard_numeric, grid_metrics, grid_summary, validate_ingest, default_cost, ingest_outcomes, ingest_acknowledgements, cursor_latest, cursor_history, page_counts, two_deliveries, stream_settle, stream_ledger,
    )
}


def _fold_sql(source: str, never: str = "false") -> str:
    """CTEs s, f and verdicts: the sequential fold over ``source`` (id, consumer, event_id, meter_sequence), row by row.

    Consumers that share an event are folded together (``g``), with one guard each; those without any sequence need no
    fold. ``never``: rows that can't be stored, 500 once the guard lets them pass.
    """
    return f"""
e AS (SELECT id, consumer, coalesce(event_id, 'null-' || id) AS ev, coalesce(meter_sequence, 0) AS seq, {never} AS never FROM {source}),
shared AS (SELECT ev FROM e GROUP BY ev HAVING count(DISTINCT consumer) > 1),
near AS (SELECT DISTINCT a.consumer AS c, b.consumer AS d FROM e a JOIN e b ON a.ev = b.ev WHERE a.ev IN (FROM shared)),
reach AS (SELECT c, d FROM near UNION SELECT reach.c, near.d FROM reach JOIN near ON reach.d = near.c),
tied AS (SELECT c, min(d) AS g FROM reach GROUP BY c),
grouped AS (SELECT e.*, coalesce(g, consumer) AS g FROM e LEFT JOIN tied ON tied.c = e.consumer),
s AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY id) AS rn FROM grouped WHERE g IN (SELECT g FROM grouped WHERE seq > 0)),
f AS (
  SELECT g, rn, id, CASE WHEN never THEN 'NEVER' ELSE 'OK' END AS verdict, CASE WHEN never THEN MAP([consumer], [NULL::BIGINT]) ELSE MAP([consumer], [seq]) END AS lasts, CASE WHEN never THEN [] ELSE [ev] END AS ids FROM s WHERE rn = 1
  UNION ALL
  SELECT g, rn, id, v, CASE WHEN v = 'OK' THEN map_concat(lasts, MAP([consumer], [seq])) ELSE lasts END, CASE WHEN v = 'OK' THEN list_append(ids, ev) ELSE ids END FROM (
    SELECT s.g, s.rn, s.id, s.ev, s.seq, s.consumer, f.lasts, f.ids,
           CASE WHEN s.seq > 0 AND s.seq <= f.lasts[s.consumer] THEN 'REPLAY' WHEN s.never THEN 'NEVER' WHEN list_contains(f.ids, s.ev) THEN 'DUPLICATE_EVENT' ELSE 'OK' END AS v
    FROM f JOIN s ON s.g = f.g AND s.rn = f.rn + 1)),
verdicts AS (
  SELECT id, verdict FROM f
  UNION ALL
  SELECT id, CASE WHEN never THEN 'NEVER' WHEN row_number() OVER (PARTITION BY ev, never ORDER BY id) = 1 THEN 'OK' ELSE 'DUPLICATE_EVENT' END
  FROM grouped WHERE g NOT IN (SELECT g FROM grouped WHERE seq > 0))"""


_LEDGER = f"""WITH RECURSIVE {CLEAN_SQL},
good AS (SELECT * REPLACE (coalesce(time, 0) AS time) FROM clean WHERE units_drawn IS NOT NULL AND cost IS NOT NULL),
{_fold_sql('good')},
ok AS (SELECT good.* EXCLUDE (day) FROM good JOIN verdicts USING (id) WHERE verdict = 'OK'),
cs AS (SELECT consumer AS address, CAST({INITIAL_ESCROW} - sum(cost) AS BIGINT) AS escrow_balance, CAST(sum(units_drawn) AS BIGINT) AS total_units_consumed,
       arg_max(meter_sequence, id) AS last_meter_sequence, arg_max(time, id) AS last_seen FROM ok GROUP BY consumer),
os AS (SELECT operator AS address, arg_max(resource_type, id) AS resource_type, CAST(0 AS BIGINT) AS staked_amount, CAST(sum(cost) AS BIGINT) AS total_earned FROM ok GROUP BY operator),
who AS (SELECT min(consumer) AS address FROM clean WHERE consumer <> ''),
hist AS (SELECT id, event_id, operator, resource_type, units_drawn, cost, meter_sequence, time, row_number() OVER (ORDER BY id DESC) AS place FROM ok WHERE consumer = (SELECT address FROM who))
"""

_INT = r"""CASE WHEN regexp_full_match(trim({x}), '[+-]?[0-9]+') THEN TRY_CAST(ltrim(trim({x}), '+') AS HUGEINT) WHEN regexp_full_match(trim({x}), '0[xX][0-9a-fA-F]{{1,15}}') THEN TRY_CAST('0x' || substr(trim({x}), 3) AS HUGEINT) WHEN trim({x}) = '' THEN 0 END"""


def _number_sql(path: str) -> str:
    """DOUBLE of a JSON value as functions.scalars.number reads it."""
    x = f"trim(json_extract_string(j, '{path}'))"
    return f"""CASE json_type(j, '{path}') WHEN 'NULL' THEN 0.0 WHEN 'BOOLEAN' THEN CASE WHEN json_extract_string(j, '{path}') = 'true' THEN 1.0 ELSE 0.0 END
      WHEN 'VARCHAR' THEN CASE WHEN {x} = '' THEN 0.0 WHEN regexp_full_match({x}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST({x} AS DOUBLE)
        WHEN regexp_full_match({x}, '0[xX][0-9a-fA-F]{{1,15}}') THEN CAST(TRY_CAST('0x' || substr({x}, 3) AS BIGINT) AS DOUBLE) END
      WHEN 'OBJECT' THEN NULL WHEN 'ARRAY' THEN NULL ELSE TRY_CAST(json_extract_string(j, '{path}') AS DOUBLE) END"""


def _missing_sql(path: str) -> str:
    """A value that counts as missing: absent, null, false, zero, empty."""
    return f"CASE coalesce(json_type(j, '{path}'), 'NULL') WHEN 'NULL' THEN true WHEN 'BOOLEAN' THEN json_extract_string(j, '{path}') = 'false' WHEN 'VARCHAR' THEN json_extract_string(j, '{path}') = '' WHEN 'OBJECT' THEN false WHEN 'ARRAY' THEN false ELSE TRY_CAST(json_extract_string(j, '{path}') AS DOUBLE) = 0 END"


def _whole_sql(x: str) -> str:
    return f"(SELECT CASE WHEN n = floor(n) AND abs(n) < 9.2e18 THEN CAST(n AS BIGINT) END FROM (SELECT {x} AS n))"


def _unwrapped(path: str) -> str:
    return f"CASE WHEN json_type(j, '{path}') = 'OBJECT' AND json_type(j, '{path}.value') IS NOT NULL THEN json_extract(j, '{path}.value') ELSE json_extract(j, '{path}') END"


def _hex_sql(x: str) -> str:
    good = f"regexp_extract({x}, '^(?:[0-9a-fA-F]{{2}})*')"
    return f"rtrim(decode(unhex({good})), chr(0))"


def _symbol_sql(path: str) -> str:
    return f"(SELECT CASE WHEN json_type(u) = 'VARCHAR' THEN u ->> '$' WHEN json_type(u) = 'OBJECT' AND json_type(u, '$.sym') = 'VARCHAR' THEN {_hex_sql('(u ->> $$$.sym$$)')} ELSE '' END FROM (SELECT {_unwrapped(path)} AS u))"


def _address_sql(path: str) -> str:
    return f"(SELECT CASE WHEN json_type(u) = 'VARCHAR' THEN u ->> '$' WHEN json_type(u) = 'OBJECT' AND json_type(u, '$.address') NOT IN ('NULL') THEN u ->> '$.address' ELSE '' END FROM (SELECT {_unwrapped(path)} AS u))"


_DECODED = f"""WITH p AS (SELECT ingest_ordinal, page_no, CAST(payload AS JSON) AS j0 FROM raw_chain_events WHERE payload IS NOT NULL AND json_valid(payload)),
e AS (SELECT ingest_ordinal, page_no, json_object('o', j0, 'd', CASE WHEN json_type(j0, '$.data') = 'OBJECT' AND json_type(j0, '$.data.value') IS NOT NULL THEN json_extract(j0, '$.data.value') ELSE json_extract(j0, '$.data') END) AS j FROM p),
g AS (SELECT * FROM e WHERE json_type(j, '$.o.topics') = 'ARRAY' AND json_array_length(j, '$.o.topics') >= 3 AND json_type(j, '$.d') = 'ARRAY' AND json_array_length(j, '$.d') >= 4),
decoded AS (SELECT ingest_ordinal, page_no,
  coalesce(json_extract_string(j, '$.o.id'), json_extract_string(j, '$.o.txHash'), 'util_tick-' || coalesce(json_extract_string(j, '$.d[3]'), 'null')) AS event_id,
  {_address_sql('$.o.topics[1]')} AS consumer, {_address_sql('$.d[0]')} AS operator, {_symbol_sql('$.o.topics[2]')} AS resource_type,
  {_whole_sql(_number_sql('$.d[1]'))} AS units_drawn, coalesce(json_extract_string(j, '$.d[2]'), '0') AS cost,
  CASE WHEN json_type(j, '$.o.meterSequence') IS NULL THEN 0 ELSE {_whole_sql(_number_sql('$.o.meterSequence'))} END AS meter_sequence,
  {_whole_sql(_number_sql('$.d[3]'))} AS "timestamp"
  FROM g WHERE {_symbol_sql('$.o.topics[0]')} = 'util_tick')
"""

_VALIDATED = f"""q AS (SELECT request_id AS id, epoch_us(received_at) AS us, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j, body IS NOT NULL AND body <> '' AND NOT (json_valid(body) AND json_type(CAST(CASE WHEN json_valid(body) THEN body END AS JSON)) IN ('OBJECT', 'ARRAY')) AS unreadable FROM ingest_requests),
n AS (SELECT id, us, j, unreadable, {_missing_sql('$.consumer')} OR {_missing_sql('$.operator')} AS no_party,
  coalesce(json_type(j, '$.consumer') IN ('OBJECT', 'ARRAY', 'BOOLEAN'), false) AS odd_consumer, coalesce(json_type(j, '$.operator') IN ('OBJECT', 'ARRAY', 'BOOLEAN'), false)
  OR coalesce(json_type(j, '$.event_id') IN ('OBJECT', 'ARRAY', 'BOOLEAN', 'NULL'), false) OR coalesce(json_type(j, '$.resource_type') IN ('OBJECT', 'ARRAY', 'BOOLEAN', 'NULL'), false) AS odd_field, coalesce(json_extract_string(j, '$.consumer'), '') AS consumer, coalesce(json_extract_string(j, '$.operator'), '') AS operator,
  {_whole_sql(_number_sql('$.units_drawn'))} AS units_drawn, {_whole_sql(_number_sql('$.meter_sequence'))} AS meter_sequence,
  CASE WHEN json_type(j, '$.timestamp') IS NULL THEN us // 1000000 ELSE {_whole_sql(_number_sql('$.timestamp'))} END AS time,
  CASE WHEN json_type(j, '$.event_id') IS NULL THEN 'sim-' || (us // 1000) || '-' || id ELSE json_extract_string(j, '$.event_id') END AS event_id,
  CASE WHEN json_type(j, '$.resource_type') IS NULL THEN 'SOLAR' ELSE json_extract_string(j, '$.resource_type') END AS resource_type,
  json_type(j, '$.cost') AS ck, json_extract_string(j, '$.cost') AS cs FROM q),
m AS (SELECT *, CASE WHEN ck IS NULL OR ck = 'NULL' THEN CAST(units_drawn AS HUGEINT) * 1000 WHEN ck = 'VARCHAR' THEN {_INT.format(x='cs')}
  WHEN ck = 'BOOLEAN' THEN CASE WHEN cs = 'true' THEN 1 ELSE 0 END WHEN TRY_CAST(cs AS DOUBLE) = floor(TRY_CAST(cs AS DOUBLE)) THEN TRY_CAST(TRY_CAST(cs AS DOUBLE) AS HUGEINT) END AS cost FROM n),
validated AS (SELECT *, CASE WHEN unreadable THEN 'unreadable body' WHEN no_party THEN 'consumer, operator'
  WHEN NOT coalesce(units_drawn > 0, false) THEN 'units_drawn' WHEN NOT coalesce(meter_sequence > 0, false) THEN 'meter_sequence' WHEN time IS NULL THEN 'timestamp'
  WHEN cost IS NULL THEN 'cost' WHEN cost < 0 THEN 'negative cost' WHEN odd_consumer THEN 'unreadable consumer' WHEN odd_field THEN 'null field' END AS error FROM m)
"""

_INGESTED = f"""WITH RECURSIVE {_VALIDATED}, good AS (SELECT * FROM validated WHERE error IS NULL OR error = 'null field'), {_fold_sql('good', "error IS NOT NULL")}"""

ORACLES = {
    "decode_ticks": f"{_DECODED} SELECT * EXCLUDE (page_no) FROM decoded",
    "symbol_decode": f"""WITH p AS (SELECT ingest_ordinal, CAST(payload AS JSON) AS j FROM raw_chain_events WHERE payload IS NOT NULL AND json_valid(payload)),
h AS (SELECT ingest_ordinal, json_extract_string(j, '$.topics[0].sym') AS hex FROM p) SELECT ingest_ordinal, hex, {_hex_sql('hex')} AS symbol FROM h WHERE hex IS NOT NULL""",
    "public_frame": f'{_LEDGER} SELECT event_id, consumer, operator, resource_type, units_drawn, CAST(cost AS VARCHAR) AS cost, meter_sequence, time AS "timestamp" FROM ok',
    "frame_json": f"""{_LEDGER} SELECT event_id, '{{"type":"UTIL_TICK","data":{{"event_id":' || coalesce('"' || event_id || '"', 'null') || ',"consumer":"' || consumer || '","operator":"' || operator || '","resource_type":"' || resource_type
 || '","units_drawn":' || units_drawn || ',"cost":"' || cost || '","meter_sequence":' || meter_sequence || ',"timestamp":' || time || '}}}}' AS frame FROM ok""",
    "replay_guard": f"{_LEDGER} SELECT good.id, good.consumer, meter_sequence FROM good JOIN verdicts USING (id) WHERE verdict = 'REPLAY'",
    "dedup_events": f"WITH {CLEAN_SQL} SELECT id, event_id, consumer FROM ticks",
    "rejections": f"""{_LEDGER} SELECT good.id, event_id, verdict FROM good JOIN verdicts USING (id) WHERE verdict <> 'OK'
UNION ALL SELECT id, event_id, 'QUARANTINED' FROM clean WHERE units_drawn IS NULL OR cost IS NULL""",
    "settled_ledger": f"{_LEDGER} SELECT * FROM ok",
    "running_balance": f"{_LEDGER} SELECT id, consumer, CAST({INITIAL_ESCROW} - sum(cost) OVER (PARTITION BY consumer ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM ok",
    "consumer_state": f"{_LEDGER} SELECT * FROM cs",
    "operator_state": f"{_LEDGER} SELECT * FROM os",
    "upsert_operator": f"""{_LEDGER}, r AS (SELECT upper(trim(address)) AS address, resource_type, {_INT.format(x='staked_amount')} AS staked FROM operators)
SELECT coalesce(os.address, r.address) AS address, CASE WHEN r.address IS NULL THEN os.resource_type ELSE coalesce(nullif(r.resource_type, ''), 'UNKNOWN') END AS resource_type,
CAST(CASE WHEN r.address IS NULL THEN os.staked_amount ELSE coalesce(r.staked, 0) END AS BIGINT) AS staked_amount, CAST(coalesce(os.total_earned, 0) AS BIGINT) AS total_earned
FROM os FULL JOIN r ON os.address = r.address""",
    "consumer_lookup": "SELECT * FROM consumers WHERE address = (SELECT min(address) FROM consumers WHERE address <> '')",
    "operator_lookup": "SELECT * FROM operators WHERE address = (SELECT min(address) FROM operators WHERE address <> '')",
    "consumer_history": f"{_LEDGER} SELECT * FROM hist WHERE place <= {HISTORY_DEFAULT}",
    "history_unbounded": f"{_LEDGER} SELECT * FROM hist",
    "consumer_detail": f"{_LEDGER} SELECT cs.*, place, event_id FROM cs, hist WHERE cs.address = (SELECT address FROM who) AND place <= {HISTORY_DEFAULT}",
    "consumers_summary": "SELECT count(*) AS active_consumers, CAST(coalesce(sum(total_units_consumed), 0) AS BIGINT) AS total_units FROM consumers",
    "operators_summary": f"SELECT count(*) AS active_operators, CAST(coalesce(sum({_INT.format(x='total_earned')}), 0) AS BIGINT) AS total_earned FROM operators",
    "ledger_totals": f"{_LEDGER} SELECT count(*) AS total_ticks, CAST(coalesce(sum(units_drawn), 0) AS BIGINT) AS total_units, CAST(coalesce(sum(cost), 0) AS BIGINT) AS total_settled FROM ok",
    "distribution": f"{_LEDGER} SELECT resource_type, CAST(coalesce(sum(units_drawn), 0) AS BIGINT) AS units FROM ok GROUP BY resource_type",
    "operator_leaderboard_text": f"{_LEDGER} SELECT row_number() OVER (ORDER BY CAST(total_earned AS VARCHAR) DESC, address) AS place, address, resource_type, total_earned FROM os",
    "operator_leaderboard_numeric": f"{_LEDGER} SELECT row_number() OVER (ORDER BY total_earned DESC, address) AS place, address, resource_type, total_earned FROM os",
    "grid_metrics": f"""{_LEDGER} SELECT (SELECT count(*) FROM ok) AS total_ticks, (SELECT CAST(sum(cost) AS VARCHAR) FROM ok) AS total_settled, (SELECT count(*) FROM cs) AS active_consumers,
(SELECT CAST(sum(total_units_consumed) AS BIGINT) FROM cs) AS total_units, (SELECT count(*) FROM os) AS active_operators, (SELECT CAST(sum(total_earned) AS VARCHAR) FROM os) AS total_earned""",
    "validate_ingest": f"WITH {_VALIDATED} SELECT id, error, CAST(CASE WHEN error IN ('unreadable body', 'unreadable consumer') THEN 500 WHEN error <> 'null field' THEN 400 END AS INTEGER) AS status FROM validated",
    "default_cost": f"WITH {_VALIDATED} SELECT id, units_drawn, CAST(cost AS BIGINT) AS cost FROM validated WHERE error IS NULL",
    "ingest_outcomes": f"""{_INGESTED}
SELECT id, event_id, CAST(CASE WHEN error IN ('unreadable body', 'unreadable consumer') THEN 500 ELSE 400 END AS INTEGER) AS status, error FROM validated WHERE error IS NOT NULL AND error <> 'null field'
UNION ALL SELECT good.id, event_id, CAST(CASE verdict WHEN 'OK' THEN 201 WHEN 'NEVER' THEN 500 ELSE 409 END AS INTEGER), CASE verdict WHEN 'OK' THEN NULL WHEN 'NEVER' THEN 'null field' ELSE verdict END FROM good JOIN verdicts USING (id)""",
    "ingest_acknowledgements": f"""{_INGESTED}, ok AS (SELECT good.* FROM good JOIN verdicts USING (id) WHERE verdict = 'OK')
SELECT id, 'ingested' AS status, event_id, consumer, operator, CAST(cost AS VARCHAR) AS cost, meter_sequence, CAST(CAST({INITIAL_ESCROW} - sum(cost) OVER (PARTITION BY consumer ORDER BY id ROWS UNBOUNDED PRECEDING) AS HUGEINT) AS VARCHAR) AS escrow_balance FROM ok""",
    "cursor_latest": "SELECT 'cursor' AS key, arg_max(page_no, ingest_ordinal) || ':' || max(ingest_ordinal) AS value, count(payload) AS indexed FROM raw_chain_events",
    "cursor_history": """SELECT 'contract-' || (page_no % 2) || ':cursor' AS key, CAST(arg_max(value, page_no) AS VARCHAR) AS value
FROM (SELECT page_no, max(ingest_ordinal) AS value FROM raw_chain_events GROUP BY page_no) GROUP BY 1""",
    "page_counts": f"{_DECODED} SELECT r.page_no, count(*) AS indexed, count(d.ingest_ordinal) AS ticks FROM raw_chain_events r LEFT JOIN decoded d ON d.ingest_ordinal = r.ingest_ordinal GROUP BY r.page_no",
    "stream_settle": f"{_LEDGER} SELECT * FROM cs",
    "stream_ledger": f"{_LEDGER} SELECT * FROM cs",
    "two_deliveries": f"{_LEDGER} SELECT * FROM cs",
    "consumer_unknown": f"{_LEDGER} SELECT * FROM cs WHERE address = 'NO SUCH CONSUMER'",
    "consumer_response": f"""{_LEDGER} SELECT address, CAST(escrow_balance AS VARCHAR) AS escrow_balance, total_units_consumed, last_meter_sequence, last_seen,
(SELECT '[' || string_agg('{{"event_id":' || coalesce('"' || event_id || '"', 'null') || ',"operator":"' || operator || '","resource_type":"' || resource_type || '","units_drawn":' || units_drawn
 || ',"cost":"' || cost || '","meter_sequence":' || meter_sequence || ',"timestamp":' || time || '}}', ',' ORDER BY place) || ']' FROM hist WHERE place <= {HISTORY_DEFAULT}) AS history
FROM cs WHERE address = (SELECT address FROM who)""",
    "grid_summary": f"""{_LEDGER}, b AS (SELECT row_number() OVER (ORDER BY CAST(total_earned AS VARCHAR) DESC, address) AS place, * FROM os), dist AS (SELECT resource_type AS t, CAST(sum(units_drawn) AS BIGINT) AS u FROM ok GROUP BY ALL)
SELECT (SELECT count(*) FROM ok) AS total_ticks, (SELECT CAST(sum(cost) AS VARCHAR) FROM ok) AS total_settled, (SELECT count(*) FROM cs) AS active_consumers,
(SELECT CAST(sum(total_units_consumed) AS BIGINT) FROM cs) AS total_units, (SELECT count(*) FROM os) AS active_operators, (SELECT CAST(sum(total_earned) AS VARCHAR) FROM os) AS total_earned,
(SELECT '[' || string_agg('{{"place":' || place || ',"address":"' || address || '","resource_type":"' || resource_type || '","staked_amount":' || staked_amount || ',"total_earned":' || total_earned || '}}', ',' ORDER BY place) || ']' FROM b) AS operators,
(SELECT '{{' || string_agg('"' || t || '":' || u, ',' ORDER BY t) || '}}' FROM dist) AS distribution""",
}
