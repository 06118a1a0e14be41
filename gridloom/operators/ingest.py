"""Ingest requests: validation in fixed precedence, and the outcome of each after settlement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import scalars as S
from gridloom.functions.normalize import integer_text
from gridloom.operators.settle import DUPLICATE, REPLAY, running_balance, settle
from gridloom.shared import written
from gridloom.schemas import ACKNOWLEDGED, DEFAULT_RATE, DEFAULT_RESOURCE, INITIAL_ESCROW

NULL_FIELD = "null field"


def validate(requests: DataFrame, order: str = "request_id", received: str = "received_at", body: str = "body", production: bool = False) -> DataFrame:
    """Each request's tick and its first error: parties, units, sequence, time, cost, in this order.

    Absent values take their defaults (resource, time of receipt, an id made of the receipt and the request, cost = units
    x rate). Parties that are null, empty, false or zero are missing. No body and an array are a body without fields. A body that is no JSON object, and a consumer that is
    no text or number, are status 500 without settlement; a resource, event id or operator that can't be stored ('null
    field') is so only after the guard let the request pass. A time that is null counts as 0; whole numbers of any size
    are taken, sequences and times beyond 64 bits as the largest there is. ``status`` is NULL for requests that go on to
    settlement. ``production``: ingest is switched off, every request is status 403.
    """
    names = ["consumer", "operator", "units_drawn", "meter_sequence", "cost", "timestamp", "event_id", "resource_type"]
    stamp = F.col(received)
    if dict(requests.dtypes)[received] == "timestamp_ntz":  # taken as UTC, whatever the session's time zone
        stamp = F.concat(stamp.cast("string"), F.lit("+00:00")).cast("timestamp")
    us = F.unix_micros(stamp.cast("timestamp"))
    r = requests.select(F.col(order).alias("id"), us.alias("us"), F.col(body).alias(body), F.try_parse_json(body).alias("v"))
    r = r.select("id", "us", F.coalesce(S.kind(F.col("v")).isin("OBJECT", "ARRAY"), F.coalesce(F.col(body) == "", F.lit(True))).alias("object"), *(S.field(F.col("v"), f"$.{n}").alias(f"v_{n}") for n in names))
    get = lambda n: F.col(f"v_{n}")
    absent = lambda x, default: F.when(x.isNull(), default)
    numbers = ["units_drawn", "meter_sequence", "timestamp", "cost"]
    r = r.select("*", *(S.number(get(n)).alias(f"n_{n}") for n in numbers), S.kind(get("cost")).alias("cost_kind"))
    seconds = F.floor(F.col("us") / 1_000_000).cast("bigint")
    sim = F.concat_ws("-", F.lit("sim"), F.floor(F.col("us") / 1000).cast("string"), F.col("id").cast("string"))
    from_text = integer_text(S.text_of(get("cost")), blank=0)
    from_number = F.when(F.col("n_cost") == F.floor("n_cost"), F.col("n_cost").try_cast("decimal(38,0)"))
    odd = lambda n, *more: F.coalesce(S.kind(get(n)).isin("OBJECT", "ARRAY", "BOOLEAN", *more), F.lit(False))
    odd_field = odd("operator") | odd("event_id", "VOID") | odd("resource_type", "VOID")
    rows = r.select(
        "id",
        "object",
        F.coalesce(S.text_of(get("consumer")), F.lit("")).alias("consumer"),
        F.coalesce(S.text_of(get("operator")), F.lit("")).alias("operator"),
        (~S.truthy(get("consumer")) | ~S.truthy(get("operator"))).alias("no_party"),
        odd("consumer").alias("odd_consumer"),
        odd_field.alias("odd_field"),
        S.integral(F.col("n_units_drawn")).alias("units_drawn"),
        S.whole(F.col("n_meter_sequence"), clamp=True).alias("meter_sequence"),
        absent(get("timestamp"), seconds).otherwise(S.whole(F.col("n_timestamp"), clamp=True)).alias("time"),
        absent(get("event_id"), sim).otherwise(S.text_of(get("event_id"))).alias("event_id"),
        absent(get("resource_type"), F.lit(DEFAULT_RESOURCE)).otherwise(S.text_of(get("resource_type"))).alias("resource_type"),
        (get("cost").isNull() | (F.col("cost_kind") == "VOID")).alias("missing"),
        F.when(F.col("cost_kind") == "STRING", from_text).otherwise(from_number).alias("sent"),
    )
    rows = rows.withColumn("cost", F.when(F.col("missing"), F.try_multiply(F.col("units_drawn"), F.lit(DEFAULT_RATE)).cast("decimal(38,0)")).otherwise(F.col("sent")).cast("decimal(38,0)"))
    error = (
        F.when(~F.coalesce(F.col("object"), F.lit(False)), "unreadable body")
        .when(F.col("no_party"), "consumer, operator")
        .when(~F.coalesce(F.col("units_drawn") > 0, F.lit(False)), "units_drawn")
        .when(~F.coalesce(F.col("meter_sequence") > 0, F.lit(False)), "meter_sequence")
        .when(F.col("time").isNull(), "timestamp")
        .when(F.col("cost").isNull(), "cost")
        .when(F.col("cost") < 0, "negative cost")
        .when(F.col("odd_consumer"), "unreadable consumer")
        .when(F.col("odd_field"), NULL_FIELD)
    )
    if production:
        error = F.lit("switched off")
    rows = rows.withColumn("error", error)
    status = F.when(F.lit(production), 403).when(F.col("error").isin("unreadable body", "unreadable consumer"), 500).when(F.col("error") != NULL_FIELD, 400)
    return rows.select("id", "event_id", "consumer", "operator", "resource_type", "units_drawn", "cost", "meter_sequence", "time", "error", status.alias("status"))


def outcomes(validated: DataFrame, initial: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """The columns of :func:`validate` with final ``status`` and ``error``: 400 and 500 from validation, 409, 500 and 201 from settlement in order of ``id``.

    Requests with a field that can't be stored are tested by the guard like all others (409), are 500 if they pass, and
    change nothing. ``initial`` and ``known``: the ledger they are settled onto, see :func:`gridloom.operators.settle.settle`.
    """
    validated = written(validated, "requests")
    todo = validated.filter(F.col("status").isNull())
    # such a request's event is never accepted: it is named as known
    own = F.when(F.col("error") == NULL_FIELD, F.concat(F.lit("\0"), F.col("id").cast("string"))).otherwise(F.col("event_id"))
    never = todo.filter(F.col("error") == NULL_FIELD).select(own.alias("event_id"))
    known = never if known is None else known.select("event_id").unionByName(never)
    done = settle(todo.drop("status").withColumn("sent", F.col("event_id")).withColumn("event_id", own), initial, known).withColumn("event_id", F.col("sent")).drop("sent")
    unstored = (F.col("error") == NULL_FIELD) & (F.col("verdict") == DUPLICATE)
    status = F.when(F.coalesce(unstored, F.lit(False)), 500).when(F.col("verdict").isin(REPLAY, DUPLICATE), 409).otherwise(201)
    error = F.when(F.coalesce(unstored, F.lit(False)), F.col("error")).when(F.col("verdict") != "OK", F.col("verdict"))
    done = done.withColumn("status", status).withColumn("error", error).select(validated.columns)
    return validated.filter(F.col("status").isNotNull()).unionByName(done)


def acknowledgements(outcomes: DataFrame, balances: DataFrame | None = None, initial: int = INITIAL_ESCROW) -> DataFrame:
    """(id, status, event_id, consumer, operator, cost, meter_sequence, escrow_balance) of the accepted requests; money as texts.

    ``balances`` (address, escrow_balance): what consumers known before had left.
    """
    accepted = written(outcomes.filter(F.col("status") == 201), "accepted")
    rows = running_balance(accepted, initial, balances)
    return rows.select("id", F.lit(ACKNOWLEDGED).alias("status"), "event_id", "consumer", "operator", F.col("cost").cast("string").alias("cost"), "meter_sequence", F.col("balance").cast("string").alias("escrow_balance"))
