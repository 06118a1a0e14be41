"""The tick ledger's tables, read and brought to one spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import normalize as N
from gridloom.operators.deliveries import first_deliveries


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivered row: addresses and types in one spelling, cost as BIGINT (NULL if unreadable), time in seconds."""
    return table(spark, sf_dir, "utility_ticks").select(
        "id",
        "event_id",
        N.address("consumer").alias("consumer"),
        N.address("operator").alias("operator"),
        N.resource("resource_type").alias("resource_type"),
        "units_drawn",
        N.integer64("cost").alias("cost"),
        "meter_sequence",
        N.epoch_seconds("timestamp").alias("time"),
    )


def different_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event once, as first delivered."""
    return first_deliveries(clean_ticks(spark, sf_dir), "event_id", "id")


def with_day(ticks: DataFrame) -> DataFrame:
    return ticks.withColumn("day", N.epoch_day("time"))
