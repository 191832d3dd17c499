"""The given tables as messages: log_id, topic, seq, timestamp_seconds, message."""

from __future__ import annotations

import math
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import seconds_of
from ..operators.relation import between


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_messages(spark: SparkSession, sf_dir: str, fleet: bool = False, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Events as one log, or with ``fleet`` as one log a user. ``lo`` and ``hi`` (seconds, inclusive) also
    prune the stored time column by whole seconds, so they reach the scan."""
    events = table(spark, sf_dir, "events")
    at = lambda x: F.lit(datetime.fromtimestamp(x, timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz")
    events = events if lo is None else events.filter(F.col("ts") >= at(math.floor(lo)))
    events = events if hi is None else events.filter(F.col("ts") <= at(math.ceil(hi)))
    made = events.select(
        (F.concat(F.lit("user_"), F.col("user_id")) if fleet else F.lit("events")).alias("log_id"),
        F.col("event_type").alias("topic"),
        F.col("event_id").alias("seq"),
        seconds_of(F.col("ts")).alias("timestamp_seconds"),
        F.struct("event_id", "user_id", "value", "props").alias("message"),
    )
    return between(made, lo, hi)


def talk_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations: a log each, the role as topic, the turn as time."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("log_id"),
        F.col("role").alias("topic"),
        F.col("turn").cast("long").alias("seq"),
        F.col("turn").cast("double").alias("timestamp_seconds"),
        F.struct("text").alias("message"),
    )
