"""Log messages: topics of a format's logging type, and levelled loggings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import MissingTopicError, topics_of_type
from .relation import between

#: Formats and their logging types; None: the format has no loggings. Fixed values.
LOGGING_TYPES = {
    "ros1.bag": "rosgraph_msgs/Log", "ros2.db3": "rcl_interfaces/msg/Log", "ros2.mcap": "rcl_interfaces/msg/Log",
    "ardupilot.bin": "MSG", "px4.ulg": "logging", "betaflight.bbl": None, "betaflight.bfl": None,
}


def loggings(messages: DataFrame, known: DataFrame, type_name: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """(log_id, timestamp_seconds, topic, message) of all topics of the logging type; none is an error."""
    found = topics_of_type(known, type_name).select("log_id", "topic").distinct()
    if found.isEmpty():
        raise MissingTopicError(f"no logging topics of type {type_name}")
    return between(messages.join(found, ["log_id", "topic"]), lo, hi).select("log_id", "timestamp_seconds", "topic", "message", "seq")


def leveled_loggings(df: DataFrame, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Levelled loggings; unlike elsewhere the end is exclusive."""
    t = F.col("timestamp_seconds")
    df = df if lo is None else df.filter(t >= lo)
    df = df if hi is None else df.filter(t < hi)
    return df.select("log_id", "timestamp_seconds", F.struct("log_level", "message").alias("message"))


def by_level(df: DataFrame, levels: list[str]) -> DataFrame:
    return df.filter(F.col("log_level").isin(levels)).groupBy("log_level").agg(F.count("*").alias("n"))


def logging_support(logs: DataFrame) -> DataFrame:
    """``logs`` (log_id, format) with whether the format has loggings at all."""
    pairs = [F.lit(x) for k, v in LOGGING_TYPES.items() for x in (k, v is not None)]
    return logs.withColumn("has_loggings", F.coalesce(F.create_map(*pairs)[F.col("format")], F.lit(False)))
