"""Questions about a topic: SQL, downsampling, summaries, rates, changes."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .catalog import gaps
from .quantiles import exact_quantiles
from .relation import between, topic_relation
from .rowindex import join_same, row_index, with_previous, with_running_sum

ORDER = ("timestamp_seconds", "seq")


class Windowed(Protocol):
    """A table that chooses what it reads by time and topic, such as ``sources.clustered.MessageTable``."""

    def messages(self, lo: float | None = None, hi: float | None = None, logs: list[str] | None = None, topics: list[str] | None = None) -> DataFrame: ...


def query(messages: DataFrame | Windowed, sql: str, topics: list[str], lo: float | None = None, hi: float | None = None) -> DataFrame:
    """SQL over topics in a time window; each is a view, and a column, of its own name. Of a ``Windowed`` table only the
    files that can hold the window are read."""
    if not isinstance(messages, DataFrame):
        messages = messages.messages(lo, hi, topics=topics)
    spark = messages.sparkSession
    for t in topics:
        between(topic_relation(messages, t), lo, hi).createOrReplaceTempView(f"`{t}`")
    try:
        return spark.sql(sql)
    finally:
        for t in topics:
            spark.catalog.dropTempView(t)


def time_bins(df: DataFrame, value: Column, width: float) -> DataFrame:
    return df.groupBy("log_id", "topic", F.floor(F.col("timestamp_seconds") / width).alias("bin")).agg(
        F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n")
    )


def every_nth(df: DataFrame, n: int, huge: bool = False) -> DataFrame:
    """Each n-th message of a log and topic, the first included."""
    return row_index(df, ["log_id", "topic"], list(ORDER), huge).filter(F.col("row_index") % n == 0).drop("row_index")


def summarise(df: DataFrame, value: Column, huge: bool = False) -> DataFrame:
    """Figures of a value by topic. The median takes one buffer a topic; with ``huge`` it is selected."""
    made = df.groupBy("log_id", "topic").agg(
        F.avg(value).alias("mean"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.count(value).alias("n"),
        *([] if huge else [F.median(value).alias("middle")]),
        F.stddev(value).alias("spread"),
    )
    if not huge:
        return made
    middle = exact_quantiles(df, ["log_id", "topic"], value, [0.5])
    return join_same(made, middle, ["log_id", "topic"], how="left").withColumn("middle", F.get("quantiles", F.lit(0))).drop("quantiles")


def latency_stats(df: DataFrame, huge: bool = False) -> DataFrame:
    """Of the gaps between messages, by topic."""
    gap = gaps(df.select("log_id", "topic", *ORDER), huge)
    gap = stage(gap.select("log_id", "topic", "latency"), "latency") if huge else gap
    return summarise(gap, F.col("latency"), huge).drop("n")


def rate_class(df: DataFrame, cv: float, huge: bool = False) -> DataFrame:
    """Frequency, and ``fixed`` if gaps vary by at most ``cv`` of their mean, else ``event``."""
    gap = gaps(df.select("log_id", "topic", *ORDER), huge)
    mean, spread = F.avg("latency"), F.stddev("latency")
    kind = F.when(spread / mean <= cv, "fixed").otherwise("event")
    return gap.groupBy("log_id", "topic").agg(F.when(mean > 0, 1 / mean).alias("frequency"), kind.alias("kind"))


def latency_anomalies(df: DataFrame, k: float, huge: bool = False) -> DataFrame:
    """Messages whose gap is more than mean + k standard deviations of their topic."""
    gap = gaps(df, huge)
    limit = gap.groupBy("log_id", "topic").agg((F.avg("latency") + k * F.stddev("latency")).alias("limit"))
    return join_same(gap, limit, ["log_id", "topic"]).filter(F.col("latency") > F.col("limit")).select(*gap.columns)


def correlate(df: DataFrame, a: Column, b: Column) -> DataFrame:
    return df.groupBy("log_id", "topic").agg(F.corr(a, b).alias("correlation"))


def sudden_change(df: DataFrame, value: Column, threshold: float, huge: bool = False) -> DataFrame:
    """Messages whose value moved by more than ``threshold`` a second since the one before."""
    now = F.struct(value.alias("value"), F.col("timestamp_seconds").alias("t"))
    made = with_previous(df, ["log_id", "topic"], list(ORDER), now, "before", huge)
    slope = F.abs(value - F.col("before.value")) / F.nullif(F.col("timestamp_seconds") - F.col("before.t"), F.lit(0.0))
    return made.withColumn("slope", slope).filter(F.col("slope") > threshold).drop("before")


def excursions(df: DataFrame, value: Column, limit: float, huge: bool = False) -> DataFrame:
    """Runs of consecutive messages above ``limit``: start, end, length and peak."""
    made = df.select("log_id", "topic", *ORDER, value.alias("v"), (value > limit).alias("above"))
    made = with_running_sum(made, ["log_id", "topic"], list(ORDER), F.when(F.col("above"), 0).otherwise(1), "run", huge)
    return made.filter("above").groupBy("log_id", "topic", "run").agg(
        F.min("timestamp_seconds").alias("start_seconds"),
        F.max("timestamp_seconds").alias("end_seconds"),
        F.count("*").alias("n"),
        F.max("v").alias("peak"),
    ).drop("run")


def topic_parity(messages: DataFrame) -> DataFrame:
    n = F.count_distinct("topic")
    return messages.groupBy("log_id").agg(n.alias("topics"), F.when(n % 2 == 0, "even").otherwise("odd").alias("parity"))
