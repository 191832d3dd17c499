"""What a tick sees: the rows of its lookback window, for all ticks in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rowindex import earlier, join_same, ranged, row_index

TICK = ("log_id", "tick_no", "asof_seconds")


def binned(df: DataFrame, ticks: DataFrame, seconds: float) -> tuple[DataFrame, DataFrame, Column]:
    """Rows and ticks with bins on which they meet, and whether the tick's lookback holds the row. A window of T
    seconds touches two bins of T. A lower bound below 0 is none, so times below 0 are one bin."""
    bin_of = lambda t: F.greatest(F.floor(t / seconds), F.lit(-1))
    rows, at = df.withColumn("bin", bin_of(F.col("timestamp_seconds"))), bin_of(F.col("asof_seconds"))
    dealt = ticks.select(*TICK, F.explode(F.sequence(F.greatest(at - 2, F.lit(-1)), at)).alias("bin"))
    low = F.col("asof_seconds") - seconds
    return rows, dealt, (F.col("timestamp_seconds") <= F.col("asof_seconds")) & ((low < 0) | (F.col("timestamp_seconds") >= low))


def lookback_time(df: DataFrame, ticks: DataFrame, seconds: float) -> DataFrame:
    """Rows with asof - seconds ≤ timestamp ≤ asof: an equi-join on bins and a filter, not a nested loop."""
    rows, dealt, held = binned(df, ticks, seconds)
    return join_same(rows, dealt, ["log_id"], ["bin"]).filter(held).select(*TICK, *(F.col(f"`{c}`") for c in df.columns if c != "log_id"))


def seen_once(df: DataFrame, ticks: DataFrame, seconds: float) -> DataFrame:
    """The rows that ``lookback_time`` returns for any tick, each once however many ticks see it."""
    rows, dealt, held = binned(df, ticks, seconds)
    dealt = dealt.select(F.col("log_id").alias("_log"), F.col("bin").alias("_bin"), "asof_seconds")
    return rows.join(dealt, F.col("log_id").eqNullSafe(F.col("_log")) & (F.col("bin") == F.col("_bin")) & held, "left_semi").drop("bin")


def lookback_frames(df: DataFrame, ticks: DataFrame, n: int, huge: bool = False) -> DataFrame:
    """The last ``n`` rows at or before each tick, in order: an equi-join on positions. A tick's own
    position is a running maximum over rows and ticks together."""
    indexed = row_index(df, ["log_id"], ["timestamp_seconds", "seq"], huge)
    at = asof_all(indexed, ticks, F.col("row_index"), huge).filter("high IS NOT NULL")
    wanted = at.select(*TICK, F.explode(F.sequence(F.greatest(F.col("high") - (n - 1), F.lit(0)), F.col("high"))).alias("row_index"))
    return join_same(indexed, wanted, ["log_id"], ["row_index"]).select(*TICK, "row_index", *(F.col(f"`{c}`") for c in df.columns if c != "log_id"))


def asof_all(df: DataFrame, ticks: DataFrame, value: Column, huge: bool = False) -> DataFrame:
    """Count, sum and maximum of ``value`` over everything at or before each tick: a running window
    over rows and ticks together, rows first where times are equal.

    With ``huge`` a log is also cut into ranges of time, equal times included: each range is run over
    alone, and the figures of earlier ranges (one small row a range) are added.
    """
    none, order = F.lit(None), ["t", "kind", "seq"]
    rows = df.select("log_id", F.col("timestamp_seconds").alias("t"), F.lit(0).alias("kind"), F.col("seq").cast("long"), value.alias("v"), none.cast("long").alias("tick_no"))
    marks = ticks.select("log_id", F.col("asof_seconds").alias("t"), F.lit(1).alias("kind"), F.col("tick_no").cast("long").alias("seq"), none.alias("v"), "tick_no")
    both, keys = rows.unionByName(marks), ["log_id"]
    if huge:
        keys = ["log_id", "chunk"]
        both = ranged(both, ["log_id"], order, "asof")
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.select(
        *keys, "tick_no", F.col("t").alias("asof_seconds"), "kind",
        F.count("v").over(w).alias("n"), F.sum("v").over(w).alias("total"), F.max("v").over(w).alias("high"),
    ).filter("kind = 1").drop("kind")
    if not huge:
        return seen
    tails = both.groupBy(*keys).agg(F.count("v").alias("n0"), F.sum("v").alias("total0"), F.max("v").alias("high0"))
    before = earlier(["log_id"])
    carry = tails.select(*keys, F.sum("n0").over(before).alias("n0"), F.sum("total0").over(before).alias("total0"), F.max("high0").over(before).alias("high0"))
    return join_same(seen, carry, ["log_id"], ["chunk"]).select(
        "log_id", "tick_no", "asof_seconds",
        (F.col("n") + F.coalesce("n0", F.lit(0))).alias("n"),
        F.coalesce(F.col("total") + F.col("total0"), "total", "total0").alias("total"),
        F.greatest("high", "high0").alias("high"),
    )


def asof_rows(df: DataFrame, ticks: DataFrame) -> DataFrame:
    """All rows at or before each tick; as many rows as that is, so for few ticks. ``panes.aggregate_time`` without
    seconds gives mergeable aggregates of them for any number."""
    return join_same(df, ticks.select(*TICK), ["log_id"]).filter("timestamp_seconds <= asof_seconds").select(*TICK, *(F.col(f"`{c}`") for c in df.columns if c != "log_id"))
