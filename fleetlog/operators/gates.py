"""Gates: which ticks pass. A gate maps ticks to (log_id, tick_no, asof_seconds, passed)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookback import TICK, lookback_time
from .panes import Condition, aggregate_time
from .rowindex import join_same

GATES: dict[str, Callable[..., DataFrame]] = {}
TASKS: dict[str, Callable[..., DataFrame]] = {}


def register_gate(name: str, fn: Callable[..., DataFrame]) -> None:
    GATES[name] = fn


def register_task(name: str, fn: Callable[..., DataFrame]) -> None:
    TASKS[name] = fn


def call(registry: dict[str, Callable[..., DataFrame]], name: str, **arguments) -> DataFrame:
    """Runs a registered gate or task: arguments it doesn't know are ignored, missing ones raise."""
    import inspect

    if name not in registry:
        raise KeyError(f"nothing registered as {name!r}")
    known = inspect.signature(registry[name]).parameters
    return registry[name](**{k: v for k, v in arguments.items() if k in known})


def sql_gate(ticks: DataFrame, rows: DataFrame, select: Column | Condition, seconds: float, huge: bool = False) -> DataFrame:
    """``select``, a boolean aggregate, over each tick's lookback of ``rows``. A tick with an empty
    window gets the aggregate's value on no rows; NULL is an error.

    A ``Condition`` of mergeable aggregates is answered from panes, at a cost that doesn't grow with the overlap of
    lookbacks; any other aggregate copies a row to each window that holds it."""
    wrong = F.raise_error(F.lit("a gate's value is NULL")).cast("boolean")
    if isinstance(select, Condition):
        made = aggregate_time(rows, ticks, seconds, select.aggregates, huge, empty=True)
        return made.select(*TICK, F.coalesce(select.holds, wrong).alias("passed"))
    seen = lookback_time(rows, ticks, seconds).groupBy(*TICK).agg(select.alias("value"))
    nothing = rows.limit(0).agg(select.alias("value")).first()[0]
    value = F.when(F.col("hit"), F.col("value")).otherwise(F.lit(nothing).cast("boolean"))
    joined = join_same(ticks, seen.withColumn("hit", F.lit(True)), list(TICK), how="left")
    return joined.select(*TICK, F.coalesce(value, wrong).alias("passed"))


def sql_gate_statement(ticks: DataFrame, rows: DataFrame, statement: str, seconds: float) -> DataFrame:
    """A full statement over ``{window}``, the rows of a tick's lookback, evaluated for each tick.

    Rows are joined to ticks by bins of time first, so the statement depends on its tick by equality alone, and Spark
    runs it as hash joins and grouping by tick for all ticks together. A row is copied to each lookback that
    holds it; mergeable aggregates (a ``Condition``) don't need that."""
    spark = ticks.sparkSession
    own = uuid.uuid4().hex  # runs in one session don't share views
    seen = lookback_time(rows, ticks, seconds).withColumnsRenamed({"log_id": "_log", "tick_no": "_tick", "asof_seconds": "_asof"}).withColumn("log_id", F.col("_log"))
    ticks.createOrReplaceTempView(f"gate_ticks_{own}")
    seen.createOrReplaceTempView(f"gate_rows_{own}")
    columns = ", ".join(f"r.`{c}`" for c in rows.columns)
    body = statement.replace("{window}", f"(SELECT {columns} FROM gate_rows_{own} r WHERE r._log <=> t.log_id AND r._tick = t.tick_no)")
    try:
        return spark.sql(f"SELECT t.log_id, t.tick_no, t.asof_seconds, g.passed FROM gate_ticks_{own} t, LATERAL ({body}) AS g(passed)")
    finally:
        spark.catalog.dropTempView(f"gate_ticks_{own}")
        spark.catalog.dropTempView(f"gate_rows_{own}")


def passing(gate: DataFrame) -> DataFrame:
    return gate.filter("passed").select(*TICK)


def gate_and(ticks: DataFrame, gates: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Ticks that pass all gates; a later gate sees only what earlier ones passed."""
    for gate in gates:
        passed = passing(gate(ticks)).withColumnsRenamed({k: f"_{k}" for k in TICK})
        ticks = ticks.join(passed, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in TICK], "left_semi")
    return ticks


def detection_gate(detections: DataFrame, labels: list[str] | None, score: float, threshold: float | None = None) -> DataFrame:
    """Frames of ``detections`` (frame, label, score, closeness) with one of ``labels`` (None: any), sure
    enough and near enough. Closeness is scaled to 0..1 in each frame; without a threshold, the median."""
    if labels is not None and not labels:
        raise ValueError("no labels")
    if not 0 <= score <= 1 or (threshold is not None and not 0 <= threshold <= 1):
        raise ValueError("score and threshold lie between 0 and 1")
    w = Window.partitionBy("frame")
    low, high = F.min("closeness").over(w), F.max("closeness").over(w)
    scaled = detections.withColumn("near", F.when(high > low, (F.col("closeness") - low) / (high - low)).otherwise(0.0))
    limit = F.median("near").over(w) if threshold is None else F.lit(threshold)
    return scaled.withColumn("limit", limit).groupBy("frame").agg(
        F.bool_or((F.lit(True) if labels is None else F.col("label").isin(labels)) & (F.col("score") >= score) & (F.col("near") >= F.col("limit"))).alias("passed")
    )
