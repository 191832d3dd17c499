"""Pipelines on streams that run until they are stopped.

Each micro-batch is one set-based run. What it needs of the past is a state table of two parts that the batch before
wrote: a row a log (messages of the cadence's topic and ticks so far, the last tick, the latest time, the tick at which
it failed), and the rows that a lookback of a later tick can still reach. So a batch reads its own messages and that
state, never the table from its start. State and results of a batch lie in folders of its number: one that is
repeated after a failure starts from the state before it and overwrites its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.rowindex import join_same
from ..operators.ticks import TICKS
from ..plans.pipeline import Every, Pipeline
from .live import file_system, fires

LOGS = "log_id string, count long, ticks long, last double, high double, stopped long"


class PipelineFailedError(RuntimeError):
    """A pipeline failed at a tick and doesn't allow that."""


def new_ticks(messages: DataFrame, logs: DataFrame, topic: str, when: Every | None) -> DataFrame:
    """Ticks of a micro-batch: log_id, tick_no, asof_seconds; numbers go on from the logs' state. Stopped logs have none."""

    def fire(own: pa.Table, state: pa.Table) -> pa.Table:
        known = state.to_pylist()[0] if state.num_rows else {"count": 0, "ticks": 0, "last": None, "stopped": None}
        if not own.num_rows or known["stopped"] is not None:
            return TICKS.empty_table()
        t = own.sort_by([("timestamp_seconds", "ascending"), ("seq", "ascending")]).column("timestamp_seconds").to_numpy()
        at = fires(t, when, known["count"], known["last"])
        numbers = np.arange(known["ticks"], known["ticks"] + len(at))
        return pa.table([pa.array([own.column("log_id")[0].as_py()] * len(at), pa.string()), pa.array(numbers), pa.array(t[at])], schema=TICKS)

    own = messages.filter(F.col("topic") == topic).select("log_id", "timestamp_seconds", "seq")
    return own.groupBy("log_id").cogroup(logs.groupBy("log_id")).applyInArrow(fire, "log_id string, tick_no long, asof_seconds double")


def after(logs: DataFrame, messages: DataFrame, topic: str, ticks: DataFrame, log: DataFrame, allow_failure: bool) -> DataFrame:
    """The logs' state after a micro-batch."""
    seen = messages.groupBy("log_id").agg(F.count_if(F.col("topic") == topic).alias("count"), F.max("timestamp_seconds").alias("high"))
    fired = ticks.groupBy("log_id").agg(F.count("*").alias("ticks"), F.max_by("asof_seconds", "tick_no").alias("last"))
    failed = log.filter("status = 'failed'").groupBy("log_id").agg(F.min("tick_no").alias("stopped"))
    none = lambda *names: [F.lit(None).cast("double" if n in ("last", "high") else "long").alias(n) for n in names]
    columns = ["log_id", "count", "ticks", "last", "high", "stopped"]
    parts = [
        logs.withColumn("at", F.lit(0)),
        seen.select("log_id", "count", *none("ticks", "last"), "high", *none("stopped")).withColumn("at", F.lit(1)),
        fired.select("log_id", *none("count"), "ticks", "last", *none("high", "stopped")).withColumn("at", F.lit(1)),
        failed.select("log_id", *none("count", "ticks", "last", "high"), F.lit(None).cast("long").alias("stopped") if allow_failure else "stopped").withColumn("at", F.lit(1)),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    latest = F.max_by("last", F.when(F.col("last").isNotNull(), F.col("at"))).alias("last")
    return whole.groupBy("log_id").agg(total("count"), total("ticks"), latest, F.max("high").alias("high"), F.min("stopped").alias("stopped")).select(*columns)


def still_needed(rows: DataFrame, logs: DataFrame, reaches: list[Every | None], late: float) -> DataFrame:
    """The rows that a lookback of a later tick can reach, if messages come at most ``late`` seconds out of order."""
    held = join_same(rows, logs.select("log_id", "high", F.col("stopped").alias("_stopped")), ["log_id"]).filter("_stopped IS NULL")
    if not reaches or None in reaches:
        return (held if reaches else held.limit(0)).select(*rows.columns)
    seconds = [r.seconds() for r in reaches if r.unit != "frame"]
    frames = [int(r.value) for r in reaches if r.unit == "frame"]
    # Rows up to ``late`` before the latest may still lie after a tick to come.
    keep = F.col("timestamp_seconds") >= F.col("high") - (late + max(seconds, default=0.0))
    if frames:
        settled = F.col("timestamp_seconds") < F.col("high") - late
        back = F.row_number().over(Window.partitionBy("log_id", settled).orderBy(F.desc("timestamp_seconds"), F.desc("seq")))
        held = held.withColumn("_back", back)
        keep = keep | (F.col("_back") <= max(frames))
    return held.filter(keep).select(*rows.columns)


def run_live(
    messages: DataFrame, pipeline: Pipeline, folder: str, checkpoint: str, trigger: dict | None = None, late: float = 0.0, end_on_failure: bool = False
) -> StreamingQuery:
    """Runs ``pipeline`` on a stream of messages (log_id, topic, seq, timestamp_seconds, message) until it is stopped.

    Its own topic and cadence fire it, the first message always. Gates and tasks get the rows that they see as ``seen()``
    and ``seen.aggregate(None, ...)``. Each task's rows go to ``folder/<task>/batch=<n>``, the run log to
    ``folder/run_log``. A log whose tick failed has no more ticks in any later batch, unless failures are allowed; with
    ``end_on_failure`` the stream itself ends with ``PipelineFailedError`` then, after its results are written. Without a
    lookback a tick sees all so far, and all rows are kept. ``trigger`` is that of the stream; without one, what there
    is now is run.
    """
    spark = messages.sparkSession
    state = lambda number, part: f"{folder}/state/batch={number}/{part}"
    exists = lambda path: (lambda fs, at: fs.exists(at))(*file_system(spark, path))

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        session = df.sparkSession
        known = exists(state(number - 1, "rows/_SUCCESS"))
        logs = session.read.schema(LOGS).parquet(state(number - 1, "logs")) if known else session.createDataFrame([], LOGS)
        rows = df.unionByName(session.read.schema(df.schema).parquet(state(number - 1, "rows"))) if known else df
        path = f"{folder}/ticks/batch={number}"
        new_ticks(df, logs, pipeline.topic, pipeline.when).write.mode("overwrite").parquet(path)
        ticks = session.read.schema("log_id string, tick_no long, asof_seconds double").parquet(path)
        made, log = pipeline.run(rows, ticks)
        for name, out in {**made, "run_log": log}.items():
            out.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        log = session.read.parquet(f"{folder}/run_log/batch={number}")
        after(logs, df, pipeline.topic, ticks, log, pipeline.allow_failure).write.mode("overwrite").parquet(state(number, "logs"))
        logs = session.read.schema(LOGS).parquet(state(number, "logs"))
        still_needed(rows, logs, pipeline.reaches(), late).write.mode("overwrite").parquet(state(number, "rows"))
        fs, old = file_system(session, f"{folder}/state/batch={number - 2}")
        fs.delete(old, True)
        df.unpersist()
        if end_on_failure and not pipeline.allow_failure and (failed := log.filter("status = 'failed'").orderBy("asof_seconds").first()):
            raise PipelineFailedError(f"{pipeline.name} failed in {failed['log_id']} at {failed['asof_seconds']}: {failed['error']}")

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
