"""Live topics: ingest, throttling, bounded buffers, ticks and pipelines on streams."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.jumps import greedy_rows
from ..operators.rowindex import join_same, with_running_sum
from ..operators.ticks import greedy
from ..plans.pipeline import Every, Pipeline

GIB = 1 << 30


class AlreadySubscribedError(RuntimeError):
    """The sink has a live query of that name."""


def with_timestamp(df: DataFrame, extractor: Column | None = None) -> DataFrame:
    """The message's own time, else the time it arrived."""
    now = F.unix_micros(F.current_timestamp()) / 1e6
    return df.withColumn("timestamp_seconds", now if extractor is None else F.coalesce(extractor.cast("double"), now))


def file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def runs(spark: SparkSession, folder: str) -> list[str]:
    """The sub-tables of a live table, one for each time it was started or resumed, in order."""
    fs, at = file_system(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(at) if x.getPath().getName().startswith("run-")) if fs.exists(at) else []


def ingest(
    source: DataFrame,
    folder: str,
    checkpoint: str,
    topics: list[str] | None = None,
    name: str = "ingest",
    available_now: bool = True,
    overwrite: bool = False,
    new_run: bool = False,
) -> StreamingQuery:
    """Appends each message of the topics to a table partitioned by topic. One live query a name;
    ``overwrite`` stops it and starts a new table. A run has a sub-table and a checkpoint of its own; the
    last one goes on where it ended, unless ``new_run``."""
    spark = source.sparkSession
    running = [q for q in spark.streams.active if q.name == name]
    if running and not overwrite:
        raise AlreadySubscribedError(name)
    for q in running:
        q.stop()
    if overwrite:
        for path in (folder, checkpoint):
            fs, at = file_system(spark, path)
            fs.delete(at, True)
    known = runs(spark, folder)
    run = f"run-{len(known):06d}" if new_run or not known else known[-1]
    df = source if topics is None else source.filter(F.col("topic").isin(topics))
    writer = df.writeStream.queryName(name).format("parquet").partitionBy("topic").option("path", f"{folder}/{run}").option("checkpointLocation", f"{checkpoint}/{run}")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def pause(query: StreamingQuery) -> None:
    """What is sent while a query is paused is lost, if it resumes from the latest offsets."""
    query.stop()


def resume(
    source: DataFrame, folder: str, checkpoint: str, topics: list[str] | None = None, name: str = "ingest", available_now: bool = True, since: Column | None = None
) -> StreamingQuery:
    """Goes on with the same table, in a run of its own. ``source`` starts at the latest offsets, or ``since``
    says which of its messages were sent after the pause; the others are lost."""
    return ingest(source if since is None else source.filter(since), folder, checkpoint, topics, name, available_now, new_run=True)


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """What is committed of a growing table: each run's sink log says which files."""
    out = None
    for run in runs(spark, folder):
        one = spark.read.parquet(f"{folder}/{run}")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no live table in {folder}")
    return out


def live_topics(df: DataFrame) -> DataFrame:
    return df.groupBy("topic").agg(F.count("*").alias("message_count"))


def throttle(df: DataFrame, ms: float, huge: bool = False) -> DataFrame:
    """Batch: keeps a topic's messages at least ``ms`` apart, greedily, the first included. Only times are
    shipped to Python; with ``huge`` a topic is cut into ranges."""
    order, keys = ["timestamp_seconds", "seq"], ["log_id", "topic"]
    if huge:
        kept = greedy_rows(df, keys, order, ms / 1000)
    else:

        def keep(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order)
            return pdf.iloc[greedy(pdf["timestamp_seconds"].to_numpy(), ms / 1000)]

        times = df.select("log_id", "topic", "seq", "timestamp_seconds")
        kept = times.groupBy(*keys).applyInPandas(keep, times.schema)
    named = kept.withColumnsRenamed({c: f"_{c}" for c in kept.columns})
    return df.join(named, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in kept.columns], "left_semi")


def sorted_times(frames: Iterator[pd.DataFrame], packed: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Times of a group in order, ties by ``seq``; the rows' positions in that order; and the sizes of the frames. Of a frame two
    numbers a row are held, and with ``packed`` its rows as compressed bytes, as a group may be a whole topic."""
    t, seq = [], []
    for pdf in frames:
        t.append(pdf["timestamp_seconds"].to_numpy(float, copy=True))
        seq.append(pdf["seq"].to_numpy(copy=True))
        if packed is not None:
            packed.append(zlib.compress(pickle.dumps(pdf, pickle.HIGHEST_PROTOCOL), 1))
        del pdf
    sizes = [len(x) for x in t]
    times, numbers = np.concatenate(t), np.concatenate(seq)
    del t, seq
    order = np.lexsort((numbers, times))
    return times[order], order, sizes


def throttle_stream(df: DataFrame, ms: float) -> DataFrame:
    """The same on a stream, whole messages: the state is the time last kept."""

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, packed = state.get[0] if state.exists else None, []
        t, order, sizes = sorted_times(frames, packed)
        at = greedy(t, ms / 1000, last)
        if at:
            state.update((float(t[at[-1]]),))
        kept = np.sort(order[at])
        ends = np.cumsum(sizes)
        for i in np.unique(np.searchsorted(ends, kept, "right")):
            own = kept[(kept >= ends[i] - sizes[i]) & (kept < ends[i])] - (ends[i] - sizes[i])
            yield pickle.loads(zlib.decompress(packed[i])).iloc[own]

    return df.groupBy("log_id", "topic").applyInPandasWithState(keep, df.schema, "last double", "append", "NoTimeout")


def retain_bytes(df: DataFrame, budget: int | None = GIB, line: Column | None = None, huge: bool = False) -> DataFrame:
    """The newest whole lines (JSON, or ``line``) of each topic within ``budget`` bytes; without one, all."""
    line = F.to_json(F.struct("timestamp_seconds", "message")) if line is None else line
    made = df.withColumn("line_bytes", F.octet_length(line) + 1)
    if budget is None:
        return made
    return newest_lines(made, budget, ["timestamp_seconds", "seq"], huge)


def newest_lines(df: DataFrame, budget: int | None, order: list[str], huge: bool = False) -> DataFrame:
    """The newest of ``df`` by ``order`` whose ``line_bytes`` are within ``budget`` for each topic of a log."""
    if budget is None:
        return df
    # From the newest on: all of the topic's bytes less those of older lines.
    keys = ["log_id", "topic"]
    upto = with_running_sum(df, keys, order, F.col("line_bytes"), "_upto", huge)
    whole = df.groupBy(*keys).agg(F.sum("line_bytes").alias("_whole"))
    held = F.col("_whole") - F.col("_upto") + F.col("line_bytes")
    return join_same(upto, whole, keys).filter(held <= budget).select(*df.columns)


def fires(t: np.ndarray, cadence: Every | None, count: int, last: float | None) -> list[int]:
    """Positions in sorted times ``t`` at which a cadence fires after ``count`` messages and a tick at ``last``."""
    if cadence is None:
        return [0] if last is None and len(t) else []
    if cadence.unit == "frame":
        return list(range(-count % int(cadence.value), len(t), int(cadence.value)))
    return greedy(t, cadence.seconds(), last)


def stream_ticks(df: DataFrame, cadence: Every | None) -> DataFrame:
    """Ticks of a live topic: the first message always fires, then every N messages or T seconds;
    without a cadence (once at the end) nothing more until ``final_ticks``."""

    def fire(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        count, last = state.get if state.exists else (0, None)
        t = sorted_times(frames)[0]
        at = fires(t, cadence, count, last)
        last = float(t[at[-1]]) if at else last
        state.update((count + len(t), last))
        yield pd.DataFrame({"log_id": key[0], "topic": key[1], "asof_seconds": t[at]})

    kept = df.select("log_id", "topic", "seq", "timestamp_seconds")
    return kept.groupBy("log_id", "topic").applyInPandasWithState(
        fire, "log_id string, topic string, asof_seconds double", "count long, last double", "append", "NoTimeout"
    )


def stream_run(ticks: DataFrame, pipeline: Pipeline, buffer: Callable[[], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """The pipeline at the ticks of its own topic in each micro-batch, as one set-based plan over the buffer so far.
    A log that failed in an earlier batch has no more ticks, unless failures are allowed. ``pipelines.run_live`` also
    makes the ticks, numbers them on, and keeps only the rows that lookbacks need.

    Each task's rows go to ``folder/<task>`` and the run log to ``folder/run_log``, a sub-folder a batch
    that is overwritten, so that a batch which is repeated after a failure is there once. Tick numbers are
    positions in a log, after those of earlier batches.
    """

    def batch(df: DataFrame, number: int) -> None:
        w = Window.partitionBy("log_id").orderBy("asof_seconds", "topic")
        df = df.filter(F.col("topic") == pipeline.topic) if "topic" in df.columns else df
        earlier = [p for p in (f"{folder}/run_log/batch={i}" for i in range(number)) if file_system(df.sparkSession, p)[0].exists(file_system(df.sparkSession, p)[1])]
        if earlier and not pipeline.allow_failure:
            failed = df.sparkSession.read.parquet(*earlier).filter("status = 'failed'").select("log_id").distinct()
            df = df.join(failed.withColumnRenamed("log_id", "_log"), F.col("log_id").eqNullSafe(F.col("_log")), "left_anti")
        numbered = df.withColumn("tick_no", F.row_number().over(w) - 1 + F.lit(number << 32)).select("log_id", "tick_no", "asof_seconds")
        made, log = pipeline.run(buffer(), numbered)
        for name, out in {**made, "run_log": log}.items():
            out.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def final_ticks(messages: DataFrame, ran: DataFrame) -> DataFrame:
    """On close, once-at-end pipelines fire at each topic's last timestamp, unless that has run."""
    last = messages.groupBy("log_id", "topic").agg(F.max("timestamp_seconds").alias("asof_seconds"))
    return last.join(ran.select("log_id", "topic", "asof_seconds"), ["log_id", "topic", "asof_seconds"], "left_anti")
