"""Greedy cadences over one huge log, without one task for it.

A cadence fires on the first row, then on the first at least so many seconds after the last that fired. Where a range of
rows is entered with some last time, one row fires first, and the last one to fire follows from it. So a range gives a
small table: which last time it is left with, by the first row that fires, which are few as greedy chains soon
meet. These tables are followed from range to range in order, a row at a time, and then all ranges fire alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .ticks import greedy

RANGE_ROWS = 1 << 20  # rows of a range, about


def successors(t: np.ndarray, every: float) -> np.ndarray:
    """For each of sorted times, the position of the first at least ``every`` later; the difference decides, to the last bit."""
    at = np.searchsorted(t, t + every)
    while (back := (at > 0) & (t[np.maximum(at - 1, 0)] - t >= every)).any():
        at[back] -= 1
    while (on := (at < len(t)) & (t[np.minimum(at, len(t) - 1)] - t < every)).any():
        at[on] += 1
    return at


def exits(t: np.ndarray, every: float) -> tuple[np.ndarray, np.ndarray]:
    """Where firing first at one row or another makes a difference: the time before such a row (-inf for the first), and the
    last time that fires from there on."""
    follow = successors(t, every)
    last = np.where(follow < len(t), follow, np.arange(len(t)))
    while not np.array_equal(further := last[last], last):  # doubles the steps taken
        last = further
    start = np.flatnonzero(np.r_[True, last[1:] != last[:-1]])
    return np.where(start > 0, t[start - 1], -np.inf), t[last[start]]


def greedy_rows(df: DataFrame, keys: list[str], order: list[str], every: float) -> DataFrame:
    """The rows of ``df`` (keys and order only; the first of order is the time) that fire in each group."""
    time = order[0]
    own = df.select(*keys, *order).filter(F.col(time).isNotNull() & ~F.isnan(time))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(own.count() / RANGE_ROWS))
    dealt = stage(own.repartitionByRange(parts, *keys, *order).withColumn("chunk", F.spark_partition_id()), "greedy")
    kinds = ", ".join(f"`{k}` {dealt.schema[k].dataType.simpleString()}" for k in keys)

    def sort(table: pa.Table) -> pa.Table:
        return table.sort_by([(c, "ascending") for c in order])

    def jump(table: pa.Table) -> pa.Table:
        t = sort(table).column(time).to_numpy()
        before, last = exits(t, every)
        n = len(before)
        group = {k: pa.chunked_array([pa.concat_arrays([table.column(k).slice(0, 1).combine_chunks()] * n)]) for k in keys}
        return pa.table({**group, "chunk": pa.array([table.column("chunk")[0].as_py()] * n, pa.int32()), "before": before, "leaves": last, "ends": np.full(n, t[-1])})

    maps = dealt.groupBy(*keys, "chunk").applyInArrow(jump, f"{kinds}, chunk int, before double, leaves double, ends double")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = chunk = None
        entry = left = None  # the last time on entering this range, and on leaving it
        for b in batches:
            owners, columns = list(zip(*(b.column(k).to_pylist() for k in keys))), [b.column(c).to_pylist() for c in ("chunk", "before", "leaves", "ends")]
            out = []
            for i, (own, now, before, leaves, ends) in enumerate(zip(owners, *columns)):
                if own != group:
                    group, chunk, entry, left = own, None, None, None
                if now != chunk:
                    chunk, entry = now, left
                    out.append((i, entry))
                if entry is None:
                    left = leaves if before == -math.inf else left  # the first row of all fires
                elif before - entry < every and ends - entry >= every:
                    left = leaves
            picked = b.take(pa.array([i for i, _ in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(picked.column(k) for k in keys), picked.column("chunk"), pa.array([e for _, e in out], pa.float64())], names=[*keys, "chunk", "entry"])

    followed = maps.repartition(*keys).sortWithinPartitions(*keys, "chunk", "before").mapInArrow(follow, f"{kinds}, chunk int, entry double")
    entries = stage(followed, "greedy-entries")

    def fire(table: pa.Table, known: pa.Table) -> pa.Table:
        table = sort(table)
        return table.select([*keys, *order]).take(pa.array(greedy(table.column(time).to_numpy(), every, known.column("entry")[0].as_py()), pa.int64()))

    fired = dealt.groupBy(*keys, "chunk").cogroup(entries.groupBy(*keys, "chunk"))
    return fired.applyInArrow(fire, own.schema)
