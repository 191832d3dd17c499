"""Points in time (ticks) at which a pipeline runs: log_id, tick_no, asof_seconds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rowindex import row_index

ORDER = ["timestamp_seconds", "seq"]
TICKS = pa.schema([("log_id", pa.string()), ("tick_no", pa.int64()), ("asof_seconds", pa.float64())])


def ticks_at_end(df: DataFrame) -> DataFrame:
    """The last message of each log."""
    last = df.groupBy("log_id").agg(F.max(F.struct(*ORDER)).alias("last"))
    return last.select("log_id", F.lit(0).cast("long").alias("tick_no"), F.col("last.timestamp_seconds").alias("asof_seconds"))


def ticks_every_frames(df: DataFrame, n: int, huge: bool = False) -> DataFrame:
    """Messages whose position is a multiple of ``n``; the first always is."""
    made = row_index(df.select("log_id", *ORDER), ["log_id"], ORDER, huge).filter(F.col("row_index") % n == 0)
    return made.select("log_id", (F.col("row_index") / n).cast("long").alias("tick_no"), F.col("timestamp_seconds").alias("asof_seconds"))


def greedy(seconds: np.ndarray, every: float, last: float | None = None) -> list[int]:
    """Positions that fire in sorted times: the first, then the first at least ``every`` later."""
    fired = [] if last is not None or not len(seconds) else [0]
    last = seconds[0] if fired else last
    while len(seconds):
        at = int(np.searchsorted(seconds, last + every))
        while at and seconds[at - 1] - last >= every:  # the difference decides, to the last bit
            at -= 1
        while at < len(seconds) and seconds[at] - last < every:
            at += 1
        if at >= len(seconds):
            break
        fired.append(at)
        last = seconds[at]
    return fired


def ticks_every_seconds(df: DataFrame, every: float, huge: bool = False) -> DataFrame:
    """Greedy: fires on the first message, then on the first at least ``every`` seconds after the
    last fired. Only times are shipped: sorted, many logs in a batch, and a long log over several, a log in one
    task. With ``huge`` a log is cut into ranges, which fire alone once it is known how each is entered."""
    if huge:
        from .jumps import greedy_rows

        fired = row_index(greedy_rows(df, ["log_id"], ORDER, every), ["log_id"], ORDER, True)
        return fired.select("log_id", F.col("row_index").alias("tick_no"), F.col("timestamp_seconds").alias("asof_seconds"))

    def fire(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, count = object(), None, 0
        for b in batches:
            logs, t, found = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(), []
            starts = np.flatnonzero(np.r_[True, logs[1:] != logs[:-1]]).tolist() if len(t) else []
            for low, high in zip(starts, [*starts[1:], len(t)]):
                if logs[low] != now:
                    now, last, count = logs[low], None, 0
                for at in greedy(t[low:high], every, last):
                    last = float(t[low + at])
                    found.append((now, count, last))
                    count += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(list(zip(*found)) or [[]] * 3, TICKS)], schema=TICKS)

    times = df.select("log_id", *ORDER).repartition("log_id").sortWithinPartitions("log_id", *ORDER).select("log_id", "timestamp_seconds")
    return times.mapInArrow(fire, "log_id string, tick_no long, asof_seconds double")
