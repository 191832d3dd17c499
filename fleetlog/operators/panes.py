"""Aggregates over overlapping windows, each row aggregated once.

A tick's window of W seconds is cut at the edges of bins of W/2 seconds that all ticks share: the end of
one bin, whole bins, and the start of another. Running aggregates within bins, forwards and backwards, over
rows and window edges together, give every such piece, and a tick merges its three or four. So rows are shuffled
once, however many windows hold them, and bins of one log run in parallel. Aggregates need to be mergeable, not to be undone, so that least
and greatest work as sums do.

With ``huge`` bins are also cut into ranges of time, and the pieces of other ranges (one small row a range) are merged
in, so that no task holds a whole bin.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rowindex import join_same, ranged, row_index

TICK = ("log_id", "tick_no", "asof_seconds")
#: Shorter windows than this have no halves that doubles of today's times could tell apart.
SHORTEST = 1e-5
FOLDS: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Mergeable:
    """An aggregate made of sums, least and greatest values: ``parts`` are (fold, value of a row), and ``finish`` takes
    the parts of a window, which are NULL where nothing was folded."""

    parts: tuple[tuple[str, Column], ...]
    finish: Callable[..., Column]


@dataclass(frozen=True)
class Condition:
    """A boolean of named aggregates."""

    aggregates: dict[str, Mergeable]
    holds: Column


def count(value: Column | None = None) -> Mergeable:
    return Mergeable((("sum", F.lit(1) if value is None else F.when(value.isNotNull(), 1)),), lambda n: F.coalesce(n, F.lit(0)).cast("long"))


def total(value: Column) -> Mergeable:
    return Mergeable((("sum", value),), lambda s: s)


def low(value: Column) -> Mergeable:
    return Mergeable((("min", value),), lambda x: x)


def high(value: Column) -> Mergeable:
    return Mergeable((("max", value),), lambda x: x)


def mean(value: Column) -> Mergeable:
    return Mergeable((("sum", value.cast("double")), ("sum", F.when(value.isNotNull(), 1))), lambda s, n: s / F.nullif(n, F.lit(0)))


def spread(value: Column, about: float = 0.0) -> Mergeable:
    """Sample standard deviation; ``about`` is a value near the mean, for exactness where that is large."""
    own = value.cast("double") - F.lit(about)
    parts = (("sum", own), ("sum", own * own), ("sum", F.when(value.isNotNull(), 1)))
    return Mergeable(parts, lambda s, q, n: F.when(n > 1, F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0)))))


def any_of(condition: Column) -> Mergeable:
    return Mergeable((("max", condition.cast("int")),), lambda x: x == 1)


def every(condition: Column) -> Mergeable:
    return Mergeable((("min", condition.cast("int")),), lambda x: x == 1)


def newest(value: Column) -> Mergeable:
    """The value of the window's last row."""
    return Mergeable((("max", F.struct("timestamp_seconds", "seq", value.alias("v"))),), lambda x: x["v"])


def oldest(value: Column) -> Mergeable:
    return Mergeable((("min", F.struct("timestamp_seconds", "seq", value.alias("v"))),), lambda x: x["v"])


def finished(df: DataFrame, aggregates: dict[str, Mergeable], found: str) -> DataFrame:
    """The aggregates of ``df``'s parts p0, p1, ..., in their order; ``found`` filters ticks."""
    made, at = [], 0
    for name, a in aggregates.items():
        made.append(a.finish(*(F.col(f"p{at + i}") for i in range(len(a.parts)))).alias(name))
        at += len(a.parts)
    return df.filter(found).select(*TICK, *made)


def edges(ticks: DataFrame, bin_of: Callable[[Column], Column], width: float) -> DataFrame:
    """The pieces of each tick's window: the bin, the time and whether rows before (1) or from (-1) there on count."""
    upto, since = F.col("asof_seconds"), F.col("asof_seconds") - width
    last, first = bin_of(upto), F.when(since < 0, F.lit(-2)).otherwise(bin_of(since))
    apart = F.when(first >= last, F.raise_error(F.lit("a window is too short for its times")).cast("long")).otherwise(last - 1)
    whole = F.when(first + 1 <= last - 1, F.sequence(first + 1, apart))
    piece = lambda b, t, kind: F.struct(b.alias("bin"), t.alias("t"), F.lit(kind).alias("kind"))
    pieces = F.concat(
        F.array(piece(last, upto, 1)),
        F.coalesce(F.transform(whole, lambda b: piece(b, F.lit(float("inf")), 1)), F.array().cast("array<struct<bin:bigint,t:double,kind:int>>")),
        F.when(since >= 0, F.array(piece(first, since, -1))).otherwise(F.array().cast("array<struct<bin:bigint,t:double,kind:int>>")),
    )
    return ticks.select(*TICK, F.explode(pieces).alias("_")).select(*TICK, "_.*")


def aggregate_time(df: DataFrame, ticks: DataFrame, seconds: float | None, aggregates: dict[str, Mergeable], huge: bool = False, empty: bool = False) -> DataFrame:
    """``aggregates`` of the rows with asof - seconds ≤ timestamp ≤ asof, for each tick; a lower bound below 0 is none,
    and without ``seconds`` there is none at all. Ticks whose window is empty are there with ``empty`` only.

    A NULL log is a log; rows and ticks without a time see nothing.
    """
    if seconds is not None and seconds < SHORTEST:
        raise ValueError(f"windows are {SHORTEST} seconds at least")
    return aggregated(df, F.col("timestamp_seconds").cast("double"), ticks, seconds, aggregates, huge, empty)


def aggregate_frames(df: DataFrame, ticks: DataFrame, n: int, aggregates: dict[str, Mergeable], huge: bool = False, empty: bool = False) -> DataFrame:
    """The same over the last ``n`` rows at or before each tick: windows over positions."""
    indexed = row_index(df, ["log_id"], ["timestamp_seconds", "seq"], huge)
    own = aggregate_time(indexed, ticks, None, {"high": high(F.col("row_index"))}, huge, True)
    placed = own.select("log_id", "tick_no", F.coalesce("high", F.lit(-1)).cast("double").alias("asof_seconds"))
    made = aggregated(indexed, F.col("row_index").cast("double"), placed, n - 0.5, aggregates, huge, empty).drop("asof_seconds")
    return join_same(ticks.select(*TICK), made, ["log_id", "tick_no"]).select(*TICK, *aggregates)


def aggregated(df: DataFrame, at: Column, ticks: DataFrame, width: float | None, aggregates: dict[str, Mergeable], huge: bool, empty: bool) -> DataFrame:
    folds = [fold for a in aggregates.values() for fold, _ in a.parts] + ["sum"]
    values = [value for a in aggregates.values() for _, value in a.parts] + [F.lit(1)]  # the last counts rows
    names = [f"p{i}" for i in range(len(folds))]
    # Times before 1970 are one bin, -1, as a window that reaches them reaches all of them.
    bin_of = lambda t: F.lit(0).cast("long") if width is None else F.greatest(F.floor(t / (width / 2)), F.lit(-1)).cast("long")
    rows = df.filter(at.isNotNull() & ~F.isnan(at)).select("log_id", bin_of(at).alias("bin"), at.alias("t"), F.lit(0).alias("kind"), *(v.alias(p) for v, p in zip(values, names)))
    timed = ticks.filter("asof_seconds IS NOT NULL AND NOT isnan(asof_seconds)")
    marks = timed.select(*TICK, bin_of(F.lit(0)).alias("bin"), F.col("asof_seconds").alias("t"), F.lit(1).alias("kind")) if width is None else edges(timed, bin_of, width)
    both, keys, order = rows.unionByName(marks, allowMissingColumns=True), ["log_id", "bin"], ["t", "kind"]
    if huge:
        both = ranged(both, keys, order, "panes")
        keys = [*keys, "chunk"]
    # Marks lie so that what counts is before them forwards (kind 1), or backwards (kind -1).
    running = lambda own, *by: Window.partitionBy(*own).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    forth, back = running(keys, *order), running(keys, F.desc("t"), F.desc("kind"))
    folded = lambda w: [FOLDS[f](p).over(w) for f, p in zip(folds, names)]
    upto = [x.alias(p) for x, p in zip(folded(forth), names)]
    if width is None:
        seen = both.select(*keys, "tick_no", "asof_seconds", "kind", *upto).filter("kind <> 0")
    else:
        since = [F.when(F.col("kind") == -1, x).otherwise(y).alias(p) for x, y, p in zip(folded(back), folded(forth), names)]
        seen = both.select(*keys, "tick_no", "asof_seconds", "kind", *since).filter("kind <> 0")
    pieces = seen.select(*TICK, *names)
    if huge:
        tails = both.groupBy(*keys).agg(*(FOLDS[f](p).alias(p) for f, p in zip(folds, names)))
        apart = lambda *by: Window.partitionBy("log_id", "bin").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        before, after = folded(apart("chunk")), folded(apart(F.desc("chunk")))
        both_ways = [F.struct(F.lit(k).alias("kind"), *(x.alias(p) for x, p in zip(c, names))) for k, c in ((1, before), (-1, after))]
        carry = tails.select(*keys, F.array(*both_ways).alias("_")).select(*keys, F.explode("_").alias("_"))
        carried = join_same(seen.select(*TICK, *keys[1:], "kind"), carry.select(*keys, "_.*"), ["log_id"], [*keys[1:], "kind"])
        pieces = pieces.union(carried.select(*TICK, *names))
    merged = pieces.groupBy(*TICK).agg(*(FOLDS[f](p).alias(p) for f, p in zip(folds, names)))
    return finished(merged, aggregates, "true" if empty else f"{names[-1]} > 0")
