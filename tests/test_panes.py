"""Aggregates over overlapping windows, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fleetlog.operators import gates, panes, tasks
from fleetlog.plans.pipeline import Every, Seen
from fleetlog.storage import remove_staged

ROWS = "log_id string, topic string, seq long, timestamp_seconds double, v double, other string"


def made(seed, size, span):
    r = random.Random(seed)
    times = [r.choice((r.uniform(-30, span), float(r.randint(0, int(span))))) for _ in range(size)]
    rows = [(r.choice(("a", "a", "b", None)), "x", i, t, r.choice((None, r.uniform(-5, 5))), "y") for i, t in enumerate(times)]
    rows += [("a", "x", size, None, 1.0, "y"), ("a", "x", size + 1, float("nan"), 1.0, "y")]
    ticks = [(r.choice(("a", "b", None, "empty")), i, r.choice((r.uniform(-20, span), float(r.randint(-3, int(span))), times[r.randrange(size)]))) for i in range(60)]
    return rows, ticks


def aggregates():
    return {
        "n": panes.count(), "known": panes.count(F.col("v")), "total": panes.total(F.col("v")), "low": panes.low(F.col("v")), "high": panes.high(F.col("v")),
        "mean": panes.mean(F.col("v")), "spread": panes.spread(F.col("v")), "some": panes.any_of(F.col("v") > 4), "all": panes.every(F.col("v") < 4),
        "last": panes.newest(F.col("v")), "first": panes.oldest(F.col("seq")),
    }


def wanted(inside):
    v = [x[4] for x in inside if x[4] is not None]
    mean = sum(v) / len(v) if v else None
    spread = math.sqrt(sum((x - mean) ** 2 for x in v) / (len(v) - 1)) if len(v) > 1 else None
    order = sorted(inside, key=lambda x: (x[3], x[2]))
    return {
        "n": len(inside), "known": len(v), "total": sum(v) if v else None, "low": min(v, default=None), "high": max(v, default=None), "mean": mean, "spread": spread,
        "some": any(x > 4 for x in v) if v else None, "all": all(x < 4 for x in v) if v else None,
        "last": order[-1][4] if order else None, "first": order[0][2] if order else None,
    }


def same(got, want):
    return all(got[k] == x or (isinstance(x, float) and got[k] is not None and abs(got[k] - x) < 1e-6) for k, x in want.items())


@pytest.mark.parametrize("huge", [False, True])
@pytest.mark.parametrize("seconds", [0.7, 10.0, 1000.0, None])
def test_windows_by_time(spark, huge, seconds):
    rows, ticks = made(1, 300, 100)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    at = spark.createDataFrame(ticks, "log_id string, tick_no long, asof_seconds double")
    for empty in (True, False):
        got = {x["tick_no"]: x for x in panes.aggregate_time(df, at, seconds, aggregates(), huge, empty).collect()}
        count = 0
        for log, no, t in ticks:
            low = -math.inf if seconds is None or t - seconds < 0 else t - seconds
            inside = [x for x in rows if x[0] == log and x[3] is not None and low <= x[3] <= t]
            assert (no in got) == (empty or bool(inside))
            count += len(inside) > 1
            assert no not in got or (got[no]["log_id"] == log and same(got[no], wanted(inside))), (log, no, t)
        assert count > 5
    remove_staged(spark)


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_windows_by_frames(spark, n):
    rows, ticks = made(2, 200, 60)
    rows = [x for x in rows if x[3] is not None and not math.isnan(x[3])]
    df, at = spark.createDataFrame(rows, ROWS), spark.createDataFrame(ticks, "log_id string, tick_no long, asof_seconds double")
    got = {x["tick_no"]: x for x in Seen(at, Every(n, "frame")).aggregate(df, aggregates(), huge=n == 7, empty=True).collect()}
    for log, no, t in ticks:
        inside = sorted((x for x in rows if x[0] == log and x[3] <= t), key=lambda x: (x[3], x[2]))[-n:]
        assert got[no]["asof_seconds"] == t and same(got[no], wanted(inside))


def test_gate_and_task_of_mergeable_aggregates(spark):
    rows, ticks = made(3, 200, 50)
    df, at = spark.createDataFrame(rows, ROWS), spark.createDataFrame([(a or "a", b, c) for a, b, c in ticks], "log_id string, tick_no long, asof_seconds double")
    few = panes.Condition({"n": panes.count(), "high": panes.high(F.col("v"))}, F.coalesce((F.col("n") >= 3) & (F.col("high") > 3), F.lit(False)))
    plain = F.coalesce((F.count("*") >= 3) & (F.max("v") > 3), F.lit(False))
    got, want = (sorted(map(tuple, gates.sql_gate(at, df, x, 6.0).collect())) for x in (few, plain))
    assert got == want and len({x[3] for x in want}) == 2
    got, want = (tasks.topic_sql_task(at, df, x, 6.0).collect() for x in ({"n": panes.count()}, [F.count("*").alias("n")]))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    with pytest.raises(Exception, match="NULL"):
        gates.sql_gate(at, df.limit(0), panes.Condition({"high": panes.high(F.col("v"))}, F.col("high") > 3), 6.0).collect()


def test_rows_are_not_copied_to_overlapping_windows(spark):
    """20,000 rows, windows of 1,000 s, a tick a second: copies would be 15 million rows."""
    df = spark.range(20_000).select(F.lit("a").alias("log_id"), F.col("id").alias("seq"), F.col("id").cast("double").alias("timestamp_seconds"), F.col("id").alias("v"))
    at = spark.range(20_000).select(F.lit("a").alias("log_id"), F.col("id").alias("tick_no"), F.col("id").cast("double").alias("asof_seconds"))
    made = panes.aggregate_time(df, at, 1000.0, {"n": panes.count(), "high": panes.high(F.col("v"))})
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.filter(F.col("n") == 1001).count() == 19_000 and made.filter(F.col("high") != F.col("tick_no")).isEmpty()


def test_windows_too_short_for_doubles_are_refused(spark):
    df = spark.createDataFrame([("a", "x", 0, 1.7e9, 1.0, "y")], ROWS)
    with pytest.raises(ValueError):
        panes.aggregate_time(df, df.selectExpr("log_id", "seq AS tick_no", "timestamp_seconds AS asof_seconds"), 1e-7, aggregates())
