"""Operators that cut one huge log into ranges, against the same without."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlog.operators import lookback, tasks

ROW = "log_id string, topic string, timestamp_seconds double, seq long, message struct<value: double>"


@pytest.fixture(scope="module")
def logs(spark):
    r = random.Random(4)
    rows = [(k, r.choice("xy"), float(r.randint(10, 60) // 3), i, (None if r.random() < 0.2 else r.uniform(-5, 5),)) for k in "ab" for i in range(200)]
    rows += [("c", "x", 5.0, i, (None,)) for i in range(3)]
    times = [(k, i, t) for k in "abc" for i, t in enumerate([0.0, 4.0, 5.0, 5.0, 11.5, 16.0, 99.0])]
    df = spark.createDataFrame(rows, ROW)
    return rows, df, spark.createDataFrame(times, "log_id string, tick_no long, asof_seconds double")


def test_asof_all_in_ranges(logs):
    rows, df, ticks = logs
    got = lookback.asof_all(df, ticks, F.col("message.value"), huge=True).collect()
    assert len(got) == ticks.count()
    for x in got:
        seen = [v for k, _, t, _, (v,) in rows if k == x["log_id"] and t <= x["asof_seconds"] and v is not None]
        assert (x["n"], x["high"]) == (len(seen), max(seen, default=None))
        assert x["total"] == (pytest.approx(sum(seen)) if seen else None)


def test_tasks_pass_huge_on(logs):
    _, df, ticks = logs
    ticks = ticks.filter("log_id < 'c'")
    by = lambda made: sorted(map(repr, made.collect()))
    assert by(tasks.frame_manifest(df, ticks, 4, huge=True)) == by(tasks.frame_manifest(df, ticks, 4))
    filled = lambda huge: tasks.write_topics_task(ticks, df, ["x", "y"], 6.0, filled=True, huge=huge)
    assert by(filled(True)) == by(filled(False))
