"""Lookbacks stored as rows and ticks, against a copy of each row for each tick that sees it."""

import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fleetlog import queries
from fleetlog.operators import lookback, tasks
from fleetlog.operators.catalog import leaves

ROW = "log_id string, topic string, timestamp_seconds double, seq long, message struct<value: double>"
PLACE = ("watch", "topics", "here", "robot")


def rows(df):
    return sorted(map(repr, df.collect()))


def held(path: str) -> int:
    return sum(pq.ParquetFile(p).metadata.num_rows for p in Path(path).rglob("*.parquet"))


@pytest.fixture(scope="module")
def logs(spark):
    r = random.Random(7)
    made = [(r.choice(("a", "a", None)), r.choice("xyz"), r.choice((r.uniform(-50, 400000), float(r.randint(0, 300) * 1000))), i, (r.choice((None, 1.5, r.uniform(-5, 5))),)) for i in range(300)]
    made += [("b", "x", 5.0, i, (None,)) for i in range(3)] * 2 + [("a", "x", None, 900, (1.0,)), ("c", "x", 1.0, 901, (1.0,))]
    times = [(k, i, t) for k in ("a", "b", None) for i, t in enumerate([-3.0, 0.0, 4.0, 5.0, 5.0, 86400.0, 90000.0, 300000.0, 9e9, None])]
    return spark.createDataFrame(made, ROW), spark.createDataFrame(times, "log_id string, tick_no long, asof_seconds double")


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
@pytest.mark.parametrize("seconds", [3.5, 3600.0, 200000.0])
def test_windows_are_read_as_each_tick_sees_them(spark, logs, tmp_path, seconds, fmt):
    df, ticks = logs
    relation = tasks.topics_relation(df, ["x", "y"])
    relation = relation.select(*leaves(relation.schema)) if fmt == "csv" else relation
    tasks.write_windows(relation, ticks, seconds, f"{tmp_path}/w", PLACE, fmt)
    read = lambda **more: tasks.read_windows(spark, f"{tmp_path}/w", relation.schema, seconds, fmt, **more)
    want = lookback.lookback_time(relation, ticks, seconds)
    assert rows(read()) == rows(want) and read().columns == want.columns and want.count() > 10
    for lo, hi in ((4.0, 5.0), (None, 4.0), (90000.0, None)):
        cut = want if lo is None else want.filter(F.col("asof_seconds") >= lo)
        assert rows(read(lo=lo, hi=hi)) == rows(cut if hi is None else cut.filter(F.col("asof_seconds") <= hi))


def test_stored_rows_do_not_grow_with_the_overlap_of_lookbacks(spark, tmp_path):
    df = spark.range(400).selectExpr("'a' AS log_id", "'x' AS topic", "CAST(id AS DOUBLE) AS timestamp_seconds", "id AS seq", "struct(CAST(id AS DOUBLE) AS value) AS message")
    ticks = spark.range(100).selectExpr("'a' AS log_id", "id AS tick_no", "300.0D + id AS asof_seconds")
    tasks.write_windows(tasks.topics_relation(df, ["x"]), ticks, 200.0, f"{tmp_path}/w", PLACE)
    assert held(f"{tmp_path}/w/rows") == 300 and held(f"{tmp_path}/w/ticks") == 100  # the rows of 100 to 399 seconds
    assert tasks.read_windows(spark, f"{tmp_path}/w", tasks.topics_relation(df, ["x"]).schema, 200.0).count() == 100 * 201
    with pytest.raises(Exception, match="already exists"):
        tasks.write_windows(tasks.topics_relation(df, ["x"]), ticks, 200.0, f"{tmp_path}/w", PLACE)


def test_the_query_stores_a_row_once(spark, monkeypatch, tmp_path):
    made, new = [], queries.new_folder
    monkeypatch.setattr(queries, "new_folder", lambda s, name: made.append(new(s, name)) or made[-1])
    events = spark.range(4000).selectExpr("id AS event_id", "CAST(timestamp_seconds(1704067200 + id) AS timestamp_ntz) AS ts", "id % 9 AS user_id", "if(id % 2 = 0, 'click', 'error') AS event_type", "id / 8 AS value", "'{}' AS props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    found = queries.QUERIES["task_write_topics"](spark, str(tmp_path))
    path = next(p for p in made if "artifacts" in p).removeprefix("file:")
    assert held(path) <= 4000 + 40
    ticks = [100 * i for i in range(40)]
    want = sorted((i, s, s / 8 if s % 2 == 0 else None, s / 8 if s % 2 else None) for i, t in enumerate(ticks) for s in range(max(0, t - 3600), t + 1))
    assert sorted(map(tuple, found.collect()), key=lambda x: x[:2]) == want
