"""What a stream's groups hold, and files of a clustered table's write."""

import weakref

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fleetlog.operators.ticks import greedy
from fleetlog.sources import clustered
from fleetlog.streaming import live


def test_frames_of_a_group_are_not_held():
    r, seen = np.random.default_rng(3), []

    def frames():
        for n in (50, 1, 0, 200):
            assert all(x() is None for x in seen)
            pdf = pd.DataFrame({"timestamp_seconds": r.integers(0, 90, n) / 2, "seq": r.permutation(n), "message": [{"v": i} for i in range(n)]})
            seen.append(weakref.ref(pdf))
            whole.append(pdf.copy())
            yield pdf
            del pdf

    for packed in (None, []):
        whole = []
        t, order, sizes = live.sorted_times(frames(), packed)
        rows = pd.concat(whole, ignore_index=True)
        want = rows.sort_values(["timestamp_seconds", "seq"], kind="stable")
        assert t.tolist() == want["timestamp_seconds"].tolist() and sizes == [50, 1, 0, 200]
        assert rows["seq"].to_numpy()[order].tolist() == want["seq"].tolist()
    assert len(packed) == 4


def test_a_throttled_topic_of_many_frames(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(300).select(
            F.lit("a").alias("log_id"), (F.col("id") % 2).cast("string").alias("topic"), F.col("id").alias("seq"), (F.col("id") * 37 % 101 / 2).alias("timestamp_seconds"), F.struct(F.col("id").alias("v")).alias("message")
        )
        rows.repartition(1).write.parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        live.throttle_stream(source, 4000).writeStream.format("memory").queryName("packed").trigger(availableNow=True).start().awaitTermination()
        got = sorted((r["topic"], r["seq"], r["message"]["v"]) for r in spark.table("packed").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pdf, want = rows.drop("message").toPandas().sort_values(["timestamp_seconds", "seq"]), []
    for topic, own in pdf.groupby("topic"):
        want += [(topic, s, s) for s in own["seq"].iloc[greedy(own["timestamp_seconds"].to_numpy(), 4.0)]]
    assert got == sorted(want)


def test_many_files_are_written_by_few_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(clustered, "MOST_TASKS", 3)
    rows = spark.range(1000).select(
        F.lit("a").alias("log_id"), F.lit("x").alias("topic"), F.col("id").alias("seq"), F.col("id").cast("double").alias("timestamp_seconds"), F.struct(F.col("id").alias("v")).alias("message")
    )
    table = clustered.MessageTable(spark, str(tmp_path))
    table.write(rows, file_rows=20)
    index = table.index().collect()
    assert len(index) >= 50 and max(r["rows"] for r in index) <= 20 and sum(r["rows"] for r in index) == 1000
    assert len({r["path"].rpartition("/")[2].split("-")[1] for r in index}) <= 4  # a task's number
    assert table.files(lo=100.0, hi=110.0).count() <= 2
    assert table.messages(100.0, 110.0).count() == 11
