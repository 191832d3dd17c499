"""Bounded live tables and pipelines on streams, against plain Python, over many micro-batches."""

import glob
import os
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from fleetlog.operators import panes
from fleetlog.operators.catalog import MissingTopicError
from fleetlog.plans.pipeline import Every, Pipeline
from fleetlog.streaming import bounded, live, pipelines

MESSAGE = "log_id string, topic string, seq long, timestamp_seconds double, message struct<value: double, text: string>"


def feed(spark, path, batches, each=1):
    """A stream that gives one batch a trigger."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, MESSAGE).coalesce(1).write.mode("append").parquet(path)
        for f in glob.glob(f"{path}/part-*.parquet"):
            if "/part-" in f and not os.path.basename(f).startswith("part-x"):
                at = f"{path}/part-x{len(glob.glob(f'{path}/part-x*')):05d}.parquet"
                os.rename(f, at)
                os.utime(at, (1_700_000_000 + len(glob.glob(f"{path}/part-x*")),) * 2)
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", each).parquet(path)


def batches(seed, n, size, logs=("a", "b", None), topics="xy"):
    r = random.Random(seed)
    made, seq = [], 0
    for i in range(n):
        rows = []
        for _ in range(r.randint(1, size)):
            seq += 1
            rows.append((r.choice(logs), r.choice(topics), seq, i * 10 + r.random() * 10, (r.random(), "z" * r.choice((1, 5, 40)))))
        made.append(rows)
    return made


def newest(made, budget):
    """Each topic's newest whole lines within budget, by arrival."""
    kept, used, ended = set(), {}, set()
    for rows in reversed(made):
        for x in sorted(rows, key=lambda x: (x[3], x[2]), reverse=True):
            k, size = x[:2], len(x[4][1]) + 1
            if k not in ended and used.get(k, 0) + size <= budget:
                used[k] = used.get(k, 0) + size
                kept.add(x[2])
            else:
                ended.add(k)
    return kept


def on_disk(folder):
    return sum(os.path.getsize(f) for f in glob.glob(f"{folder}/data/**/*.parquet", recursive=True))


def test_a_bounded_table_keeps_the_newest_lines(spark, tmp_path):
    made, folder = batches(1, 14, 60), str(tmp_path / "t")
    sizes, rows = [], []
    for i in range(0, 14, 2):
        stream = feed(spark, str(tmp_path / "in"), made[i : i + 2])
        bounded.ingest_bounded(stream, folder, str(tmp_path / "c"), budget=300, line=F.col("message.text"), buckets=2).awaitTermination()
        got = sorted(r["seq"] for r in bounded.bounded_snapshot(spark, folder).collect())
        assert got == sorted(newest(made[: i + 2], 300)), i
        sizes.append(on_disk(folder))
        rows.append(sum(s["rows"] for s in bounded.manifest(spark, folder)["segments"]))
    assert bounded.bounded_snapshot(spark, folder).columns == ["log_id", "topic", "seq", "timestamp_seconds", "message"]
    assert any(s["base"] for s in bounded.manifest(spark, folder)["segments"])
    assert rows[-1] < sum(map(len, made)) * 0.9 and sizes[-1] < 3 * max(sizes[1:4])
    assert len(bounded.manifests(spark, folder)) == 2
    text = open(f"{folder}/metadata.yaml").read()
    assert "magic: FLEETLOG_SINK" in text and "buffer_size_bytes: 300" in text


def test_bounded_tables_repeat_a_batch_once(spark, tmp_path):
    made, folder = batches(2, 3, 30), str(tmp_path / "t")
    frames = [spark.createDataFrame(rows, MESSAGE) for rows in made]
    for number in (0, 1, 1, 2):
        bounded.add_batch(frames[number], number, folder, 200, F.col("message.text"), 2, False)
    # The manifest of the last batch was lost, so the batch comes again.
    fs, at = live.file_system(spark, f"{folder}/manifests/{2:012d}.json")
    fs.delete(at, False)
    bounded.add_batch(frames[2], 2, folder, 200, F.col("message.text"), 2, True)
    assert sorted(r["seq"] for r in bounded.bounded_snapshot(spark, folder, huge=True).collect()) == sorted(newest(made, 200))


def test_a_snapshot_stays_whole_while_a_batch_is_added(spark, tmp_path):
    made, folder = batches(3, 3, 40), str(tmp_path / "t")
    for number in range(2):
        bounded.add_batch(spark.createDataFrame(made[number], MESSAGE), number, folder, 100, F.col("message.text"), 1, False)
    before = bounded.bounded_snapshot(spark, folder)
    bounded.add_batch(spark.createDataFrame(made[2], MESSAGE), 2, folder, 100, F.col("message.text"), 1, False)
    assert sorted(r["seq"] for r in before.collect()) == sorted(newest(made[:2], 100))


def test_unbounded_tables_and_topics_that_are_not_there(spark, tmp_path):
    made = batches(4, 3, 20)
    stream, where = feed(spark, str(tmp_path / "in"), made), (str(tmp_path / "t"), str(tmp_path / "c"))
    with pytest.raises(MissingTopicError, match="nope"):
        bounded.ingest_bounded(stream, *where, topics=["x", "nope"], available=["x", "y"])
    bounded.ingest_bounded(stream, *where, topics=["x"], available=["x", "y"], budget=None).awaitTermination()
    assert sorted(r["seq"] for r in bounded.bounded_snapshot(spark, where[0]).collect()) == sorted(x[2] for rows in made for x in rows if x[1] == "x")
    with pytest.raises(ValueError):
        bounded.bounded_snapshot(spark, str(tmp_path / "none"))
    q = bounded.ingest_bounded(stream, *where, name="once", trigger={"processingTime": "1 hour"}, overwrite=True)
    with pytest.raises(live.AlreadySubscribedError):
        bounded.ingest_bounded(stream, *where, name="once")
    live.pause(q)


def counted(t, seen):
    return seen.aggregate(None, {"n": panes.count(), "last": panes.newest(F.col("seq"))})


def fails_at(log, asof):
    return lambda t: t.withColumn("error", F.when(F.col("log_id").eqNullSafe(F.lit(log)) & (F.col("asof_seconds") >= asof), "no"))


def simulated(made, topic, when, seconds, failing=None):
    """(log, tick number, asof, rows seen, last seq) one tick at a time, and logs' status."""
    seen, state, out = [], {}, []
    for rows in made:
        seen += rows
        for x in sorted(rows, key=lambda x: (x[3], x[2])):
            if x[1] != topic:
                continue
            log = state.setdefault(x[0], {"count": 0, "ticks": 0, "last": None, "stopped": False})
            due = log["count"] % when.value == 0 if when.unit == "frame" else log["last"] is None or x[3] - log["last"] >= when.seconds()
            log["count"] += 1
            if due and not log["stopped"]:
                inside = sorted((y for y in seen if y[0] == x[0] and max(x[3] - seconds, 0) <= y[3] <= x[3]), key=lambda y: (y[3], y[2]))
                failed = failing is not None and failing[0] == x[0] and x[3] >= failing[1]
                out.append((x[0], log["ticks"], round(x[3], 6), len(inside), inside[-1][2], "failed" if failed else "executed"))
                log["ticks"], log["last"], log["stopped"] = log["ticks"] + 1, x[3], failed
    return sorted(out, key=repr)


@pytest.mark.parametrize("when,failing", [(Every(5, "frame"), None), (Every(7, "second"), ("a", 25.0)), (Every(3, "frame"), (None, 30.0))])
def test_live_pipelines_go_on_where_they_were(spark, tmp_path, when, failing):
    made, folder = batches(5, 6, 40), str(tmp_path / "out")
    tasks = {"counted": counted} | ({"fails": fails_at(*failing)} if failing else {})
    p = Pipeline("p", "x", when, Every(12, "second"), {}, tasks)
    kept = []
    for i in range(0, 6, 2):  # stopped and started again between
        stream = feed(spark, str(tmp_path / "in"), made[i : i + 2])
        pipelines.run_live(stream, p, folder, str(tmp_path / "c")).awaitTermination()
        kept.append(spark.read.parquet(glob.glob(f"{folder}/state/batch={i + 1}/rows")[0]).count())
    log = {(r["log_id"], r["tick_no"]): r["status"] for r in spark.read.parquet(f"{folder}/run_log").collect()}
    got = [(r["log_id"], r["tick_no"], round(r["asof_seconds"], 6), r["n"], r["last"], log[r["log_id"], r["tick_no"]]) for r in spark.read.parquet(f"{folder}/counted").collect()]
    want = simulated(made, "x", when, 12, failing)
    assert sorted(got, key=repr) == want and len(want) > 8 and len(log) == len(want)
    assert sum(x[5] == "failed" for x in want) == (failing is not None)
    assert max(kept) <= 3 * max(map(len, made)) and len(glob.glob(f"{folder}/state/*")) == 2


def test_a_live_pipeline_ends_at_its_failure(spark, tmp_path):
    made = [[("a", "x", i * 4 + j, float(i * 4 + j), (0.0, "")) for j in range(4)] for i in range(3)]
    stream = feed(spark, str(tmp_path / "in"), made)
    p = Pipeline("p", "x", Every(1, "frame"), Every(2, "second"), {}, {"fails": fails_at("a", 5.0), "later": counted})
    with pytest.raises(StreamingQueryException, match="p failed in a at 5.0: no"):
        pipelines.run_live(stream, p, str(tmp_path / "o"), str(tmp_path / "c"), end_on_failure=True).awaitTermination()
    assert {(r["asof_seconds"], r["status"]) for r in spark.read.parquet(str(tmp_path / "o/run_log")).collect()} == {(float(i), "failed" if i == 5 else "executed") for i in range(6)}
    assert {r["asof_seconds"] for r in spark.read.parquet(str(tmp_path / "o/later")).collect()} == {float(i) for i in range(5)}
    allowed = Pipeline("p", "x", Every(1, "frame"), Every(2, "second"), {}, {"fails": fails_at("a", 5.0)}, allow_failure=True)
    pipelines.run_live(stream, allowed, str(tmp_path / "o2"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o2/run_log")).count() == 12


def test_frames_that_a_later_tick_needs_are_kept(spark, tmp_path):
    made, folder = batches(6, 5, 25, logs=("a",)), str(tmp_path / "out")
    frames = lambda t, seen: seen().groupBy("log_id", "tick_no", "asof_seconds").agg(F.sort_array(F.collect_list("seq")).alias("seen"))
    p = Pipeline("p", "x", Every(4, "frame"), Every(9, "frame"), {}, {"frames": frames})
    pipelines.run_live(feed(spark, str(tmp_path / "in"), made), p, folder, str(tmp_path / "c")).awaitTermination()
    got, seen, count = {round(r["asof_seconds"], 6): r["seen"] for r in spark.read.parquet(f"{folder}/frames").collect()}, [], 0
    for rows in made:
        seen += rows
        for x in sorted((x for x in rows if x[1] == "x"), key=lambda x: (x[3], x[2])):
            if count % 4 == 0:
                assert got[round(x[3], 6)] == sorted(y[2] for y in sorted((y for y in seen if y[3] <= x[3]), key=lambda y: (y[3], y[2]))[-9:])
            count += 1
    assert len(got) > 3


def test_ticks_of_other_topics_and_of_stopped_logs_run_nothing(spark, tmp_path):
    made = [[("a", t, i * 10 + j, float(i * 10 + j), (0.0, "")) for j, t in enumerate("xyxy")] for i in range(2)]
    p = Pipeline("p", "x", Every(1, "frame"), Every(2, "second"), {}, {"fails": fails_at("a", 2.0)})
    ticks = live.stream_ticks(feed(spark, str(tmp_path / "in"), made), p.when)
    live.stream_run(ticks, p, lambda: None, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    assert sorted((r["asof_seconds"], r["status"]) for r in spark.read.parquet(str(tmp_path / "o/run_log")).collect()) == [(0.0, "executed"), (2.0, "failed")]
