"""The log folder as a data source: splits, filters, streams."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from fleetlog.sources import files, topicfolder
from fleetlog.sources.topicfolder import Bounds, Part, RotatedFileError, TopicFolderReader, TopicFolderStreamReader, lines_of, parts_of
from fleetlog.streaming import bounded


def put(folder, log, topic, name, lines, mode="w", end="\n"):
    at = folder / log / "data" / topic
    at.mkdir(parents=True, exist_ok=True)
    with open(at / name, mode) as f:
        f.write("\n".join(lines) + end)


def line(topic, t, **message):
    return json.dumps({"timestamp_seconds": t, topic: message})


@pytest.fixture
def folder(tmp_path):
    r = random.Random(3)
    for log in ("a", "b"):
        for topic in ("x", "y"):
            put(tmp_path, log, topic, f"{topic}.overflow.jsonl", [line(topic, float(i), v=i, s="é " * r.randrange(60)) for i in range(200)])
            put(tmp_path, log, topic, f"{topic}.jsonl", [line(topic, float(200 + i), v=200 + i) for i in range(200)], end="")
    put(tmp_path, "c", "x", "x.jsonl", [])
    (tmp_path / "notes.txt").write_text("{}\n")
    for name in (".x.jsonl.crc", ".x.jsonl", "_x.jsonl", "x.jsonl.gz"):
        put(tmp_path, "a", "x", name, [line("x", 1.0, v=1)])
    return tmp_path


def read(spark, folder, **options):
    topicfolder.register(spark)
    return spark.read.format("topic_folder").options(**options).load(str(folder))


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 1000])
def test_lines_come_once_for_all_splits(tmp_path, size, monkeypatch):
    r = random.Random(size)
    for block in (1, 3, 1 << 20):
        monkeypatch.setattr(topicfolder, "BLOCK", block)
        for ending in ("", "\n", '{"a": 1}', '{"a": ', "1"):
            whole = "".join(r.choice(("\n", "{}\n", '{"b": "' + "z" * r.randrange(12) + '"}\n', "?\n")) for _ in range(r.randrange(8))) + ending
            (tmp_path / "f").write_text(whole)
            with open(tmp_path / "f", "rb") as f:
                got = [x for p in parts_of("f", 0, len(whole), size, True) for x in lines_of(f, p)]
            want, at = [], 0
            for one in whole.split("\n")[:-1]:
                want.append((at, one.encode()))
                at += len(one) + 1
            want += [(at, ending.encode())] if ending == '{"a": 1}' else []
            assert got == want


def test_batch_reads_all_lines_in_order(spark, folder):
    for size in (3000, 1 << 20):
        rows = read(spark, folder, part_bytes=size).orderBy(*topicfolder.in_order()).collect()
        assert [(r["log_id"], r["topic"], r["timestamp_seconds"], json.loads(r["message"])["v"]) for r in rows] == [(log, topic, float(i), i) for log in "ab" for topic in "xy" for i in range(400)]
    got = topicfolder.typed(read(spark, folder), {"x": "v long, s string"})["x"].filter("log_id = 'a'").agg(F.sum("message.v"), F.count("message.s")).first()
    assert tuple(got) == (sum(range(400)), 200)


def test_odd_lines(spark, tmp_path):
    lines = ["", "  ", "no json", "[1]", '{"timestamp_seconds": null, "x": {"v": 1}}', '{"x": 5}', '{"timestamp_seconds": true}', '{"timestamp_seconds": 1, "x": {"v": "\\ud800"}}', "[" * 100_000, line("x", 2, v=1)]
    put(tmp_path, "a", "x", "x.jsonl", lines)
    rows = read(spark, tmp_path, part_bytes=25_000).orderBy("seq").collect()
    assert [r["timestamp_seconds"] for r in rows] == [None, None, None, None, None, 1.0, None, 2.0]
    assert [r["message"] for r in rows] == [None, None, '{"v": 1}', "5", None, '{"v": "\\ud800"}', None, '{"v": 1}']
    empty = tmp_path / "empty"
    empty.mkdir()
    assert read(spark, empty).count() == 0


def reader_of(folder, filters=(), **options):
    made = TopicFolderReader({"path": str(folder), **options})
    assert list(made.pushFilters(list(filters))) == list(filters)  # Spark applies them again
    return made


def test_filters_open_fewer_parts(spark, folder):
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan

    index = f"{folder}-index"
    topicfolder.write_index(spark, str(folder), index, 3000)
    every = reader_of(folder, part_bytes=3000).partitions()
    assert len({p.path for p in reader_of(folder, [In(("topic",), ("x", "q")), EqualTo(("log_id",), "a")]).partitions()}) == 2
    times = [GreaterThanOrEqual(("timestamp_seconds",), 50.0), LessThan(("timestamp_seconds",), 60.0)]
    few = reader_of(folder, times, part_bytes=3000, index=index).partitions()
    assert len(few) < len(every) / 2 and len(reader_of(folder, times, part_bytes=3000).partitions()) == len(every)
    for lo, hi, topic in ((50.0, 60.0, "x"), (190.0, 210.0, "y"), (399.0, 1e9, "x"), (-5.0, 0.0, "y"), (1e6, 2e6, "x")):
        made = read(spark, folder, part_bytes=3000, index=index).filter((F.col("topic") == topic) & F.col("timestamp_seconds").between(lo, hi))
        assert sorted(r[0] for r in made.select("timestamp_seconds").collect()) == sorted(float(t) for t in range(400) if lo <= t <= hi for _ in "ab")
    # What was added since is in parts that the index can't rule out.
    put(folder, "a", "x", "x.jsonl", ["", line("x", 55.5, v=1)], "a")
    window = read(spark, folder, part_bytes=3000, index=index).filter("topic = 'x' AND timestamp_seconds > 50 AND timestamp_seconds < 60")
    assert window.filter("timestamp_seconds = 55.5").count() == 1 and window.count() == 19
    assert [p.path for p in reader_of(folder, [EqualTo(("topic",), "none"), GreaterThan(("seq",), 1)]).partitions()] == [""]
    with pytest.raises(ValueError, match="another size"):
        reader_of(folder, times, part_bytes=4000, index=index).partitions()


def test_a_stream_reads_what_a_batch_reads_and_repeats_nothing(spark, folder):
    topicfolder.register(spark)
    out, checkpoint = f"{folder}-out", f"{folder}-checkpoint"

    def run():
        made = spark.readStream.format("topic_folder").option("part_bytes", 5000).load(str(folder))
        made.drop("part").writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out, "parquet").awaitTermination()
        return sorted(map(tuple, spark.read.schema(made.drop("part").schema).parquet(out).collect()))

    batch = lambda: sorted(map(tuple, read(spark, folder, part_bytes=4000).drop("part").collect()))
    first = run()
    assert len(first) == len(batch()) - 4  # last lines without a line break are not done yet
    assert run() == first
    half = line("x", 900.0, v=900)
    for log in "ab":
        put(folder, log, "x", "x.jsonl", ["", half[:20]], "a", end="")
        put(folder, log, "y", "y.jsonl", [""], "a")
    assert len(run()) == len(first) + 4
    put(folder, "a", "x", "x.jsonl", [half[20:]], "a")
    put(folder, "b", "x", "x.jsonl", [half[20:]], "a")
    put(folder, "d", "z", "z.jsonl", [line("z", 1.0, v=1)])
    assert run() == batch() and len(batch()) == 1600 + 3


def test_rotated_files_are_an_error(folder):
    stream = TopicFolderStreamReader({"path": str(folder)})
    before = stream.latestOffset()
    assert json.loads(json.dumps(before)) == before and stream.partitions(before, before) == []
    path = next(p for p in before if p.endswith("/a/data/x/x.jsonl"))
    os.truncate(path, 10)
    with pytest.raises(RotatedFileError, match="x.jsonl"):
        stream.partitions(before, stream.latestOffset())
    os.remove(path)
    assert stream.partitions(before, stream.latestOffset()) == []


def test_parts_are_cut_at_multiples():
    assert parts_of("f", 5, 25, 10, True) == [Part("f", 5, 10), Part("f", 10, 20), Part("f", 20, 25, True)]
    assert parts_of("f", 0, 0, 10, True) == [] and Bounds().lo is None


@pytest.mark.parametrize("huge", [False, True])
def test_numbers_of_lines(spark, folder, huge):
    rows = topicfolder.numbered(read(spark, folder, part_bytes=20_000), huge).collect()
    assert sorted((r["log_id"], r["topic"], r["seq"], r["timestamp_seconds"]) for r in rows) == [(log, topic, i, float(i)) for log in "ab" for topic in "xy" for i in range(400)]
    made = files.read_buffer(spark, str(folder / "b"), {"x": "v: long"})
    got = files.buffer_messages(made.filter("timestamp_seconds <> 1.0"), huge).orderBy("seq").collect()
    assert [(r["seq"], r["message"]["v"]) for r in got] == [(i + 1, v) for i, v in enumerate([0, *range(2, 400)])]


def test_a_folder_feeds_a_bounded_table(spark, folder, tmp_path_factory):
    topicfolder.register(spark)
    to = tmp_path_factory.mktemp("live")
    made = spark.readStream.format("topic_folder").load(str(folder)).drop("path", "part")
    bounded.ingest_bounded(made, f"{to}/table", f"{to}/checkpoint", ["x"], budget=40 * 50, line=F.lpad(F.lit("x"), 49, " "), name="folder").awaitTermination()
    got = bounded.bounded_snapshot(spark, f"{to}/table").groupBy("log_id", "topic").agg(F.min("timestamp_seconds"), F.max("timestamp_seconds"), F.count("*")).collect()
    assert sorted(map(tuple, got)) == [(log, "x", 359.0, 398.0, 40) for log in "ab"]  # the last line waits for its break
