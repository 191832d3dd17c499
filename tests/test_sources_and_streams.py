"""File sources, pipelines and streams: options, failures, repeats."""

import pytest
from pyspark.sql import functions as F

from fleetlog import storage
from fleetlog.operators import analysis, catalog, definitions, gates, lookback, relation
from fleetlog.operators.rowindex import with_previous, with_running_sum
from fleetlog.plans.pipeline import Every, Pipeline, SpecError, pipeline_from_config
from fleetlog.sources import files
from fleetlog.streaming import live

MESSAGE = "log_id string, topic string, seq long, timestamp_seconds double, message struct<value: double>"


def messages(spark, n=40, topic="x", log="a"):
    return spark.createDataFrame([(log, topic, i, float(i), (float(i % 7),)) for i in range(n)], MESSAGE)


def test_csv_options(spark, tmp_path):
    for name, text in {
        "north/r1/day_a.csv": "t,v\n1000,1\n2000,2\n", "north/r2/day_b.csv": "t,v\n3000,3\n", "south/r1/skip_c.csv": "t,v\n9000,9\n", "south/r1/night_d.csv": "t,v\n4000,4\n", "south/r1/other.bag": "#ROSBAG V2.0\n",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    made = files.read_csv(spark, str(tmp_path), "t long, v int", ["site", "robot"], str(tmp_path), ["skip_"], True, timestamp="t", fmt="milliseconds")
    assert sorted(map(tuple, made.select("site", "robot", "v", "timestamp_seconds").collect())) == [("north", "r1", 1, 1.0), ("north", "r1", 2, 2.0), ("north", "r2", 3, 3.0), ("south", "r1", 4, 4.0)]
    named = files.read_csv(spark, str(tmp_path), "t long, v int", ["kind", "letter"], None, ["skip_"], True, "filename")
    assert sorted(map(tuple, named.select("kind", "letter", "v").distinct().collect())) == [("day", "a", 1), ("day", "a", 2), ("day", "b", 3), ("night", "d", 4)]
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "south" / "r1"), "t long, v int", ignore=["skip_", "night", "other"], exclude_invalid=True)


def test_formats_of_long_lines_and_other_separators(spark, tmp_path):
    wide = '{"a": "' + "x" * 9000 + '"}\n{"a": "y"}\n'
    made = {"wide.jsonl": wide, "tabs.txt": "a\tb\n1\t2\n3\t4\n", "semicolons.txt": "a;b\n1;2\n3;4\n", "pretty.json": '{"a":\n' + " " * 9000 + "1}"}
    for name, text in made.items():
        (tmp_path / name).write_text(text)
    got = {r["path"].rpartition("/")[2]: r["format"] for r in files.file_inventory(spark, str(tmp_path)).collect()}
    assert got == {"wide.jsonl": "table.json", "tabs.txt": "table.csv", "semicolons.txt": "table.csv", "pretty.json": "table.json"}


def bag(folder, storage_id, names, present):
    folder.mkdir(parents=True)
    listed = "".join(f"    - path: {n}\n" for n in names)
    (folder / "metadata.yaml").write_text(f"rosbag2_bagfile_information:\n  version: 5\n  storage_identifier: {storage_id}\n  message_count: 3\n  files:\n{listed}")
    for n, head in present.items():
        (folder / n).write_bytes(head)


def test_directories_and_manifests(spark, tmp_path):
    lite, mcap = b"SQLite format 3\0", b"\x89MCAP0\r\n"
    bag(tmp_path / "db3", "sqlite3", ["p0.db3", "p1.db3.zstd"], {"p0.db3": lite, "p1.db3.zstd": b"zz"})
    bag(tmp_path / "mcap", "mcap", ["p.mcap"], {"p.mcap": mcap})
    bag(tmp_path / "gap", "mcap", ["p.mcap", "gone.mcap"], {"p.mcap": mcap})
    bag(tmp_path / "wrong", "mcap", ["p.mcap"], {"p.mcap": lite})
    (tmp_path / "sink").mkdir()
    (tmp_path / "sink" / "metadata.yaml").write_text("magic: TOPIC_SINK\n")
    for folder, name, text in (("rows", "a.json", '{"a": 1}\n'), ("rows", "b.json", "[1]"), ("mixed", "a.json", '{"a": 1}\n'), ("mixed", "b.bag", "#ROSBAG V2.0"), ("sheets", "a.csv", "a,b\n1,2\n")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    manifests = files.bag_manifests(spark, str(tmp_path))
    inventory = files.file_inventory(spark, str(tmp_path))
    got = {r["folder"].rpartition("/")[2]: r["format"] for r in files.directory_formats(inventory, manifests).collect()}
    assert got == {"db3": "ros2.db3", "mcap": "ros2.mcap", "gap": None, "wrong": None, "sink": "topic.buffer", "rows": "table.json", "mixed": None, "sheets": "table.csv"}
    missing = files.missing_files(manifests, inventory.select("path"))
    assert [r["path"].rpartition("/")[2] for r in missing.collect()] == ["gone.mcap"]


def test_files_by_modified_time(spark):
    found = spark.createDataFrame([("a", "x/1.txt", 5, 100.0), ("a", "x/../2.txt", 5, 104.5), ("b", "3.txt", 5, 100.0)], "log_id string, file string, size_bytes long, t double")
    found = found.withColumn("modified", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).drop("t")
    ticks = spark.createDataFrame([("a", 0, 100.0), ("a", 1, 105.0), ("a", 2, 200.0)], "log_id string, tick_no long, asof_seconds double")
    got = files.files_modified(found, ticks, Every(5, "second"), "/to/")
    assert sorted((r["tick_no"], r["destination"]) for r in got.collect()) == [(0, "/to/x/1.txt"), (1, "/to/x/../2.txt"), (1, "/to/x/1.txt")]
    assert files.files_modified(found, ticks, None, "/to").count() == 5
    with pytest.raises(ValueError):
        files.files_modified(found, ticks, Every(5, "frame"), "/to")
    with pytest.raises(Exception, match="leave"):
        files.files_modified(found.withColumn("file", F.lit("x/../../y")), ticks, None, "/to").collect()


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1.0, (2.0, (3.0,)))], "`a.b` double, c struct<`d.e`: double, f: struct<g: double>>")
    assert relation.flatten(df).columns == ["a_b", "c_d_e", "c_f_g"] and tuple(relation.flatten(df).first()) == (1.0, 2.0, 3.0)
    assert relation.leaf_paths(df.schema) == [('"a.b"', "double"), ('"c"."d.e"', "double"), ('"c"."f"."g"', "double")]


def test_ranges_give_what_windows_give(spark):
    rows = [(log, topic, i, float((i * 7) % 50) if log == "a" else float(i // 3), (float(i * i % 11),)) for log in "ab" for topic in "xy" for i in range(120)]
    df, keys, order, v = spark.createDataFrame(rows, MESSAGE).repartition(5), ["log_id", "topic"], ["timestamp_seconds", "seq"], F.col("message.value")
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    for fn in (lambda h: with_previous(df, keys, order, v, "before", h), lambda h: with_running_sum(df, keys, order, v, "sum", h), lambda h: catalog.gaps(df, h), lambda h: catalog.topic_frequency(df, h)):
        assert same(fn(False), fn(True))
    for fn in (lambda h: analysis.sudden_change(df, v, 0.5, h), lambda h: analysis.excursions(df, v, 3.0, h), lambda h: analysis.latency_anomalies(df, 0.5, h), lambda h: live.retain_bytes(df, 900, huge=h)):
        assert same(fn(False), fn(True)) and fn(True).count() > 5


def test_steps_have_lookbacks_of_their_own(spark):
    df = messages(spark)
    count = lambda name: lambda t, seen: seen(df).groupBy(*lookback.TICK).agg(F.count("*").alias(name))
    spec = {
        "name": "p", "cadence": {"topic": "x", "when": {"value": 10, "unit": "frame"}}, "lookback": {"value": 5, "unit": "second"},
        "tasks": ["by_time", {"name": "by_frame", "lookback": {"value": 3, "unit": "frame"}}], "gates": [{"name": "late", "lookback": {"value": 100, "unit": "second"}}],
    }
    known = {"by_time": count("n"), "by_frame": count("n")}
    late = {"late": lambda t, seen: seen(df).groupBy(*lookback.TICK).agg((F.count("*") > 11).alias("passed"))}
    made, _ = pipeline_from_config(spec, late, known).run(df)
    assert {n: sorted((r["tick_no"], r["n"]) for r in d.collect()) for n, d in made.items()} == {"by_time": [(2, 6), (3, 6)], "by_frame": [(2, 3), (3, 3)]}
    everything = Pipeline("q", "x", Every(10, "frame"), None, {}, {"seen": count("n")}).run(df)[0]["seen"]
    assert sorted((r["tick_no"], r["n"]) for r in everything.collect()) == [(0, 1), (1, 11), (2, 21), (3, 31)]
    with pytest.raises(SpecError):
        pipeline_from_config({**spec, "tasks": [{"lookback": {"value": 3, "unit": "frame"}}]}, late, known)


@pytest.mark.parametrize("allow", [False, True])
def test_tasks_stop_where_one_fails(spark, allow):
    df = messages(spark).unionByName(messages(spark, 8, log="b"))
    fails = lambda t: t.withColumn("error", F.when((F.col("log_id") == "a") & (F.col("tick_no") == 2), "no"))
    made, log = Pipeline("p", "x", Every(5, "frame"), None, {}, {"one": lambda t: t, "two": fails, "three": lambda t: t}, allow).run(df)
    ticks = {n: sorted((r["log_id"], r["tick_no"]) for r in d.collect()) for n, d in made.items()}
    b, upto = [("b", 0), ("b", 1)], 8 if allow else 3
    assert ticks["one"] == ticks["two"] == [("a", i) for i in range(upto)] + b
    assert ticks["three"] == [("a", i) for i in range(upto) if i != 2] + b
    status = {(r["log_id"], r["tick_no"]): (r["status"], r["error"]) for r in log.collect()}
    assert status == {k: ("failed", "no") if k == ("a", 2) else ("executed", None) for k in ticks["one"]}


def test_empty_dependencies_resolve(spark):
    text = "pkg/Nothing a\nstd_msgs/Empty b\nGone c\n====\nMSG: pkg/Nothing\n====\nMSG: std_msgs/msg/Empty\n# no fields"
    sections = definitions.definition_sections(definitions.definition_lines(spark.createDataFrame([("1", text)], "text_id string, text string")))
    got = definitions.resolve_types(definitions.definition_fields(sections), sections)
    assert {r["type"]: (r["target"], r["rule"]) for r in got.collect()} == {"pkg/Nothing": ("pkg/Nothing", 1), "std_msgs/Empty": ("std_msgs/msg/Empty", 4), "Gone": (None, None)}


def test_all_labels(spark):
    seen = spark.createDataFrame([(1, "a", 0.9, 1.0), (1, "b", 0.9, 5.0), (2, "b", 0.1, 1.0)], "frame long, label string, score double, closeness double")
    assert {r["frame"]: r["passed"] for r in gates.detection_gate(seen, None, 0.5, 0.5).collect()} == {1: True, 2: False}


def source_folder(spark, tmp_path, *parts):
    for i, df in enumerate(parts):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return lambda: spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_resume_keeps_what_was_and_takes_what_comes(spark, tmp_path):
    whole = messages(spark, 30)
    cut = lambda a, b: whole.filter((F.col("seq") >= a) & (F.col("seq") < b))
    stream = source_folder(spark, tmp_path, cut(0, 10))
    where = (str(tmp_path / "t"), str(tmp_path / "c"))
    q = live.ingest(stream(), *where, name="r")
    q.awaitTermination()
    live.pause(q)
    source_folder(spark, tmp_path, cut(10, 20), cut(20, 30))
    live.resume(stream(), *where, name="r", since=F.col("seq") >= 20).awaitTermination()
    assert sorted(r["seq"] for r in live.snapshot(spark, where[0]).collect()) == [*range(10), *range(20, 30)]
    # A restart without resume goes on in the same run, each message once.
    live.ingest(stream(), *where, name="r").awaitTermination()
    assert len(live.runs(spark, where[0])) == 2


def test_a_repeated_batch_is_there_once(spark, tmp_path):
    df = messages(spark, 30)
    stream = source_folder(spark, tmp_path, df)
    p = Pipeline("p", "x", Every(10, "frame"), Every(3, "second"), {}, {"seen": lambda t, seen: seen(df).groupBy(*lookback.TICK).agg(F.count("*").alias("n"))})
    for _ in range(2):  # the second time from the start, as after a lost commit
        live.stream_run(live.stream_ticks(stream(), p.when), p, lambda: df, str(tmp_path / "out"), str(tmp_path / f"c{_}")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "seen"))
    assert sorted((r["asof_seconds"], r["n"]) for r in got.collect()) == [(0.0, 1), (10.0, 4), (20.0, 4)]
    assert spark.read.parquet(str(tmp_path / "out" / "run_log")).count() == 3


def test_throttled_streams_keep_whole_messages(spark, tmp_path):
    df = messages(spark, 30)
    stream = source_folder(spark, tmp_path, df.filter("seq < 15"), df.filter("seq >= 15"))
    q = live.throttle_stream(stream(), 4000).writeStream.format("memory").queryName("throttled").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(i, float(i % 7)) for i in range(0, 30, 4)}
    assert {(r["seq"], r["message"]["value"]) for r in spark.table("throttled").collect()} == want
    assert {(r["seq"], r["message"]["value"]) for r in live.throttle(df, 4000).collect()} == want


def test_arrival_time_where_a_message_has_none(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None)], "seq long, t double")
    got = {r["seq"]: r["timestamp_seconds"] for r in live.with_timestamp(df, F.col("t")).collect()}
    assert got[1] == 5.0 and got[2] > 1.7e9


def test_staged_tables_can_be_removed(spark):
    import os

    before = len(storage.STAGED)
    kept, gone = storage.stage(spark.range(3), "kept"), storage.stage(spark.range(3), "gone")
    path = lambda i: storage.STAGED[i].removeprefix("file:")
    keep, drop = path(before), path(before + 1)
    storage.remove_staged(spark, before, (storage.STAGED[before],))
    assert os.path.exists(keep) and not os.path.exists(drop) and kept.count() == 3 and gone is not None


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=context)
    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_dir(session)
