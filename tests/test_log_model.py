"""Small hand-written logs: ties, empty windows, NULL gates, first-fire rules, invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlog.functions import columns as C
from fleetlog.operators import analysis, catalog, definitions, gates, loggings, lookback, relation, tasks, ticks
from fleetlog.operators.rowindex import row_index
from fleetlog.plans.pipeline import Every, Pipeline, SpecError, pipeline_from_config
from fleetlog.sources import files
from fleetlog.streaming import live

SCHEMA = "log_id string, topic string, seq long, timestamp_seconds double, message struct<value: double>"


def log(spark, rows):
    return spark.createDataFrame([(a, b, i, float(t), (v,)) for i, (a, b, t, v) in enumerate(rows)], SCHEMA)


@pytest.fixture
def small(spark):
    rows = [("a", "x", 1, 1.0), ("a", "/odom", 1, 2.0), ("a", "x", 3, 3.0), ("a", "x", 3, 4.0), ("a", "/odom", 9, 5.0), ("b", "x", 5, None)]
    return log(spark, rows)


def test_summary_and_topics(small):
    got = {r["log_id"]: r for r in catalog.describe_logs(small).collect()}
    assert (got["a"]["total_message_count"], got["a"]["duration_seconds"]) == (5, 8.0)
    assert catalog.topics(small).count() == 3
    with pytest.raises(catalog.MissingTopicError, match="gone"):
        catalog.require_topics(small, ["x", "gone"])


def test_wide_and_ffill_carry_every_topic(small):
    for huge in (False, True):
        made = relation.ffill(relation.wide(small, ["x", "/odom"]), huge).orderBy("log_id", "timestamp_seconds", "seq")
        got = [(r["log_id"], r["x"] and r["x"]["value"], r["/odom"] and r["/odom"]["value"]) for r in made.collect()]
        assert got == [("a", 1.0, None), ("a", 1.0, 2.0), ("a", 3.0, 2.0), ("a", 4.0, 2.0), ("a", 4.0, 5.0), ("b", None, None)]


def test_sql_on_a_topic_with_a_slash(small):
    made = analysis.query(small, "SELECT sum(`/odom`.value) AS s FROM `/odom`", ["/odom"], hi=2)
    assert made.first()["s"] == 2.0
    assert not small.sparkSession.catalog.tableExists("`/odom`")


def test_row_index_of_one_log_equals_window(spark):
    rng = np.random.default_rng(1)
    df = log(spark, [(str(rng.integers(3)), "x", int(rng.integers(40)), 1.0) for _ in range(500)])
    keys, order = ["log_id"], ["timestamp_seconds", "seq"]
    a, b = (sorted((r["seq"], r["row_index"]) for r in row_index(df, keys, order, h).collect()) for h in (False, True))
    assert a == b


def test_greedy_cadence_is_not_tumbling(spark):
    t = np.array([0.0, 0.0, 4.0, 9.9, 10.0, 12.0, 19.0, 20.0, 35.0])
    assert [t[i] for i in ticks.greedy(t, 10.0)] == [0.0, 10.0, 20.0, 35.0]
    assert ticks.greedy(np.array([]), 10.0) == []
    assert [t[i] for i in ticks.greedy(t, 10.0, last=5.0)] == [19.0, 35.0]
    got = ticks.ticks_every_seconds(log(spark, [("a", "x", x, 1.0) for x in t]), 10.0).orderBy("tick_no").collect()
    assert [r["asof_seconds"] for r in got] == [0.0, 10.0, 20.0, 35.0]


def test_set_based_lookback_equals_a_loop_over_ticks(spark):
    rng = np.random.default_rng(2)
    df = log(spark, [("a", "x", float(rng.integers(0, 60)) / 4, float(i)) for i in range(80)])
    pdf = df.toPandas().sort_values(["timestamp_seconds", "seq"])
    times = ticks.ticks_every_frames(df, 7)
    seen = lookback.lookback_time(df, times, 2.5).groupBy("tick_no").agg(F.sort_array(F.collect_list("seq")).alias("s"))
    last = lookback.lookback_frames(df, times, 5).groupBy("tick_no").agg(F.sort_array(F.collect_list("seq")).alias("s"))
    by_time, by_frame = ({r["tick_no"]: r["s"] for r in x.collect()} for x in (seen, last))
    for r in times.collect():
        upto = pdf[pdf.timestamp_seconds <= r["asof_seconds"]]
        inside = upto if r["asof_seconds"] < 2.5 else upto[upto.timestamp_seconds >= r["asof_seconds"] - 2.5]
        assert by_time[r["tick_no"]] == sorted(inside.seq)
        assert by_frame[r["tick_no"]] == sorted(upto.tail(5).seq)


def test_ticks_before_the_first_message_see_nothing(spark):
    df = log(spark, [("a", "x", 50, 1.0)])
    early = spark.createDataFrame([("a", 0, 1.0)], "log_id string, tick_no long, asof_seconds double")
    assert lookback.lookback_frames(df, early, 3).count() == 0
    assert gates.sql_gate(early, df, F.count("*") == 0, 5.0).first()["passed"] is True
    with pytest.raises(Exception, match="NULL"):
        gates.sql_gate(early, df, F.max("message.value") > 1, 5.0).collect()


def test_gates_and_run_log(spark):
    df = log(spark, [("a", "x", t, float(t)) for t in range(6)])
    p = Pipeline("p", "x", Every(2, "frame"), None, {"big": lambda t: t.withColumn("passed", F.col("asof_seconds") >= 2)}, {"fail": lambda t: t.withColumn("error", F.when(F.col("asof_seconds") == 2, "bad"))})
    status = {r["asof_seconds"]: r["status"] for r in p.run(df)[1].collect()}
    assert status == {0.0: "skipped", 2.0: "failed"}
    allowed = Pipeline(p.name, p.topic, p.when, None, p.gates, p.tasks, allow_failure=True)
    assert {r["asof_seconds"]: r["status"] for r in allowed.run(df)[1].collect()} == {0.0: "skipped", 2.0: "failed", 4.0: "executed"}


def test_bad_specs():
    for spec in ({}, {"name": "Bad Name", "cadence": {"topic": "x"}, "tasks": []}, {"name": "a", "cadence": {}, "tasks": []}, {"name": "a", "cadence": {"topic": "x", "when": {"value": 1, "unit": "day"}}, "tasks": []}):
        with pytest.raises(SpecError):
            pipeline_from_config(spec, {}, {})
    with pytest.raises(ValueError):
        C.to_seconds(1, "frame")


def test_registered_gate_ignores_unknown_and_needs_its_own(spark):
    gates.register_gate("g", lambda ticks: ticks)
    with pytest.raises(TypeError):
        gates.call(gates.GATES, "g", other=1)


def test_detection_arguments(spark):
    df = spark.createDataFrame([(1, "car", 0.9, 5.0), (1, "car", 0.2, 9.0), (2, "dog", 0.9, 1.0)], "frame long, label string, score double, closeness double")
    assert {r["frame"]: r["passed"] for r in gates.detection_gate(df, ["car"], 0.5, 0.0).collect()} == {1: True, 2: False}
    assert gates.detection_gate(df, ["car"], 0.5).filter("passed").count() == 0  # below the frame's median
    with pytest.raises(ValueError):
        gates.detection_gate(df, [], 0.5)


def test_leveled_loggings_end_is_exclusive(spark):
    df = spark.createDataFrame([("a", float(t), "INFO", "m") for t in range(4)], "log_id string, timestamp_seconds double, log_level string, message string")
    assert loggings.leveled_loggings(df, 1, 3).count() == 2


def test_excursions_and_changes(spark):
    df = log(spark, [("a", "x", t, v) for t, v in enumerate([1.0, 9.0, 8.0, 1.0, 9.0])])
    got = sorted((r["start_seconds"], r["n"], r["peak"]) for r in analysis.excursions(df, F.col("message.value"), 5.0).collect())
    assert got == [(1.0, 2, 9.0), (4.0, 1, 9.0)]
    assert analysis.sudden_change(df, F.col("message.value"), 5.0).count() == 3


def test_decode_isolates_rows(spark):
    df = spark.createDataFrame([(1, b"ok"), (2, b"\xff"), (3, None)], "key long, payload binary")
    got = {r["key"]: (r["decoded"], r["error"] is None) for r in tasks.decode_payloads(df, lambda b: b.decode()).collect()}
    assert got == {1: ("ok", True), 2: (None, False)}


def test_exact_decimals(spark):
    values = [1704067432.824425, 0.1, 2.5, 123456.999999999, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", C.fixed8(F.col("v")).alias("s"))
    assert all(r["s"] == "%.8f" % r["v"] for r in df.collect())


def test_columns(spark):
    df = spark.createDataFrame([("imu_0_1", "axisP[12]", "aé", "a,b")], "t string, f string, x string, p string")
    name, index = C.name_and_index(F.col("f"))
    r = df.select(*(c.alias(n) for c, n in zip(C.split_type(F.col("t")), ("a", "b"))), name.alias("n"), index.alias("i"), C.text_to_codes(F.col("x")).alias("c"), C.positional(F.split("p", ","), ["p", "q", "r"]).alias("pos"), C.snake_case(F.lit("My Topic-Name")).alias("s")).first()
    assert (r["a"], r["b"], r["n"], r["i"], r["c"], tuple(r["pos"]), r["s"]) == ("imu_0", "1", "axisP", 12, [97, 233], ("a", "b", None), "my_topic_name")


DEFINITION = """# a pose
Header header
uint8 KIND=3 # which
int8[2] pair [1, 2]
string<=4 label "abc"
Point[<=3] points
float32 far 1e39
int8 wide 200
Nowhere gone
===
MSG: std_msgs/Header
uint32 seq
===
MSG: geometry_msgs/Point
float64 x"""


def test_definitions(spark):
    texts = spark.createDataFrame([("t", DEFINITION)], "text_id string, text string")
    lines = definitions.definition_sections(definitions.definition_lines(texts))
    kinds = [r["kind"] for r in lines.orderBy("line_no").collect()]
    assert kinds == ["comment", "complex", "constant", "builtin", "builtin", "complex", "builtin", "builtin", "complex", "separator", "type", "builtin", "separator", "type", "builtin"]
    fields = definitions.definition_fields(lines)
    by = {r["name"]: r for r in fields.collect()}
    assert (by["points"]["array"], by["points"]["array_size"], by["label"]["string_bound"], by["KIND"]["value"], by["KIND"]["comment"]) == ("bounded", 3, 4, "3", "which")
    assert sorted((r["name"], r["error"]) for r in definitions.definition_errors(fields).collect()) == [("far", "float32 out of range"), ("wide", "integer out of range")]
    resolved = definitions.resolve_types(fields, lines)
    got = {r["type"]: (r["target"], r["rule"]) for r in resolved.collect()}
    assert got == {"Header": ("std_msgs/Header", 2), "Point": ("geometry_msgs/Point", 6), "Nowhere": (None, None)}
    sound = fields.filter("name <> 'gone'")
    assert definitions.to_struct(sound, resolved, "t").simpleString() == "struct<header:struct<seq:bigint>,KIND:smallint,pair:array<tinyint>,label:string,points:array<struct<x:double>>,far:float,wide:tinyint>"


def test_file_formats(tmp_path, spark):
    made = {"a.bag": b"#ROSBAG V2.0\n", "b.bin": b"\xa3\x95\x80xx", "c.BBL": b"H Product:x", "d.json": b'{"a": 1}\n{"a": 2}\n', "e.csv": b"a,b\n1,2\n", "f.txt": b"plain words\nmore\n", "g.db3.zstd": b"??", "h.json": b'[{"a":\n1}]'}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rpartition("/")[2]: r["format"] for r in files.file_inventory(spark, str(tmp_path)).collect()}
    assert got == {"a.bag": "ros1.bag", "b.bin": "ardupilot.bin", "c.BBL": "betaflight.bbl", "d.json": "table.json", "e.csv": "table.csv", "f.txt": None, "g.db3.zstd": "ros2.db3", "h.json": "table.json"}
    with pytest.raises(NotImplementedError):
        files.file_inventory(spark, "https://example.com/x")


def test_content_uuid(tmp_path, spark):
    import hashlib
    import uuid

    (tmp_path / "b").write_bytes(b"two")
    (tmp_path / "a").write_bytes(b"one")
    rows = [("x", str(tmp_path / n)) for n in ("b", "a")]
    want = "_".join(hashlib.md5(t).hexdigest() for t in (b"one", b"two"))
    got = files.content_uuid(spark.createDataFrame(rows, "log_id string, path string")).first()["content_uuid"]
    assert got == str(uuid.uuid5(uuid.NAMESPACE_OID, want))


def test_topic_buffer_reads_overflow_first(tmp_path, spark):
    folder = tmp_path / "data" / "x"
    folder.mkdir(parents=True)
    (folder / "overflow.jsonl").write_text('{"timestamp_seconds": 1.0, "x": {"v": 1}}\n')
    (folder / "current.jsonl").write_text('{"timestamp_seconds": 1.0, "x": {"v": 2}}\n')
    got = files.buffer_messages(files.read_buffer(spark, str(tmp_path), {"x": "v: long"})).orderBy("seq").collect()
    assert [r["message"]["v"] for r in got] == [1, 2]


def test_retained_bytes_keep_whole_lines(spark):
    df = log(spark, [("a", "x", t, 1.0) for t in range(3)])
    n = live.retain_bytes(df, None).first()["line_bytes"]
    assert sorted(r["seq"] for r in live.retain_bytes(df, 2 * n + 1).collect()) == [1, 2]


def test_stream_ticks_equal_batch_ticks_over_batches(spark, tmp_path):
    rng = np.random.default_rng(3)
    t = np.sort(rng.integers(0, 400, 60) / 4.0)
    df = log(spark, [("a", "x", x, 1.0) for x in t])
    for k, (lo, hi) in enumerate([(0, 20), (20, 45), (45, 60)]):
        df.filter((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = live.stream_ticks(source, Every(10, "second"))
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(r["asof_seconds"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [t[i] for i in ticks.greedy(t, 10.0)]
    ran = spark.createDataFrame([("a", "x", float(t[-1]))], "log_id string, topic string, asof_seconds double")
    assert live.final_ticks(df, ran).count() == 0


def test_second_subscription_is_an_error(spark, tmp_path):
    df = log(spark, [("a", "x", 1, 1.0)])
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = live.ingest(source, str(tmp_path / "t"), str(tmp_path / "c"), name="one", available_now=False)
    try:
        with pytest.raises(live.AlreadySubscribedError):
            live.ingest(source, str(tmp_path / "t2"), str(tmp_path / "c2"), name="one")
    finally:
        live.pause(q)


def test_points_and_manifest(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0])], "k long, v array<double>")
    assert [tuple(r) for r in tasks.explode_points(df, "v", ["x", "y"]).collect()] == [(1, 0, 1.0, 2.0), (1, 1, 3.0, 4.0)]
    text = "rosbag2_bagfile_information:\n  version: 5\n  storage_identifier: mcap\n  message_count: 3\n  relative_file_paths: [a.mcap]\n  topics_with_message_count:\n    - topic_metadata: {name: /x, type: T, serialization_format: cdr}\n      message_count: 3\n"
    made = files.parsed_manifests(spark.createDataFrame([("/d/metadata.yaml", text)], "path string, value string"))
    assert made.first()["topics"][0]["messages"] == 3
    there = spark.createDataFrame([("/d/b.mcap",)], "path string")
    assert [r["path"] for r in files.missing_files(made, there).collect()] == ["/d/a.mcap"]
