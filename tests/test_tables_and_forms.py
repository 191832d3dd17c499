"""Tables that skip files, JSON in bounded memory, and statements over all ticks."""

import json
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from fleetlog.operators import analysis, gates
from fleetlog.sources import files
from fleetlog.sources.clustered import MessageTable
from fleetlog.sources.jsonform import MOST_DEPTH, JsonRecogniser

ROW = "log_id string, topic string, seq long, timestamp_seconds double, message struct<value: double>"


@pytest.fixture(scope="module")
def known(spark, tmp_path_factory):
    r = random.Random(1)
    rows = [(r.choice(("a", "b")), r.choice("xy"), i, r.uniform(0, 1000), (float(i),)) for i in range(4000)]
    rows += [(None, "z", 5000 + i, float(i), (0.0,)) for i in range(30)] + [("small", "x", 6000, 5.0, (0.0,))]
    table = MessageTable(spark, str(tmp_path_factory.mktemp("clustered")))
    for part in (rows[::2], rows[1::2]):
        table.write(spark.createDataFrame(part, ROW).repartition(3), file_rows=20)
    return rows, table


def test_windows_open_few_files(spark, known):
    rows, table = known
    every = table.messages()
    n = len(every.inputFiles())
    assert n > 150 and every.count() == len(rows)
    for lo, hi, logs, topics, most in ((500.0, 510.0, None, None, 12), (500.0, 510.0, ["a"], None, 8), (None, None, ["small"], None, 6), (None, 3.0, None, ["z"], 6), (990.0, None, None, ["y"], 12)):
        got = table.messages(lo, hi, logs, topics)
        want = [x[2] for x in rows if (lo is None or x[3] >= lo) and (hi is None or x[3] <= hi) and (logs is None or x[0] in logs) and (topics is None or x[1] in topics)]
        assert sorted(r["seq"] for r in got.collect()) == sorted(want) and want
        assert len(got.inputFiles()) <= most
    assert table.messages(5000.0, 6000.0).count() == 0 and table.messages(logs=["nobody"]).columns == ["log_id", "topic", "seq", "timestamp_seconds", "message"]
    made = table.messages(500.0, 510.0)
    plan = spark._jvm.PythonSQLUtils.explainString(made._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(timestamp_seconds,500.0), LessThanOrEqual(timestamp_seconds,510.0)" in plan


def test_questions_to_a_table(spark, known):
    rows, table = known
    got = analysis.query(table, "SELECT count(*) AS n, max(x.value) AS high FROM x", ["x"], 100.0, 150.0)
    inside = [x[4][0] for x in rows if x[1] == "x" and 100 <= x[3] <= 150]
    assert tuple(got.first()) == (len(inside), max(inside)) and len(got.inputFiles()) < 40


def test_many_files_are_read_by_folder(spark, known, monkeypatch):
    from fleetlog.sources import clustered

    rows, table = known
    monkeypatch.setattr(clustered, "MOST_PATHS", 2)
    assert table.messages(400.0, 600.0).count() == sum(400 <= x[3] <= 600 for x in rows)


def recognised(data, sizes):
    seen, at = JsonRecogniser(), 0
    while at < len(data):
        n = next(sizes)
        if not seen.feed(data[at : at + n]):
            return False
        at += n
    return seen.feed(b"", last=True) and seen.complete


def is_json(data):
    try:
        json.loads(data.decode())
        return True
    except ValueError:
        return False


def test_json_as_the_library_sees_it():
    r = random.Random(2)

    def value(depth):
        kind = 0 if depth > 4 else r.randint(0, 2)
        if kind == 0:
            return r.choice([1, -2.5e10, 0, True, None, "", "a\"\\\n\tü🙂 ", 1e-7, float("inf")])
        return [value(depth + 1) for _ in range(r.randint(0, 3))] if kind == 1 else {r.choice("abé"): value(depth + 1) for _ in range(r.randint(0, 3))}

    sound = 0
    for _ in range(3000):
        data = json.dumps(value(0), ensure_ascii=r.random() < 0.5, indent=r.choice((None, 1))).encode()
        for _ in range(r.choice((0, 0, 1, 2))):
            i = r.randrange(len(data) + 1)
            data = data[:i] + r.choice((b"", b",", b"]", b"}", b"[", b'"', b"\\", b"\\u12", b"1", b"-", b".", b"e", b" ", b"\xff", b"tru")) + data[i + r.randint(0, 1) :]
        try:
            want = is_json(data)
        except UnicodeDecodeError:
            want = False
        sound += want
        sizes = iter(lambda: r.randint(1, 9), None)
        assert recognised(data, sizes) == want, data
    assert 500 < sound < 2900


def test_large_json_in_little_memory():
    block = b'{"a": [1, 2.5, "text", null, {"b": false}]}, ' * 20_000
    for start, each, end, want in ((b"[", block, b"1]", True), (b"{", b" " * 900_000, b"x", False), (b'{"a": "', b"y" * 900_000, b'"}', True), (b'{"a": "', b"\\u00e9" * 150_000, b'"}', True)):
        seen = JsonRecogniser()
        tracemalloc.start()
        ok = seen.feed(start)
        for _ in range(5):
            ok = ok and seen.feed(each)
        ok = ok and seen.feed(end) and seen.feed(b"", last=True) and seen.complete
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert ok == want and peak < 8 << 20
    deep = JsonRecogniser()
    assert deep.feed(b"[" * MOST_DEPTH) and not deep.feed(b"[")


def test_formats_by_blocks(spark, tmp_path):
    made = {
        "line.json": b"[" + b"1," * 1_500_000 + b"1]", "lines.jsonl": b'{"a": "' + b"x" * 3_000_000 + b'"}\nrubbish', "no.json": b"{" + b" " * 3_000_000 + b"no", "deep.json": b"[" * 5000 + b"]" * 5000,
        "cut.json": b'{"a": 1', "pretty.json": b'{\n"a":\n[1,\n2]}\n', "after.json": b'\n{"a": 1}',
    }
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rpartition("/")[2]: r["format"] for r in files.file_inventory(spark, str(tmp_path)).collect()}
    assert {k for k, v in got.items() if v == "table.json"} == {"line.json", "lines.jsonl", "deep.json", "pretty.json", "after.json"}


def test_statements_run_without_nested_loops(spark):
    r = random.Random(3)
    rows = [(r.choice(("a", None)), "x", i, r.uniform(0, 50), (r.uniform(0, 9),)) for i in range(200)]
    ticks = [(r.choice(("a", None)), i, r.uniform(0, 60)) for i in range(30)]
    df, at = spark.createDataFrame(rows, ROW), spark.createDataFrame(ticks, "log_id string, tick_no long, asof_seconds double")
    statement = "SELECT count(*) >= 3 AND max(w.message.value) > 8 FROM {window} w WHERE w.message.value > 1"
    made = gates.sql_gate_statement(at, df, statement, 7.0)
    assert "NestedLoop" not in made._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in made._jdf.queryExecution().executedPlan().toString()
    got = {x["tick_no"]: x["passed"] for x in made.collect()}
    for log, no, t in ticks:
        inside = [x[4][0] for x in rows if x[0] == log and max(t - 7, 0) <= x[3] <= t and x[4][0] > 1]
        want = False if len(inside) < 3 else max(inside) > 8
        assert bool(got[no]) == want
    assert len(got) == 30
    assert made.filter(F.col("passed")).count() > 2
