"""Topics whose types differ by version."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlog.operators import versions

DEFINITIONS = {
    "1": "int32 id\nfloat32 speed\nstring name\nPoint at\n===\nMSG: pkg/Point\nint8 x",
    "2": "int64 id\nfloat32 speed\nPoint at\nPoint[] path\n===\nMSG: pkg/Point\nint16 x\nfloat32 y",
    "3": "int64 id\nfloat64 speed\nstring name\nbool on\nPoint at\n===\nMSG: pkg/Point\nfloat32 x",
}
ROWS = [
    ("a", "/odom", 0, 1.0, {"id": 1, "speed": 0.5, "name": "n", "at": {"x": 3}}),
    ("b", "/odom", 1, 2.0, {"id": 2**40, "speed": 1.5, "at": {"x": 4, "y": 0.25}, "path": [{"x": 1, "y": 2.5}, {"x": 2}]}),
    ("c", "/odom", 2, 3.0, {"id": 3, "speed": 2.25, "name": None, "on": True, "at": {"x": 1.5}, "more": "unknown fields are left out"}),
    ("c", "/odom", 3, 4.0, None),
    ("c", "other", 4, 5.0, {"id": 9}),
]


def given(spark):
    rows = [(*x[:4], json.dumps(x[4]) if x[4] else "no json") for x in ROWS]
    messages = spark.createDataFrame(rows, "log_id string, topic string, seq long, timestamp_seconds double, text string")
    known = [("/odom", v, t) for v, t in DEFINITIONS.items()] + [("other", "1", "int32 id")]
    return versions.json_payloads(messages, F.col("text")), spark.createDataFrame(known, "topic string, version string, text string")


def test_three_versions_are_one_relation(spark):
    messages, definitions = given(spark)
    schema = versions.merge_schemas(versions.schemas_of(definitions, "/odom"))
    assert schema.simpleString() == "struct<id:bigint,speed:double,name:string,at:struct<x:float,y:float>,path:array<struct<x:smallint,y:float>>,on:boolean>"
    got = {r["seq"]: r["/odom"] for r in versions.typed_topic(messages, "/odom", schema).collect()}
    assert got[0].asDict(True) == {"id": 1, "speed": 0.5, "name": "n", "at": {"x": 3.0, "y": None}, "path": None, "on": None}
    assert got[1].asDict(True) == {"id": 2**40, "speed": 1.5, "name": None, "at": {"x": 4.0, "y": 0.25}, "path": [{"x": 1, "y": 2.5}, {"x": 2, "y": None}], "on": None}
    assert got[2]["at"]["x"] == 1.5 and got[2]["on"] and got[3] is None and set(got) == {0, 1, 2, 3}


def test_sql_and_wide_relation_over_versions(spark):
    messages, definitions = given(spark)
    sql = "SELECT sum(`/odom`.id) AS ids, max(`/odom`.at.x) AS x, count(*) AS n FROM `/odom`"
    assert tuple(versions.query_versions(messages, definitions, sql, ["/odom"], hi=3.0).first()) == (1 + 2**40 + 3, 4.0, 3)
    wide = {r["seq"]: (r["/odom"] and r["/odom"]["id"], r["other"] and r["other"]["id"]) for r in versions.wide_versions(messages, definitions, ["/odom", "other"]).collect()}
    assert wide == {0: (1, None), 1: (2**40, None), 2: (3, None), 3: (None, None), 4: (None, 9)}


def test_conflicts_are_named(spark):
    one = T.StructType.fromDDL("a int, b struct<c: string, d: array<int>>")
    other = T.StructType.fromDDL("a string, b struct<c: string, d: array<string>>")
    with pytest.raises(versions.SchemaConflictError, match=r"a: int and string \(version 2\); b.d\[\]: int and string \(version 2\)"):
        versions.merge_schemas({"1": one, "2": other})
    with pytest.raises(ValueError, match="unresolved type Gone"):
        versions.schemas_of(spark.createDataFrame([("t", "1", "Gone x")], "topic string, version string, text string"), "t")


@pytest.mark.parametrize("a,b,want", [("tinyint", "smallint", "smallint"), ("smallint", "float", "float"), ("int", "float", "double"), ("bigint", "double", "double"), ("float", "double", "double"), ("boolean", "int", None), ("bigint", "decimal(20,0)", "decimal(20,0)")])
def test_widening(a, b, want):
    a, b = T.DataType.fromDDL(a), T.DataType.fromDDL(b)
    assert (versions.widest(a, b) or T.NullType()).simpleString() == (versions.widest(b, a) or T.NullType()).simpleString() == (want or "void")
