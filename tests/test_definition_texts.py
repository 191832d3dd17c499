"""Definitions of whole texts: cut, parsed and resolved within their rows, like the general operators on lines."""

from fleetlog.operators import catalog, definitions

TEXTS = [
    ("1", "int32 a 1 # first\r\nstring<=3 b \"x # y\" # z\nHeader h\nTime t\nPlace p\nLost l\n====\nMSG: std_msgs/Header\nuint32 seq\n===\nMSG: shop/Place\nShelf s\n===\nMSG: shop/Shelf\nMSG: shop/Again\nint8 X=3"),
    ("2", "===\nMSG: a/B\nB b\n===\n===\nMSG: builtin_interfaces/msg/Time\n"),
    ("3", ""),
    ("4", None),
    ("5", "int32 a 'open # no\nfoo bar\nTime t\nDuration[2] d [1, 2]\n=== x\n==\nMSG:\nMSG: \nstd_msgs/Empty e\n===\nMSG: std_msgs/msg/Empty"),
]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_texts_are_cut_within_their_rows(spark):
    texts = spark.createDataFrame(TEXTS, "text_id string, text string")
    lines, whole = definitions.definition_sections(definitions.definition_lines(texts)), definitions.sectioned_texts(texts)
    assert rows(lines.select("text_id", "line_no", "line", "kind", "section", "section_type")) == rows(whole.drop("known"))
    fields = definitions.definition_fields(lines)
    assert rows(fields) == rows(definitions.definition_fields(whole))
    for version in (1, 2):
        assert rows(definitions.resolve_types(fields, lines, version)) == rows(definitions.resolve_texts(whole, version))
    made = definitions.resolve_texts(whole)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert {(r["text_id"], r["type"]): (r["target"], r["rule"]) for r in made.collect()} == {
        ("1", "Header"): ("std_msgs/Header", 2), ("1", "Time"): (None, None), ("1", "Place"): ("shop/Place", 6), ("1", "Lost"): (None, None), ("1", "Shelf"): ("shop/Shelf", 5),
        ("2", "B"): ("a/B", 5), ("5", "foo"): (None, None), ("5", "Time"): (None, None), ("5", "Duration"): (None, None), ("5", "std_msgs/Empty"): ("std_msgs/msg/Empty", 4),
    }


def test_a_long_line_needs_no_deep_stack(spark):
    text = "string s \"" + "x" * 200_000 + "\" # " + "y" * 200_000
    texts = spark.createDataFrame([("1", text)], "text_id string, text string")
    field = definitions.definition_fields(definitions.definition_lines(texts).selectExpr("*", "0 AS section", "'' AS section_type")).first()
    assert (field["name"], len(field["value"]), len(field["comment"])) == ("s", 200_002, 200_000)


def test_a_line_is_matched_once(spark):
    texts = spark.createDataFrame([("1", "int8 X=300\nint8 y\nint8[0] z\nstring<=0 s\nfloat32 w 1e39\nint8[2] p [1]\nint8 q [\nint8 r [1, 200]\nint8 t 99999999999999999999999\nuint64 u 18446744073709551615")], "text_id string, text string")
    for lines in (definitions.sectioned_texts(texts), definitions.definition_sections(definitions.definition_lines(texts))):
        made = definitions.definition_errors(definitions.definition_fields(lines))
        assert made._jdf.queryExecution().optimizedPlan().toString().count("(trim(line") == 1
        assert rows(made.select("name", "error")) == [
            ("X", "integer out of range"), ("p", "default has the wrong length"), ("q", "integer out of range"), ("r", "integer out of range"), ("s", "string bound must be above 0"),
            ("t", "integer out of range"), ("w", "float32 out of range"), ("z", "array size must be above 0"),
        ]


def test_topic_texts_parse_each_line_once(spark):
    texts = spark.createDataFrame([("b", "int8 y # up\nThing x\n# no\n\nint8 A = 3"), ("a", "===\nMSG: k/Thing\nfloat32 z")], "text_id string, text string")
    fields = definitions.definition_fields(definitions.sectioned_texts(texts))
    made = catalog.describe_text(fields.selectExpr("text_id AS topic", "line_no AS position", "type", "name", "comment AS description"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("(trim(line") == 1
    assert rows(made) == [("a", "# a\nfloat32 z"), ("b", "# b\nint8 y # up\nThing x\nint8 A")]
