"""A query for each operator over the given tables, and the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import columns as C
from .operators import analysis, catalog, definitions, gates, loggings, lookback, panes, quantiles, relation, tasks, ticks, versions
from .operators.rowindex import row_index
from .plans.pipeline import Every, Pipeline, pipeline_from_config
from .sources import clustered, files, topicfolder
from .sources.tables import event_messages, table, talk_messages
from .storage import new_folder
from .streaming import bounded, live, pipelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Events as one log, and as one log a user, for the SQL.
M = "WITH RECURSIVE m AS (SELECT 'events' AS log_id, event_type AS topic, event_id AS seq, epoch_us(ts)/1e6 AS t, event_id, user_id, value, props, ts FROM events)"
FLEET = M.replace("'events'", "'user_' || user_id")
T0, DAY = 1704067200.0, 86400.0
R4 = lambda c: F.round(c, 4) + F.lit(0.0)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def value():
    return F.col("message.value")


def one(spark, d):
    return event_messages(spark, d)


def fleet(spark, d):
    return event_messages(spark, d, fleet=True)


def flat(df: DataFrame) -> DataFrame:
    """Keys and the message's value, for comparison."""
    own = [c for c in df.columns if c != "message"]
    return df.select(*own, F.col("message.value").alias("value")) if "message" in df.columns else df


# Sources and catalog


@query("log_summary", f"{FLEET} SELECT log_id, count(*) AS total_message_count, min(t) AS start_seconds, max(t) AS end_seconds, max(t) - min(t) AS duration_seconds FROM m GROUP BY log_id")
def _(s, d):
    return catalog.describe_logs(fleet(s, d))


@query("ts_normalise", "SELECT event_id, event_id * 1000 / 1e3 AS from_number, epoch_us(ts)/1e6 AS from_text, epoch_us(ts)/1e6 AS from_time FROM events")
def _(s, d):
    ts = F.col("ts")
    return table(s, d, "events").select(
        "event_id",
        C.to_seconds_col(F.col("event_id") * 1000, "number", "ms").alias("from_number"),
        C.to_seconds_col(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"), "string", "%Y-%m-%d %H:%M:%S.%f").alias("from_text"),
        C.to_seconds_col(ts, "timestamp").alias("from_time"),
    )


@query(
    "tabular_as_topic",
    "SELECT 'orders' AS log_id, 'message' AS topic, epoch_us(o_orderdate)/1e6 AS timestamp_seconds, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS seq, o_orderkey FROM orders",
)
def _(s, d):
    made = relation.as_messages(table(s, d, "orders"), C.seconds_of(F.col("o_orderdate")), "orders", ["o_orderkey"])
    return made.select("log_id", "topic", "timestamp_seconds", "seq", "message.o_orderkey")


def params(s, d):
    return table(s, d, "orders").select(
        F.lit("orders").alias("log_id"), F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("value"), C.seconds_of(F.col("o_orderdate")).alias("timestamp_seconds"), F.col("o_orderkey").alias("seq")
    )


@query("param_snapshot", "SELECT 'orders' AS log_id, o_orderpriority AS name, arg_max(o_totalprice, (epoch_us(o_orderdate), o_orderkey)) AS value FROM orders GROUP BY o_orderpriority")
def _(s, d):
    return files.param_snapshot(params(s, d))


def written(s: SparkSession, d: str, fmt: str) -> str:
    """Events written as ``fmt`` files in the shared folder, a sub-folder a topic."""
    path = new_folder(s, f"events-{fmt}")
    table(s, d, "events").drop("ts").withColumn("t", F.col("event_id") * 1.0).write.partitionBy("event_type").option("header", True).format(fmt).save(path)
    return path


@query("csv_source", "SELECT event_id, event_type, value, event_id / 1000.0::DOUBLE AS timestamp_seconds FROM events")
def _(s, d):
    path = written(s, d, "csv")
    made = files.read_csv(s, path, ignore=["skip_"], exclude_invalid=True, timestamp="t", fmt="milliseconds")
    return made.select(F.col("event_id").cast("long").alias("event_id"), "event_type", "value", "timestamp_seconds")


@query("json_source", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS timestamp_seconds FROM events")
def _(s, d):
    path = new_folder(s, "events-json")
    table(s, d, "events").select("event_id", F.struct(F.from_json("props", "k long").alias("inner")).alias("outer")).write.json(path)
    made = files.read_json(s, path, "event_id long, outer struct<inner: struct<k: long>>", timestamp=["outer", "inner", "k"], fmt="seconds")
    return made.select("event_id", F.col("outer.inner.k").alias("k"), "timestamp_seconds")


def topic_of_path():
    return F.regexp_extract("path", "event_type=([^/]+)", 1).alias("topic")


@query("file_inventory", "SELECT DISTINCT event_type AS topic, 'table.csv' AS format FROM events")
def _(s, d):
    return files.file_inventory(s, written(s, d, "csv")).select(topic_of_path(), "format").distinct()


@query(
    "path_validation",
    "SELECT DISTINCT event_type AS topic, unnest(['table.json', 'table.csv', 'table.csv', 'px4.ulg']) AS format, unnest([NULL, 'missing', 'wrong content', 'wrong extension']) AS error FROM events",
)
def _(s, d):
    found = files.file_inventory(s, written(s, d, "json"))
    asked = [("path", "table.json"), (F.concat("path", F.lit(".gone")), "table.csv"), ("path", "table.csv"), ("path", "px4.ulg")]
    wanted = [found.select(F.col(p).alias("path") if isinstance(p, str) else p.alias("path"), F.lit(fmt).alias("format")) for p, fmt in asked]
    wanted = wanted[0].union(wanted[1]).union(wanted[2]).union(wanted[3])
    return files.validate_paths(found, wanted).select(topic_of_path(), "format", "error").distinct()


@query("content_uuid")
def _(s, d):
    listed = files.listing(s, written(s, d, "csv"))
    return files.content_uuid(listed.select(F.regexp_extract("path", "event_type=([^/]+)", 1).alias("log_id"), "path"))


def buffer_folder(s: SparkSession, d: str) -> str:
    """A topic buffer made of events: lines by topic."""
    folder = new_folder(s, "buffer")
    for topic in ("click", "view"):
        rows = one(s, d).filter(F.col("topic") == topic).select("timestamp_seconds", F.struct("message.value", "message.user_id").alias(topic))
        rows.write.json(f"{folder}/data/{topic}")
    return folder


@query("buffer_read", f"{M} SELECT topic, t AS timestamp_seconds, value FROM m WHERE topic IN ('click', 'view')")
def _(s, d):
    made = files.read_buffer(s, buffer_folder(s, d), dict.fromkeys(("click", "view"), "value: double, user_id: long"))
    return flat(made).select("topic", "timestamp_seconds", "value")


@query("buffer_numbers", f"{M} SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY t) AS seq, t AS timestamp_seconds FROM m WHERE topic IN ('click', 'view')")
def _(s, d):
    """Numbers of a buffer's messages; a topic is numbered by ranges."""
    made = files.read_buffer(s, buffer_folder(s, d), dict.fromkeys(("click", "view"), "value: double, user_id: long"))
    return files.buffer_messages(made, huge=True).select("topic", "seq", "timestamp_seconds")


LINES = f"{M} SELECT topic, t AS timestamp_seconds, value FROM m WHERE topic IN ('click', 'view')"


def folder_values(df: DataFrame) -> DataFrame:
    """Lines of ``buffer_folder`` as columns."""
    return df.select("topic", "timestamp_seconds", F.get_json_object("message", "$.value").cast("double").alias("value"))


@query("topic_folder", LINES)
def _(s, d):
    """The folder as a data source, its files cut into ranges of bytes."""
    topicfolder.register(s)
    return folder_values(s.read.format("topic_folder").option("part_bytes", 1 << 16).load(buffer_folder(s, d)))


@query("topic_folder_window", f"{LINES[: LINES.index('IN (')]}= 'click' AND t BETWEEN {T0 + 5 * DAY} AND {T0 + 6 * DAY}")
def _(s, d):
    """A topic and a time window, which choose folders and parts."""
    folder, index = buffer_folder(s, d), new_folder(s, "index")
    topicfolder.write_index(s, folder, index, 1 << 14)
    made = s.read.format("topic_folder").option("part_bytes", 1 << 14).option("index", index).load(folder)
    return folder_values(made.filter((F.col("topic") == "click") & F.col("timestamp_seconds").between(T0 + 5 * DAY, T0 + 6 * DAY)))


@query("topic_folder_stream", LINES)
def _(s, d):
    """The folder as a stream."""
    topicfolder.register(s)
    out = new_folder(s, "lines")
    made = s.readStream.format("topic_folder").load(buffer_folder(s, d))
    made.writeStream.option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(out, "parquet").awaitTermination()
    return folder_values(s.read.schema(made.schema).parquet(out))


def bag_folder(s: SparkSession, d: str) -> str:
    """Manifests made of events: a bag a user, with counts by topic."""
    folder = new_folder(s, "bags")
    counts = one(s, d).groupBy(F.col("message.user_id").alias("user"), "topic").agg(F.count("*").alias("n"), F.min("timestamp_seconds").alias("t"))
    topic = F.format_string("    - topic_metadata: {name: /%s, type: std_msgs/msg/String, serialization_format: cdr}\n      message_count: %d\n", "topic", "n")
    bags = counts.groupBy("user").agg(F.concat_ws("", F.array_sort(F.collect_list(topic))).alias("topics"), F.sum("n").alias("n"), F.min("t").alias("t"))
    text = F.concat(
        F.lit("rosbag2_bagfile_information:\n  version: 5\n  storage_identifier: mcap\n  compression_format: ''\n"),
        F.format_string("  message_count: %d\n  topics_with_message_count:\n", "n"),
        "topics",
        F.format_string("  files:\n    - path: bag_%d.mcap\n      starting_time: {nanoseconds_since_epoch: %d}\n      duration: {nanoseconds: 5}\n      message_count: %d", "user", F.floor("t") * 1_000_000_000, "n"),
    )
    # A file a bag, which costs more than its few bytes say: they are dealt to all tasks, and each moves its own into place.
    dealt = bags.select(text.alias("value"), "user").repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "user")
    writer = dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", 2)
    writer.partitionBy("user").text(folder)
    return folder


def manifest_texts(s: SparkSession, d: str) -> DataFrame:
    """The written manifests; here files aren't called metadata.yaml, so they are read as texts."""
    texts = s.read.option("recursiveFileLookup", "true").text(bag_folder(s, d), wholetext=True)
    return texts.select(F.col("_metadata.file_path").alias("path"), "value")


@query("bag_manifest", f"{M}, c AS (SELECT user_id, topic, count(*) AS n FROM m GROUP BY ALL) SELECT 5::BIGINT AS version, 'mcap' AS storage, '/' || topic AS topic, n AS messages, sum(n) OVER (PARTITION BY user_id)::BIGINT AS total FROM c")
def _(s, d):
    return files.parsed_manifests(manifest_texts(s, d)).select("version", "storage", F.col("messages").alias("total"), F.inline("topics")).select("version", "storage", "topic", "messages", "total")


@query("missing_files", "SELECT 'bag_' || user_id || '.mcap' AS file FROM events GROUP BY user_id")
def _(s, d):
    texts = manifest_texts(s, d)
    return files.missing_files(files.parsed_manifests(texts), texts.select("path")).select(F.regexp_extract("path", "[^/]*$", 0).alias("file"))


@query("available_topics", f"{FLEET} SELECT DISTINCT log_id, topic FROM m")
def _(s, d):
    return catalog.topics(fleet(s, d))


def typed(s, d):
    return catalog.with_type(one(s, d).withColumn("topic", F.concat("topic", F.lit("_"), F.col("message.user_id") % 3)))


@query("type_name", f"{M} SELECT DISTINCT topic || '_' || (user_id % 3) AS topic, topic AS type_name, CAST(user_id % 3 AS VARCHAR) AS multi_id FROM m")
def _(s, d):
    return typed(s, d).select("topic", "type_name", "multi_id").distinct()


@query("topic_counts", f"{FLEET} SELECT log_id, topic, count(*) AS message_count FROM m GROUP BY ALL")
def _(s, d):
    return catalog.topic_counts(fleet(s, d))


GAPS = ", g AS (SELECT *, t - lag(t) OVER (PARTITION BY log_id, topic ORDER BY t, seq) AS latency FROM m)"


@query("topic_frequency", f"{M}{GAPS} SELECT log_id, topic, round(1 / median(latency), 8) AS frequency FROM g GROUP BY ALL")
def _(s, d):
    return catalog.topic_frequency(one(s, d), huge=True).withColumn("frequency", F.round("frequency", 8))


FIELDS = "['event_id', 'user_id', 'value', 'props']"


@query(
    "describe_topic",
    f"SELECT 'click' AS topic, n AS message_count, unnest({FIELDS}) AS \"column\", unnest(['bigint', 'bigint', 'double', 'string']) AS type, NULL::VARCHAR AS description, NULL::VARCHAR AS units, 'float64 click' AS definition FROM (SELECT count(*) AS n FROM events WHERE event_type = 'click')",
)
def _(s, d):
    texts = one(s, d).select("topic", F.concat(F.lit("float64 "), "topic").alias("definition")).distinct()
    return catalog.describe_topic(one(s, d), "click", texts)


@query("describe_source", f"{FLEET} SELECT log_id, count(*) AS total_message_count, min(t) AS start_seconds, max(t) AS end_seconds, max(t) - min(t) AS duration_seconds, array_to_string(list_sort(list(DISTINCT topic)), ',') AS topics FROM m GROUP BY log_id")
def _(s, d):
    return catalog.describe_source(fleet(s, d)).withColumn("topics", F.array_join("topics", ","))


@query("unknown_topics", "SELECT DISTINCT role AS topic FROM conversations WHERE role NOT IN (SELECT event_type FROM events)")
def _(s, d):
    asked = talk_messages(s, d).select("topic").union(one(s, d).select("topic")).distinct()
    return catalog.unknown_topics(one(s, d), asked)


@query("topics_of_type", "SELECT DISTINCT 'events' AS log_id, event_type || '_' || (user_id % 3) AS topic, event_type AS type_name FROM events WHERE event_type = 'click'")
def _(s, d):
    return catalog.topics_of_type(typed(s, d).select("log_id", "topic", "type_name").distinct(), "click")


@query("drop_untimed", f"{M} SELECT topic, count(*) AS n FROM m WHERE topic NOT IN ('signup', 'error') GROUP BY topic")
def _(s, d):
    return catalog.drop_untimed(one(s, d), ["signup", "error"]).groupBy("topic").agg(F.count("*").alias("n"))


@query(
    "field_dictionary",
    "WITH c AS (SELECT count(event_id) AS event_id, count(ts) AS ts, count(user_id) AS user_id, count(event_type) AS event_type, count(value) AS value, count(props) AS props FROM events) "
    "SELECT field, n, CASE field WHEN 'value' THEN 'reading' WHEN 'user_id' THEN 'who' END AS description, CASE field WHEN 'value' THEN 'm' END AS units FROM (UNPIVOT c ON COLUMNS(*) INTO NAME field VALUE n)",
)
def _(s, d):
    named = catalog.annotate(table(s, d, "events"), {"value": {"description": "reading", "units": "m"}, "user_id": {"description": "who"}})
    described = [(f.name, f.metadata.get("description"), f.metadata.get("units")) for f in named.schema.fields]
    words = s.createDataFrame(described, "field string, description string, units string")
    counted = named.agg(*(F.count(c).alias(c) for c in named.columns)).unpivot([], named.columns, "field", "n")
    return counted.join(F.broadcast(words), "field")  # one row a field


@query("field_name_index", "SELECT DISTINCT event_type || '[' || user_id || ']' AS field, event_type AS name, CAST(user_id AS INTEGER) AS idx FROM events")
def _(s, d):
    field = F.concat("event_type", F.lit("["), "user_id", F.lit("]"))
    name, index = C.name_and_index(F.col("field"))
    return table(s, d, "events").select(field.alias("field")).distinct().select("field", name.alias("name"), index.alias("idx"))


#: A message definition for each part: lines with names in braces for a part's values, each line's kind, and
#: its section. Then what its field is: type, string bound, array, array size, name, value, comment.
PART = {"key": "p_partkey", "size": "p_size", "limit": "p_size * 8", "name": "p_name", "brand": "p_brand", "type": "lower(p_type)"}
LINES = [
    ("# part {key}", "comment", 0, None),
    ("Header header", "complex", 0, ("Header", None, "none", None, "header", None, None)),
    ("int32 size {size}", "builtin", 0, ("int32", None, "none", None, "size", "{size}", None)),
    ("uint8 LIMIT={limit}", "constant", 0, ("uint8", None, "none", None, "LIMIT", "{limit}", None)),
    ('string<=12 name "{name}" # name of {brand}', "builtin", 0, ("string", 12, "none", None, "name", '"{name}"', "name of {brand}")),
    ("float64[{size}] prices", "builtin", 0, ("float64", None, "fixed", "p_size", "prices", None, None)),
    ("Place[] places", "complex", 0, ("Place", None, "unbounded", None, "places", None, None)),
    ("Unknown%thing", "invalid", 0, None),
    ("", "empty", 0, None),
    ("int32[0] none", "builtin", 0, ("int32", None, "fixed", 0, "none", None, None)),
    ("string<=0 blank", "builtin", 0, ("string", 0, "none", None, "blank", None, None)),
    ("float32 wide 1e39", "builtin", 0, ("float32", None, "none", None, "wide", "1e39", None)),
    ("int8[<=2] pair [1, 2, {size}]", "builtin", 0, ("int8", None, "bounded", 2, "pair", "[1, 2, {size}]", None)),
    ("geometry_msgs/Point point", "complex", 0, ("geometry_msgs/Point", None, "none", None, "point", None, None)),
    ("Time stamp", "complex", 0, ("Time", None, "none", None, "stamp", None, None)),
    ("std_msgs/Empty nothing", "complex", 0, ("std_msgs/Empty", None, "none", None, "nothing", None, None)),
    ("Lost lost", "complex", 0, ("Lost", None, "none", None, "lost", None, None)),
    ("=" * 20, "separator", 1, None),
    ("MSG: std_msgs/Header", "type", 1, None),
    ("uint32 seq", "builtin", 1, ("uint32", None, "none", None, "seq", None, None)),
    ("=" * 20, "separator", 2, None),
    ("MSG: shop_{type}/Place", "type", 2, None),
    ("float32 x 0.5", "builtin", 2, ("float32", None, "none", None, "x", "0.5", None)),
    ("Shelf shelf", "complex", 2, ("Shelf", None, "none", None, "shelf", None, None)),
    ("=" * 20, "separator", 3, None),
    ("MSG: shop_{type}/Shelf", "type", 3, None),
    ("int16 y", "builtin", 3, ("int16", None, "none", None, "y", None, None)),
    ("=" * 20, "separator", 4, None),
    ("MSG: geometry_msgs/Point", "type", 4, None),
    ("float64 x", "builtin", 4, ("float64", None, "none", None, "x", None, None)),
    ("=" * 20, "separator", 5, None),
    ("MSG: builtin_interfaces/msg/Time", "type", 5, None),
    ("int32 sec", "builtin", 5, ("int32", None, "none", None, "sec", None, None)),
    ("=" * 20, "separator", 6, None),
    ("MSG: std_msgs/msg/Empty", "type", 6, None),
]
SECTIONS = [None, "std_msgs/Header", "shop_{type}/Place", "shop_{type}/Shelf", "geometry_msgs/Point", "builtin_interfaces/msg/Time", "std_msgs/msg/Empty"]


def in_sql(template) -> str:
    """A template, a number or None as SQL over ``part``."""
    if template is None or isinstance(template, int):
        return "NULL" if template is None else str(template)
    parts = re.split(r"[{}]", template)
    return " || ".join(PART[x].join("()") if i % 2 else f"'{x}'" for i, x in enumerate(parts) if x or len(parts) == 1)


def lines_sql(rows: list[tuple], columns: list[str]) -> str:
    """Rows of templates for each part: ``text_id`` and the columns."""
    values = ", ".join("{" + ", ".join(f"'{c}': {v}" for c, v in zip(columns, row)) + "}" for row in rows)
    return f"SELECT text_id, unnest(x, recursive := true) FROM (SELECT CAST(p_partkey AS VARCHAR) AS text_id, unnest([{values}]) AS x FROM part)"


def numbered_lines(*more: Callable[[tuple], str]) -> list[tuple]:
    return [(f"{i}::INTEGER", in_sql(x[0]), f"'{x[1]}'", *(f(x) for f in more)) for i, x in enumerate(LINES)]


def section_sql(x: tuple) -> str:
    return f"{in_sql(SECTIONS[x[2]])}::VARCHAR"


def definition_texts(s, d):
    """The part's definition as text."""
    line = lambda t: F.concat(*(F.expr(PART[x]).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(re.split(r"[{}]", t))))
    # The table may be one small group of rows, of which each becomes 36 lines.
    parts = table(s, d, "part").repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return parts.select(F.col("p_partkey").cast("string").alias("text_id"), F.concat_ws("\n", *(line(x[0]) for x in LINES)).alias("text"))


def definition_sections(s, d):
    return definitions.sectioned_texts(definition_texts(s, d))


def definition_fields(s, d):
    return definitions.definition_fields(definition_sections(s, d))


@query("definition_lines", lines_sql(numbered_lines(), ["line_no", "line", "kind"]))
def _(s, d):
    return definitions.definition_lines(definition_texts(s, d))


@query("definition_sections", lines_sql(numbered_lines(lambda x: f"{x[2]}::INTEGER", section_sql), ["line_no", "line", "kind", "section", "section_type"]))
def _(s, d):
    return definition_sections(s, d).drop("known")


FIELD_COLUMNS = {"type": "VARCHAR", "string_bound": "BIGINT", "array": "VARCHAR", "array_size": "BIGINT", "name": "VARCHAR", "value": "VARCHAR", "comment": "VARCHAR"}


def field_sql(x: tuple) -> list[str]:
    raw = ("array_size",)
    return [f"({v if c in raw and isinstance(v, str) else in_sql(v)})::{kind}" for v, (c, kind) in zip(x[3], FIELD_COLUMNS.items())]


FIELD_ROWS = [(f"{i}::INTEGER", f"'{x[1]}'", f"{x[2]}::INTEGER", section_sql(x), *field_sql(x)) for i, x in enumerate(LINES) if x[3]]


@query("definition_fields", lines_sql(FIELD_ROWS, ["line_no", "kind", "section", "section_type", *FIELD_COLUMNS]))
def _(s, d):
    return definition_fields(s, d)


def line_no(start: str) -> int:
    return next(i for i, x in enumerate(LINES) if x[0].startswith(start))


def error_sql(start: str, name: str, error: str, where: str = "true") -> str:
    return f"SELECT CAST(p_partkey AS VARCHAR) AS text_id, {line_no(start)} AS line_no, '{name}' AS name, '{error}' AS error FROM part WHERE {where}"


@query(
    "definition_errors",
    " UNION ALL ".join(
        [
            error_sql("uint8", "LIMIT", "integer out of range", "p_size * 8 > 255"),
            error_sql("string<=12", "name", "string longer than its bound", "length(p_name) > 12"),
            error_sql("int32[0]", "none", "array size must be above 0"),
            error_sql("string<=0", "blank", "string bound must be above 0"),
            error_sql("float32 wide", "wide", "float32 out of range"),
            error_sql("int8", "pair", "default has the wrong length"),
        ]
    ),
)
def _(s, d):
    return definitions.definition_errors(definition_fields(s, d))


def resolve_sql(name: str, target: str, rule: str) -> str:
    return f"SELECT CAST(p_partkey AS VARCHAR) AS text_id, '{name}' AS type, {target} AS target, {rule} AS rule FROM part"


@query(
    "definition_resolve",
    " UNION ALL ".join(
        [
            resolve_sql("geometry_msgs/Point", "'geometry_msgs/Point'", "1"),
            resolve_sql("Header", "'std_msgs/Header'", "2"),
            resolve_sql("Time", "'builtin_interfaces/msg/Time'", "3"),
            resolve_sql("std_msgs/Empty", "'std_msgs/msg/Empty'", "4"),
            resolve_sql("Shelf", "'shop_' || lower(p_type) || '/Shelf'", "5"),
            resolve_sql("Place", "'shop_' || lower(p_type) || '/Place'", "6"),
            resolve_sql("Lost", "NULL", "NULL"),
        ]
    ),
)
def _(s, d):
    return definitions.resolve_texts(definition_sections(s, d)).select("text_id", "type", "target", "rule")


LEAVES = [
    ("header.seq", "seq", "bigint"), ("size", "size", "int"), ("LIMIT", "LIMIT", "smallint"), ("name", "name", "string"), ("prices", "prices", "array<double>"), ("places", "places", "array<struct<x:float,shelf:struct<y:smallint>>>"),
    ("none", "none", "array<int>"), ("blank", "blank", "string"), ("wide", "wide", "float"), ("pair", "pair", "array<tinyint>"), ("point.x", "x", "double"), ("stamp.sec", "sec", "int"),
]


@query(
    "definition_schema",
    f"WITH f AS ({lines_sql(FIELD_ROWS, ['line_no', 'kind', 'section', 'section_type', *FIELD_COLUMNS])}), k AS (SELECT name, count(*) AS n FROM f GROUP BY name) "
    "SELECT path, name, leaf_type, n FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS path, '{b}' AS name, '{c}' AS leaf_type" for a, b, c in LEAVES) + ") LEFT JOIN k USING (name)",
)
def _(s, d):
    """The schema of the first part's definition without what can't be resolved, and how many fields of all
    parts have each leaf's name."""
    fields = definition_fields(s, d)
    resolved = definitions.resolve_texts(definition_sections(s, d))
    sound = fields.join(resolved.filter("target IS NULL").select("text_id", "line_no"), ["text_id", "line_no"], "left_anti")
    schema = definitions.to_struct(sound, resolved, "1")
    leaves = s.createDataFrame([(p, p.rpartition(".")[2], k) for p, k in catalog.field_rows(schema)], "path string, name string, leaf_type string")
    return leaves.join(fields.groupBy("name").agg(F.count("*").alias("n")), "name", "left").select("path", "name", "leaf_type", "n")


@query("definition_lookup", "SELECT event_type AS topic, event_type AS type_name, user_id AS version, CASE WHEN user_id % 2 = 0 THEN 'float64 x' END AS definition FROM events GROUP BY ALL")
def _(s, d):
    asked = table(s, d, "events").select(F.col("event_type").alias("topic"), F.col("event_type").alias("type_name"), F.col("user_id").alias("version")).distinct()
    text = [F.lit("msg/versioned"), F.lit("msg")]
    known = asked.filter("version % 2 = 0").select("version", F.explode(F.array(*text)).alias("folder"), F.concat(definitions.camel_case(F.col("type_name")), F.lit(".msg")).alias("file"))
    return definitions.lookup_definition(asked, known.withColumn("text", F.when(F.col("folder") == "msg", "float64 x").otherwise("float32 x")))


@query(
    "topic_text",
    f"WITH f AS ({lines_sql(FIELD_ROWS, ['line_no', 'kind', 'section', 'section_type', *FIELD_COLUMNS])}) "
    "SELECT text_id AS topic, '# ' || text_id || chr(10) || string_agg(type || ' ' || name || coalesce(' # ' || comment, ''), chr(10) ORDER BY line_no) AS text FROM f GROUP BY text_id",
)
def _(s, d):
    f = definition_fields(s, d)
    return catalog.describe_text(f.select(F.col("text_id").alias("topic"), F.col("line_no").alias("position"), "type", "name", F.col("comment").alias("description")))


VERSIONS = {0: "int32 event_id\nfloat32 value", 1: "int64 event_id\nfloat64 value\nint16 user_id", 2: "int64 event_id\nfloat64 value\nint32 user_id\nProps props\n===\nMSG: pkg/Props\nint32 k"}


def versioned(s, d) -> tuple[DataFrame, DataFrame]:
    """Events as JSON payloads of logs with three versions of their types, and the definitions."""
    v, by = F.col("user_id") % 3, "user_id"
    props = F.from_json("props", "k int")
    payload = F.when(v == 0, F.to_json(F.struct("event_id", "value"))).when(v == 1, F.to_json(F.struct("event_id", "value", by))).otherwise(F.to_json(F.struct("event_id", "value", by, props.alias("props"))))
    made = table(s, d, "events").select(
        F.concat(F.lit("user_"), F.col(by)).alias("log_id"), F.col("event_type").alias("topic"), F.col("event_id").alias("seq"), C.seconds_of(F.col("ts")).alias("timestamp_seconds"), payload.alias("text")
    )
    known = F.array(*(F.struct(F.lit(v).alias("version"), F.lit(t).alias("text")) for v, t in VERSIONS.items()))
    topics = table(s, d, "events").select(F.col("event_type").alias("topic")).distinct()
    return versions.json_payloads(made, F.col("text")), topics.select("topic", F.inline(known))


VERSIONED = "SELECT event_type AS topic, user_id % 3 AS version, event_id, value, CASE WHEN user_id % 3 > 0 THEN user_id END AS user_id, CASE WHEN user_id % 3 = 2 THEN CAST(json_extract(props, '$.k') AS INT) END AS k, epoch_us(ts)/1e6 AS t FROM events"


@query("versions_sql", f"SELECT count(*) AS n, count(user_id) AS users, count(k) AS ks, sum(k)::BIGINT AS total, round(sum(value), 2) AS value FROM ({VERSIONED}) WHERE topic = 'click' AND t BETWEEN {T0 + DAY} AND {T0 + 9 * DAY}")
def _(s, d):
    """SQL over one topic whose logs have three versions of its type."""
    sql = "SELECT count(*) AS n, count(click.user_id) AS users, count(click.props.k) AS ks, sum(click.props.k) AS total, round(sum(click.value), 2) AS value FROM click"
    return versions.query_versions(*versioned(s, d), sql, ["click"], T0 + DAY, T0 + 9 * DAY)


@query("versions_wide", f"SELECT event_id AS seq, CASE WHEN topic = 'click' THEN event_id END AS click, CASE WHEN topic = 'view' THEN k END AS \"view\" FROM ({VERSIONED}) WHERE topic IN ('click', 'view')")
def _(s, d):
    return versions.wide_versions(*versioned(s, d), ["click", "view"]).select("seq", F.col("click.event_id").alias("click"), F.col("view.props.k").alias("view"))


# The message relation


@query("topic_relation", f"{M} SELECT log_id, seq, t AS timestamp_seconds, value FROM m WHERE topic = 'click'")
def _(s, d):
    return relation.topic_relation(one(s, d), "click").select("log_id", "seq", "timestamp_seconds", "click.value")


@query("wide_relation", f"{M} SELECT log_id, seq, t AS timestamp_seconds, CASE WHEN topic = 'click' THEN value END AS click, CASE WHEN topic = 'view' THEN value END AS \"view\" FROM m WHERE topic IN ('click', 'view')")
def _(s, d):
    w = relation.wide(one(s, d), ["click", "view"])
    return w.select("log_id", "seq", "timestamp_seconds", F.col("click.value").alias("click"), F.col("view.value").alias("view"))


def ffill_sql(base: str) -> str:
    last = "last_value({0} IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    parts = ", ".join(f"{last.format(f"CASE WHEN topic = '{x}' THEN value END")} AS \"{x}\"" for x in ("click", "error", "view"))
    return f"{base} SELECT log_id, seq, t AS timestamp_seconds, {parts} FROM m WHERE topic IN ('click', 'error', 'view')"


def filled(messages: DataFrame, huge: bool) -> DataFrame:
    df = relation.ffill(relation.wide(messages, ["click", "error", "view"]), huge)
    return df.select("log_id", "seq", "timestamp_seconds", *(F.col(f"`{c}`.value").alias(c) for c in ("click", "error", "view")))


@query("ffill", ffill_sql(FLEET))
def _(s, d):
    return filled(fleet(s, d), False)


@query("ffill_huge_log", ffill_sql(M))
def _(s, d):
    return filled(one(s, d), True)


@query(
    "wide_typed",
    f"{M} SELECT log_id, seq, t AS timestamp_seconds, CASE WHEN topic = 'click' THEN value END AS click_value, CASE WHEN topic = 'view' THEN user_id END AS view_user, CASE WHEN topic = 'view' THEN props END AS view_props FROM m WHERE topic IN ('click', 'view')",
)
def _(s, d):
    schemas = {"click": F.struct("message.value"), "view": F.struct("message.user_id", "message.props")}
    made = relation.wide_typed({t: one(s, d).filter(F.col("topic") == t).withColumn("message", m) for t, m in schemas.items()})
    return made.select("log_id", "seq", "timestamp_seconds", F.col("click.value").alias("click_value"), F.col("view.user_id").alias("view_user"), F.col("view.props").alias("view_props"))


@query("time_window", f"{M} SELECT topic, count(*) AS n, min(t) AS low, max(t) AS high FROM m WHERE t BETWEEN {T0 + DAY} AND {T0 + 5 * DAY} GROUP BY topic")
def _(s, d):
    t = F.col("timestamp_seconds")
    return event_messages(s, d, lo=T0 + DAY, hi=T0 + 5 * DAY).groupBy("topic").agg(F.count("*").alias("n"), F.min(t).alias("low"), F.max(t).alias("high"))


@query("empty_relation", f"{M} SELECT log_id, seq, t AS timestamp_seconds, value AS click FROM m WHERE false")
def _(s, d):
    made = relation.empty(relation.wide(one(s, d), ["click", "view"]))
    return made.select("log_id", "seq", "timestamp_seconds", F.col("click.value").alias("click"))


@query("merged_order", f"{M} SELECT log_id, topic, seq, row_number() OVER (ORDER BY t, topic, seq) - 1 AS row_index FROM m WHERE topic IN ('click', 'view')")
def _(s, d):
    frames = [one(s, d).filter(F.col("topic") == t).drop("message") for t in ("click", "view")]
    return row_index(relation.merge_topics(frames), ["log_id"], ["timestamp_seconds", "topic", "seq"], huge=True).select("log_id", "topic", "seq", "row_index")


@query("fill_defaults", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 7 AS z, NULL::DOUBLE AS y FROM events")
def _(s, d):
    kind = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("z", T.IntegerType(), True, {"default": "7"}), T.StructField("y", T.DoubleType(), True, {"present": False})])
    df = table(s, d, "events").select("event_id", F.from_json("props", "k int, z int").alias("p"))
    return df.select("event_id", relation.fill_defaults(F.col("p"), kind).alias("p")).select("event_id", "p.*")


@query("text_to_codes", "SELECT DISTINCT p_name, array_to_string(list_transform(string_split(p_name, ''), lambda x: unicode(x)), ',') AS codes FROM part")
def _(s, d):
    return table(s, d, "part").select("p_name", F.array_join(C.text_to_codes(F.col("p_name")), ",").alias("codes")).distinct()


@query("positional_record", "SELECT p_partkey, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, string_split(p_name, ' ')[3] AS c FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", C.positional(F.split("p_name", " "), ["a", "b", "c"]).alias("r")).select("p_partkey", "r.*")


@query("nested_convert", "SELECT event_id, CAST(trunc(value) AS INTEGER) AS first, CAST(user_id AS INTEGER) AS second FROM events")
def _(s, d):
    kind = T.ArrayType(T.StructType([T.StructField("v", T.IntegerType())]))
    arr = F.array(F.struct(F.col("value").alias("v"), F.col("event_id").alias("x")), F.struct(F.col("user_id").cast("double").alias("v"), F.col("event_id").alias("x")))
    return table(s, d, "events").select("event_id", relation.converted(arr, kind).alias("a")).select("event_id", F.col("a")[0]["v"].alias("first"), F.col("a")[1]["v"].alias("second"))


@query("flatten_topic", f"{M} SELECT log_id, seq, t AS timestamp_seconds, event_id AS click_event_id, user_id AS click_user_id, value AS click_value, props AS click_props FROM m WHERE topic = 'click'")
def _(s, d):
    return relation.flatten(relation.topic_relation(one(s, d), "click"))


@query("materialise", f"{M} SELECT log_id, count(*) AS n FROM m WHERE topic IN ('click', 'view') GROUP BY log_id")
def _(s, d):
    listed = files.listing(s, f"{d}/events.parquet").select(F.lit("events").alias("log_id"), "path")
    content = files.content_uuid(listed).first()["content_uuid"]
    made = relation.materialise(relation.wide(one(s, d), ["click", "view"]), content, "click,view", "None", "None", "False")
    return made.groupBy("log_id").agg(F.count("*").alias("n"))


# Loggings


@query("loggings", f"{M} SELECT log_id, t AS timestamp_seconds, topic, value FROM m WHERE topic = 'error' AND t <= {T0 + 9 * DAY}")
def _(s, d):
    known = one(s, d).select("log_id", "topic", F.when(F.col("topic") == "error", "MSG").otherwise("data").alias("type_name")).distinct()
    return flat(loggings.loggings(one(s, d), known, "MSG", hi=T0 + 9 * DAY)).drop("seq")


def leveled(s, d):
    return one(s, d).filter("topic = 'error'").select("log_id", "timestamp_seconds", C.severity(value()).alias("log_level"), F.col("message.props").alias("message"))


LEVEL = "CASE WHEN value < 20 THEN 'INFO' WHEN value < 60 THEN 'WARN' ELSE 'ERROR' END"


@query("leveled_loggings", f"{M} SELECT t AS timestamp_seconds, {LEVEL} AS log_level, props AS message FROM m WHERE topic = 'error' AND t >= {T0} AND t < {T0 + 9 * DAY}")
def _(s, d):
    return loggings.leveled_loggings(leveled(s, d), T0, T0 + 9 * DAY).select("timestamp_seconds", "message.*")


@query("log_levels", f"{M} SELECT {LEVEL} AS log_level, count(*) AS n FROM m WHERE topic = 'error' AND {LEVEL} IN ('WARN', 'ERROR') GROUP BY 1")
def _(s, d):
    return loggings.by_level(leveled(s, d), ["WARN", "ERROR"])


@query("logging_support", "SELECT 'user_' || user_id AS log_id, CASE WHEN user_id % 2 = 0 THEN 'px4.ulg' ELSE 'betaflight.bbl' END AS format, user_id % 2 = 0 AS has_loggings FROM events GROUP BY user_id")
def _(s, d):
    logs = fleet(s, d).select("log_id", F.when(F.col("message.user_id") % 2 == 0, "px4.ulg").otherwise("betaflight.bbl").alias("format")).distinct()
    return loggings.logging_support(logs)


# Questions about a topic


@query("sql_topic", f"{M} SELECT round(avg(value), 4) AS avg_value, count(*) AS n FROM m WHERE topic = 'click' AND t >= {T0 + DAY}")
def _(s, d):
    return analysis.query(one(s, d), "SELECT round(avg(click.value), 4) AS avg_value, count(*) AS n FROM click", ["click"], lo=T0 + DAY)


@query("sql_two_topics", f"{M} SELECT c.user_id, count(*) AS n FROM m c JOIN m p ON c.user_id = p.user_id AND p.topic = 'purchase' WHERE c.topic = 'click' GROUP BY c.user_id")
def _(s, d):
    sql = "SELECT click.user_id, count(*) AS n FROM click JOIN purchase ON click.user_id = purchase.user_id GROUP BY click.user_id"
    return analysis.query(one(s, d), sql, ["click", "purchase"])


@query("time_bins", f"{M} SELECT log_id, topic, CAST(floor(t / 3600) AS BIGINT) AS bin, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high, count(*) AS n FROM m GROUP BY ALL")
def _(s, d):
    return analysis.time_bins(one(s, d), value(), 3600.0).withColumn("mean", R4(F.col("mean")))


NTH = ", r AS (SELECT *, row_number() OVER (PARTITION BY log_id, topic ORDER BY t, seq) - 1 AS i FROM m) SELECT log_id, topic, seq FROM r WHERE i % 10 = 0"


@query("every_nth", FLEET + NTH)
def _(s, d):
    return analysis.every_nth(fleet(s, d), 10).select("log_id", "topic", "seq")


@query("every_nth_huge_log", M + NTH)
def _(s, d):
    return analysis.every_nth(one(s, d), 10, huge=True).select("log_id", "topic", "seq")


@query("field_summary", f"{M} SELECT log_id, topic, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high, count(value) AS n, round(median(value), 4) AS middle, round(stddev(value), 4) AS spread FROM m GROUP BY ALL")
def _(s, d):
    made = analysis.summarise(one(s, d), value())
    return made.withColumns({c: R4(F.col(c)) for c in ("mean", "middle", "spread")})


WINDOW = f"{M} SELECT count(*) AS n, round(avg(value), 6) AS mean, max(seq) AS last FROM m WHERE topic = 'click' AND t BETWEEN {T0 + 5 * DAY} AND {T0 + 6 * DAY}"


@query("sql_window_clustered", WINDOW)
def _(s, d):
    """A window's question to a table of many files, which opens those of the window."""
    known = clustered.MessageTable(s, new_folder(s, "clustered"))
    known.write(one(s, d), file_rows=500)
    sql = "SELECT count(*) AS n, round(avg(click.value), 6) AS mean, max(seq) AS last FROM click"
    return analysis.query(known, sql, ["click"], lo=T0 + 5 * DAY, hi=T0 + 6 * DAY)


@query("field_summary_huge_log", ORACLE_SQL["field_summary"])
def _(s, d):
    made = analysis.summarise(one(s, d), value(), huge=True)
    return made.withColumns({c: R4(F.col(c)) for c in ("mean", "middle", "spread")})


@query("quantiles_huge_log", f"{M} SELECT log_id, topic, round(quantile_cont(value, 0.05), 4) AS low, round(quantile_cont(value, 0.5), 4) AS middle, round(quantile_cont(value, 0.99), 4) AS high FROM m GROUP BY ALL")
def _(s, d):
    """By selection in every topic, as none is held whole."""
    made = quantiles.exact_quantiles(one(s, d), ["log_id", "topic"], value(), [0.05, 0.5, 0.99], limit=100)
    return made.select("log_id", "topic", *(F.round(F.get("quantiles", F.lit(i)), 4).alias(c) for i, c in enumerate(("low", "middle", "high"))))


@query("latency", f"{FLEET}{GAPS} SELECT log_id, topic, seq, round(latency, 4) AS latency FROM g")
def _(s, d):
    return catalog.gaps(fleet(s, d)).select("log_id", "topic", "seq", R4(F.col("latency")).alias("latency"))


@query("latency_huge_log", f"{M}{GAPS} SELECT log_id, topic, seq, round(latency, 4) AS latency FROM g")
def _(s, d):
    return catalog.gaps(one(s, d), huge=True).select("log_id", "topic", "seq", R4(F.col("latency")).alias("latency"))


@query("latency_stats", f"{M}{GAPS} SELECT log_id, topic, round(min(latency), 3) AS low, round(max(latency), 3) AS high, round(avg(latency), 3) AS mean, round(median(latency), 3) AS middle, round(stddev(latency), 3) AS spread FROM g GROUP BY ALL")
def _(s, d):
    made = analysis.latency_stats(one(s, d), huge=True)
    return made.withColumns({c: F.round(c, 3) for c in ("low", "high", "mean", "middle", "spread")})


@query("rate_class", f"{M}{GAPS} SELECT log_id, topic, round(1 / avg(latency), 8) AS frequency, CASE WHEN stddev(latency) / avg(latency) <= 1.0 THEN 'fixed' ELSE 'event' END AS kind FROM g GROUP BY ALL")
def _(s, d):
    return analysis.rate_class(one(s, d), 1.0, huge=True).withColumn("frequency", F.round("frequency", 8))


@query("latency_anomalies", f"{M}{GAPS}, x AS (SELECT *, avg(latency) OVER (PARTITION BY topic) + 3 * stddev(latency) OVER (PARTITION BY topic) AS lim FROM g) SELECT topic, seq FROM x WHERE latency > lim")
def _(s, d):
    return analysis.latency_anomalies(one(s, d), 3.0, huge=True).select("topic", "seq")


@query("field_corr", f"{M} SELECT log_id, topic, round(corr(value, user_id), 6) AS correlation FROM m GROUP BY ALL")
def _(s, d):
    return analysis.correlate(one(s, d), value(), F.col("message.user_id").cast("double")).withColumn("correlation", F.round("correlation", 6))


SUDDEN = ", x AS (SELECT *, abs(value - lag(value) OVER w) / nullif(t - lag(t) OVER w, 0) AS slope FROM m WINDOW w AS (PARTITION BY log_id, topic ORDER BY t, seq)) SELECT log_id, topic, seq FROM x WHERE slope > 0.01"


@query("sudden_change", FLEET + SUDDEN)
def _(s, d):
    return analysis.sudden_change(fleet(s, d), value(), 0.01).select("log_id", "topic", "seq")


@query("sudden_change_huge_log", M + SUDDEN)
def _(s, d):
    return analysis.sudden_change(one(s, d), value(), 0.01, huge=True).select("log_id", "topic", "seq")


EXCURSIONS = ", x AS (SELECT *, sum(CASE WHEN value > 40 THEN 0 ELSE 1 END) OVER (PARTITION BY log_id, topic ORDER BY t, seq) AS run FROM m) SELECT log_id, topic, min(t) AS start_seconds, max(t) AS end_seconds, count(*) AS n, max(value) AS peak FROM x WHERE value > 40 GROUP BY log_id, topic, run"


@query("excursions", FLEET + EXCURSIONS)
def _(s, d):
    return analysis.excursions(fleet(s, d), value(), 40.0)


@query("excursions_huge_log", M + EXCURSIONS)
def _(s, d):
    return analysis.excursions(one(s, d), value(), 40.0, huge=True)


@query("topic_parity", f"{FLEET} SELECT log_id, count(DISTINCT topic) AS topics, CASE WHEN count(DISTINCT topic) % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM m GROUP BY log_id")
def _(s, d):
    return analysis.topic_parity(fleet(s, d))


# Ticks, lookback, gates


def clicks(df: DataFrame) -> DataFrame:
    return df.filter(F.col("topic") == "click")


@query("cadence_end", f"{FLEET} SELECT log_id, 0::BIGINT AS tick_no, max(t) AS asof_seconds FROM m WHERE topic = 'click' GROUP BY log_id")
def _(s, d):
    return ticks.ticks_at_end(clicks(fleet(s, d)))


FRAME_TICKS = ", k AS (SELECT log_id, (row_number() OVER (PARTITION BY log_id ORDER BY t, seq) - 1) AS i, t FROM m WHERE topic = 'click'), ticks AS (SELECT log_id, i // 50 AS tick_no, t AS upto FROM k WHERE i % 50 = 0)"


def frame_ticks(s, d):
    return ticks.ticks_every_frames(clicks(one(s, d)), 50, huge=True)


@query("cadence_frames", f"{M}{FRAME_TICKS} SELECT log_id, tick_no, upto AS asof_seconds FROM ticks")
def _(s, d):
    return frame_ticks(s, d)


@query(
    "cadence_seconds",
    f"{FLEET}, c AS (SELECT log_id, t FROM m WHERE topic = 'click'), g AS (SELECT log_id, 0::BIGINT AS tick_no, min(t) AS asof_seconds FROM c GROUP BY log_id "
    "UNION ALL SELECT * FROM (SELECT g.log_id, g.tick_no + 1, min(c.t) AS n FROM g JOIN c ON c.log_id = g.log_id AND c.t - g.asof_seconds >= 86400 GROUP BY g.log_id, g.tick_no)) SELECT * FROM g",
)
def _(s, d):
    return ticks.ticks_every_seconds(clicks(fleet(s, d)), C.to_seconds(24, "hour"))


@query(
    "cadence_seconds_huge_log",
    f"{M}, c AS (SELECT log_id, t FROM m), g AS (SELECT log_id, 0::BIGINT AS tick_no, min(t) AS asof_seconds FROM c GROUP BY log_id "
    "UNION ALL SELECT * FROM (SELECT g.log_id, g.tick_no + 1, min(c.t) AS n FROM g JOIN c ON c.log_id = g.log_id AND c.t - g.asof_seconds >= 3600 GROUP BY g.log_id, g.tick_no)) SELECT * FROM g",
)
def _(s, d):
    return ticks.ticks_every_seconds(one(s, d), 3600.0, huge=True)


@query("lookback_time", f"{M}{FRAME_TICKS} SELECT ticks.log_id, tick_no, m.topic, count(*) AS n, round(sum(value), 4) AS total FROM ticks JOIN m ON m.t BETWEEN upto - 7200 AND upto GROUP BY ALL")
def _(s, d):
    seen = lookback.lookback_time(one(s, d), frame_ticks(s, d), C.to_seconds(2, "hour"))
    return seen.groupBy("log_id", "tick_no", "topic").agg(F.count("*").alias("n"), R4(F.sum(value())).alias("total"))


LAST_ROWS = "SELECT tick_no, seq, value, topic, t, row_number() OVER (PARTITION BY tick_no ORDER BY t DESC, seq DESC) AS back FROM ticks JOIN m ON m.t <= upto"


DENSE = ", k AS (SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY t, seq) - 1 AS i, t FROM m), ticks AS (SELECT log_id, i // 10 AS tick_no, t AS upto FROM k WHERE i % 10 = 0)"


def dense_ticks(s, d):
    """A tick every ten messages, for lookbacks that overlap a lot."""
    return ticks.ticks_every_frames(one(s, d), 10, huge=True)


@query(
    "lookback_overlap_huge_log",
    f"{M}{DENSE} SELECT tick_no, count(*) AS n, round(sum(value), 2) AS total, min(value) AS low, max(value) AS high, round(stddev(value), 4) AS spread, arg_max(seq, struct_pack(t := t, s := seq)) AS last, "
    "bool_or(value > 99) AS some FROM ticks JOIN m ON m.t BETWEEN upto - 172800 AND upto GROUP BY tick_no",
)
def _(s, d):
    made = {
        "n": panes.count(), "total": panes.total(value()), "low": panes.low(value()), "high": panes.high(value()), "spread": panes.spread(value(), about=50.0),
        "last": panes.newest(F.col("seq")), "some": panes.any_of(value() > 99),
    }
    found = panes.aggregate_time(one(s, d), dense_ticks(s, d), 2 * DAY, made, huge=True)
    return found.drop("log_id", "asof_seconds").withColumns({"total": F.round("total", 2), "spread": F.round("spread", 4)})


@query("asof_overlap_huge_log", f"{M}{DENSE} SELECT tick_no, count(*) AS n, max(value) AS high FROM ticks JOIN m ON m.t <= upto GROUP BY tick_no")
def _(s, d):
    return panes.aggregate_time(one(s, d), dense_ticks(s, d), None, {"n": panes.count(), "high": panes.high(value())}, huge=True).drop("log_id", "asof_seconds")


@query("frames_overlap", f"{M}{DENSE}, r AS (SELECT *, row_number() OVER (ORDER BY t, seq) AS j FROM m), h AS (SELECT tick_no, max(j) AS j FROM ticks JOIN r ON r.t <= upto GROUP BY tick_no) SELECT tick_no, count(*) AS n, max(value) AS high FROM h JOIN r ON r.j > h.j - 500 AND r.j <= h.j GROUP BY tick_no")
def _(s, d):
    return panes.aggregate_frames(one(s, d), dense_ticks(s, d), 500, {"n": panes.count(), "high": panes.high(value())}, huge=True).drop("log_id", "asof_seconds")


@query("lookback_frames", f"{M}{FRAME_TICKS}, x AS ({LAST_ROWS}) SELECT tick_no, seq FROM x WHERE back <= 10")
def _(s, d):
    return lookback.lookback_frames(one(s, d), frame_ticks(s, d), 10, huge=True).select("tick_no", "seq")


@query("asof_all", f"{M}{FRAME_TICKS} SELECT tick_no, count(*) AS n, round(sum(value), 2) AS total, max(value) AS high FROM ticks JOIN m ON m.t <= upto GROUP BY tick_no")
def _(s, d):
    return lookback.asof_all(one(s, d), frame_ticks(s, d), value(), huge=True).select("tick_no", "n", F.round("total", 2).alias("total"), "high")


@query("lookback_ffill", f"{ffill_sql(M).replace('SELECT log_id, seq, t AS', FRAME_TICKS + ', f AS (SELECT log_id, seq, t AS', 1)}) SELECT tick_no, f.seq, f.click, f.\"view\" FROM ticks JOIN f ON f.timestamp_seconds BETWEEN upto - 3600 AND upto")
def _(s, d):
    seen = lookback.lookback_time(filled(one(s, d), True), frame_ticks(s, d), 3600.0)
    return seen.select("tick_no", "seq", "click", "view")


def error_gate(s, d, t: DataFrame) -> DataFrame:
    errors = one(s, d).filter("topic = 'error'")
    return gates.sql_gate(t, errors, F.count("*") >= 2, 7200.0)


GATE = "SELECT ticks.log_id, tick_no, upto AS asof_seconds, count(m.t) >= 2 AS passed FROM ticks LEFT JOIN m ON m.topic = 'error' AND m.t BETWEEN upto - 7200 AND upto GROUP BY ALL"


@query("sql_gate", f"{M}{FRAME_TICKS} {GATE}")
def _(s, d):
    return error_gate(s, d, frame_ticks(s, d))


@query("sql_gate_lateral", f"{M}{FRAME_TICKS} {GATE}")
def _(s, d):
    errors = one(s, d).filter("topic = 'error'")
    return gates.sql_gate_statement(frame_ticks(s, d), errors, "SELECT count(*) >= 2 FROM {window}", 7200.0)


@query("sql_gate_overlap", f"{M}{DENSE} SELECT tick_no, coalesce(count(m.t) >= 40 AND max(value) > 98, false) AS passed FROM ticks LEFT JOIN m ON m.topic = 'error' AND m.t BETWEEN upto - 86400 AND upto GROUP BY tick_no")
def _(s, d):
    errors = one(s, d).filter("topic = 'error'")
    many = panes.Condition({"n": panes.count(), "high": panes.high(value())}, F.coalesce((F.col("n") >= 40) & (F.col("high") > 98), F.lit(False)))
    return gates.sql_gate(dense_ticks(s, d), errors, many, DAY, huge=True).select("tick_no", "passed")


def purchase_gate(s, d, t: DataFrame) -> DataFrame:
    return gates.sql_gate(t, one(s, d).filter("topic = 'purchase'"), F.coalesce(F.max(value()) > 50, F.lit(False)), 3600.0)


PASSED = f", p AS ({GATE}), q AS (SELECT tick_no, coalesce(max(value) > 50, false) AS passed FROM ticks LEFT JOIN m ON m.topic = 'purchase' AND m.t BETWEEN upto - 3600 AND upto GROUP BY tick_no)"


@query("gate_and", f"{M}{FRAME_TICKS}{PASSED} SELECT p.log_id, p.tick_no, asof_seconds FROM p JOIN q ON p.tick_no = q.tick_no WHERE p.passed AND q.passed")
def _(s, d):
    return gates.gate_and(frame_ticks(s, d), [lambda t: error_gate(s, d, t), lambda t: purchase_gate(s, d, t)])


DETECTED = (
    "WITH x AS (SELECT l_orderkey AS frame, l_returnflag AS label, l_discount * 10 AS score, l_extendedprice AS c, min(l_extendedprice) OVER w AS lo, max(l_extendedprice) OVER w AS hi FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)), "
    "y AS (SELECT *, CASE WHEN hi > lo THEN (c - lo) / (hi - lo) ELSE 0 END AS near FROM x), z AS (SELECT *, median(near) OVER (PARTITION BY frame) AS lim FROM y) "
    "SELECT frame, bool_or({} score >= 0.5 AND near >= lim) AS passed FROM z GROUP BY frame"
)


def detections(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_returnflag").alias("label"), (F.col("l_discount") * 10).alias("score"), F.col("l_extendedprice").alias("closeness"))


@query("detection_gate_all_labels", DETECTED.format(""))
def _(s, d):
    return gates.detection_gate(detections(s, d), None, 0.5)


@query(
    "detection_gate",
    DETECTED.format("label IN ('A', 'R') AND"),
)
def _(s, d):
    return gates.detection_gate(detections(s, d), ["A", "R"], 0.5)


@query("run_log", f"{M}{FRAME_TICKS} SELECT log_id, tick_no, asof_seconds, CASE WHEN passed THEN 'executed' ELSE 'skipped' END AS status FROM ({GATE})")
def _(s, d):
    p = Pipeline("watch", "click", Every(50, "frame"), None, {"errors": lambda t: error_gate(s, d, t)}, {"note": lambda t: tasks.alert_task(t, "x", "y")})
    return p.run(one(s, d), frame_ticks(s, d))[1].drop("error")


def failing(t: DataFrame) -> DataFrame:
    """A task that fails at every 40th tick from the 8th on."""
    return t.withColumn("error", F.when(F.col("tick_no") % 40 == 7, "no file"))


FAILING = "CASE WHEN tick_no % 40 = 7 AND passed THEN 'failed' WHEN passed THEN 'executed' ELSE 'skipped' END AS status, CASE WHEN tick_no % 40 = 7 AND passed THEN 'no file' END AS error"
HALVES = ", p AS (SELECT log_id, tick_no, upto, tick_no % 3 > 0 AS passed FROM ticks)"


def failing_pipeline(allow: bool) -> Pipeline:
    third = {"third": lambda t: t.withColumn("passed", F.col("tick_no") % 3 > 0)}
    return Pipeline("watch", "click", Every(50, "frame"), None, third, {"fetch": failing, "note": lambda t: tasks.alert_task(t, "x", "y")}, allow)


@query("run_log_failed", f"{M}{FRAME_TICKS}{HALVES} SELECT log_id, tick_no, upto AS asof_seconds, {FAILING} FROM p WHERE tick_no <= (SELECT coalesce(min(tick_no), 1000000) FROM p WHERE passed AND tick_no % 40 = 7)")
def _(s, d):
    return failing_pipeline(False).run(one(s, d), frame_ticks(s, d))[1]


@query("run_log_allowed", f"{M}{FRAME_TICKS}{HALVES} SELECT log_id, tick_no, upto AS asof_seconds, {FAILING} FROM p")
def _(s, d):
    return failing_pipeline(True).run(one(s, d), frame_ticks(s, d))[1]


@query("failed_task_rows", f"{M}{FRAME_TICKS}{HALVES} SELECT tick_no, unnest(CASE WHEN tick_no % 40 = 7 THEN ['fetch'] ELSE ['fetch', 'note'] END) AS task FROM p WHERE passed AND tick_no <= (SELECT coalesce(min(tick_no), 1000000) FROM p WHERE passed AND tick_no % 40 = 7)")
def _(s, d):
    made = failing_pipeline(False).run(one(s, d), frame_ticks(s, d))[0]
    rows = [df.select("tick_no", F.lit(name).alias("task")) for name, df in made.items()]
    return rows[0].union(rows[1])


@query("snake_case", "SELECT DISTINCT p_name, lower(replace(p_name, ' ', '_')) AS snake FROM part")
def _(s, d):
    return table(s, d, "part").select("p_name", C.snake_case(F.col("p_name")).alias("snake")).distinct()


@query("custom_gate", f"{M}{FRAME_TICKS} SELECT log_id, tick_no, upto AS asof_seconds, tick_no % 2 = 0 AS passed FROM ticks")
def _(s, d):
    gates.register_gate("even", lambda ticks: ticks.withColumn("passed", F.col("tick_no") % 2 == 0))
    return gates.call(gates.GATES, "even", ticks=frame_ticks(s, d), unused=1)


@query(
    "pipeline_config",
    f"{M}{FRAME_TICKS}, e AS (SELECT tick_no, count(m.t) AS n FROM ticks LEFT JOIN m ON m.topic = 'error' AND m.t BETWEEN upto - 7200 AND upto GROUP BY tick_no) "
    "SELECT e.tick_no, e.n AS errors, count(*) AS rows FROM e JOIN ticks ON ticks.tick_no = e.tick_no JOIN m ON m.t BETWEEN upto - 3600 AND upto WHERE e.n >= 2 GROUP BY ALL",
)
def _(s, d):
    """Gate and task count in lookbacks of their own."""
    errors = one(s, d).filter("topic = 'error'")
    spec = {
        "name": "watch_clicks", "cadence": {"topic": "click", "when": {"value": 50, "unit": "frame"}}, "lookback": {"value": 1, "unit": "hour"},
        "gates": [{"name": "errors", "lookback": {"value": 2, "unit": "hour"}}], "tasks": ["rows", {"name": "errors_seen", "lookback": {"value": 7200, "unit": "second"}}],
    }
    counted = lambda df, name: df.groupBy(*lookback.TICK).agg(F.count("*").alias(name))
    p = pipeline_from_config(
        spec,
        {"errors": lambda t, seen: counted(seen(errors), "n").withColumn("passed", F.col("n") >= 2)},
        {"rows": lambda t, seen: counted(seen(one(s, d)), "rows"), "errors_seen": lambda t, seen: counted(seen(errors), "errors")},
    )
    made = p.run(one(s, d), frame_ticks(s, d))[0]
    return made["rows"].join(made["errors_seen"], list(lookback.TICK)).select("tick_no", "errors", "rows")


@query("custom_task", f"{M}{FRAME_TICKS} SELECT tick_no, 'late' AS body FROM ticks")
def _(s, d):
    gates.register_task("alert", tasks.alert_task)
    return gates.call(gates.TASKS, "alert", ticks=frame_ticks(s, d), subject="clicks", body="late", unused=1).select("tick_no", "body")


# Tasks


@query("task_topic_sql", f"{M}{FRAME_TICKS} SELECT tick_no, round(avg(value), 8) AS mean, count(*) AS n FROM ticks JOIN m ON m.topic = 'view' AND m.t BETWEEN upto - 7200 AND upto GROUP BY tick_no")
def _(s, d):
    views = one(s, d).filter("topic = 'view'")
    return tasks.topic_sql_task(frame_ticks(s, d), views, [F.round(F.avg(value()), 8).alias("mean"), F.count("*").alias("n")], 7200.0).drop("log_id", "asof_seconds")


@query("task_topic_sql_overlap", f"{M}{DENSE} SELECT tick_no, round(avg(value), 9) AS mean, count(*) AS n FROM ticks JOIN m ON m.topic = 'view' AND m.t BETWEEN upto - 86400 AND upto GROUP BY tick_no")
def _(s, d):
    views = one(s, d).filter("topic = 'view'")
    made = tasks.topic_sql_task(dense_ticks(s, d), views, {"mean": panes.mean(value()), "n": panes.count()}, DAY)
    return made.select("tick_no", F.round("mean", 9).alias("mean"), "n")


@query("pipeline_overlap", f"{M}{FRAME_TICKS} SELECT tick_no, count(*) AS n, max(value) AS high FROM ticks JOIN m ON m.t <= upto GROUP BY tick_no")
def _(s, d):
    """A pipeline without lookback: its task aggregates all so far at each tick."""
    seen = {"all": lambda t, seen: seen.aggregate(None, {"n": panes.count(), "high": panes.high(value())}, huge=True)}
    p = Pipeline("watch", "click", Every(50, "frame"), None, {}, seen)
    return p.run(one(s, d), frame_ticks(s, d))[0]["all"].select("tick_no", "n", "high")


@query("task_write_topics", f"{M}{FRAME_TICKS} SELECT tick_no, seq, CASE WHEN topic = 'click' THEN value END AS click, CASE WHEN topic = 'error' THEN value END AS error FROM ticks JOIN m ON m.topic IN ('click', 'error') AND m.t BETWEEN upto - 3600 AND upto")
def _(s, d):
    relation, path = tasks.topics_relation(one(s, d), ["click", "error"]), new_folder(s, "artifacts")
    tasks.write_windows(relation, frame_ticks(s, d), 3600.0, path, ("watch", "topics", "here", "robot"))
    return tasks.read_windows(s, path, relation.schema, 3600.0).select("tick_no", "seq", F.col("click.value").alias("click"), F.col("error.value").alias("error"))


@query("task_snippet", f"{M}{FRAME_TICKS} SELECT tick_no, seq, topic FROM ticks JOIN m ON m.topic IN ('click', 'error') AND m.t BETWEEN upto - 3600 AND upto")
def _(s, d):
    return tasks.snippet_task(frame_ticks(s, d), one(s, d), ["click", "error"], 3600.0).select("tick_no", "seq", "topic")


@query("frame_manifest", f"{M}{FRAME_TICKS}, x AS ({LAST_ROWS}) SELECT tick_no, CAST(row_number() OVER (PARTITION BY tick_no ORDER BY t, seq) - 1 AS INTEGER) AS frame, topic || ' ' || printf('%.8f', t) AS caption, 100 AS duration_ms FROM x WHERE back <= 5")
def _(s, d):
    return tasks.frame_manifest(one(s, d), frame_ticks(s, d), 5, huge=True).drop("log_id", "asof_seconds")


@query("decode_payloads", "SELECT event_id AS key, CASE WHEN user_id % 7 > 0 THEN props END AS decoded, CASE WHEN user_id % 7 = 0 THEN 'UnicodeDecodeError' END AS failure FROM events")
def _(s, d):
    bad = F.concat(F.lit(b"\xff"), F.col("props").cast("binary"))
    rows = table(s, d, "events").select(F.col("event_id").alias("key"), F.when(F.col("user_id") % 7 == 0, bad).otherwise(F.col("props").cast("binary")).alias("payload"))
    return tasks.decode_payloads(rows, decode_utf8).select("key", "decoded", F.regexp_extract("error", "^([^:]*)", 1).alias("failure"))


def decode_utf8(data: bytes) -> str:
    return data.decode("utf-8")


@query("explode_points", "WITH i AS (SELECT vec_id, embedding, unnest(range(16)) AS p FROM embeddings) SELECT vec_id, CAST(p AS INTEGER) AS point_no, embedding[4 * p + 1] AS x, embedding[4 * p + 2] AS y, embedding[4 * p + 3] AS z, embedding[4 * p + 4] AS w FROM i")
def _(s, d):
    return tasks.explode_points(table(s, d, "embeddings").select("vec_id", "embedding"), "embedding", ["x", "y", "z", "w"])


@query(
    "files_modified",
    f"{M}{FRAME_TICKS}, f AS (SELECT topic, max(t) AS modified FROM m WHERE t < {T0 + 20 * DAY} GROUP BY topic) SELECT tick_no, topic AS file, '/fetched/' || topic AS destination, modified AS modified_seconds FROM ticks JOIN f ON modified BETWEEN upto - 86400 AND upto",
)
def _(s, d):
    """Files named after topics, last written at their last message before a day."""
    last = one(s, d).filter(F.col("timestamp_seconds") < T0 + 20 * DAY).groupBy("log_id", F.col("topic").alias("file")).agg(F.max("timestamp_seconds").alias("t"), F.count("*").alias("size_bytes"))
    found = last.withColumn("modified", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long")))
    return files.files_modified(found, frame_ticks(s, d), Every(1440, "minute"), "/fetched").select("tick_no", "file", "destination", "modified_seconds")


@query("task_alerts", f"{M}{FRAME_TICKS} SELECT tick_no, 'clicks (asof_seconds=' || printf('%.8f', upto) || ')' AS subject, 'see log' AS body FROM ticks")
def _(s, d):
    return tasks.alert_task(frame_ticks(s, d), "clicks", "see log").drop("log_id", "asof_seconds")


@query("artifact_layout", f"{M}{FRAME_TICKS} SELECT tick_no, 'watch' AS pipeline, 'topics' AS task, strftime(make_timestamp(CAST(upto * 1000000 AS BIGINT)), '%Y-%m-%d') AS datestr, 'here' AS site, 'robot' AS asset FROM ticks")
def _(s, d):
    return tasks.artifact_columns(frame_ticks(s, d), "watch", "topics", "here", "robot").drop("log_id", "asof_seconds")


@query(
    "log_uuid",
    "WITH l AS (SELECT DISTINCT 'user_' || user_id AS log_id FROM events), h AS (SELECT log_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('[\"here\", \"' || log_id || '\", \"/logs/' || log_id || '\"]')) AS x FROM l) "
    "SELECT log_id, x[1:8] || '-' || x[9:12] || '-5' || x[14:16] || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', x[17]), 1) || x[18:20] || '-' || x[21:32] AS uuid FROM h",
)
def _(s, d):
    logs = fleet(s, d).select("log_id").distinct()
    return logs.select("log_id", tasks.log_uuid(F.lit("here"), F.col("log_id"), F.concat(F.lit("/logs/"), "log_id")).alias("uuid"))


@query("sync_plan", "SELECT DISTINCT event_type AS topic, CASE WHEN length(event_type) % 3 = 1 THEN 'changed' ELSE 'new' END AS reason FROM events WHERE length(event_type) % 3 < 2")
def _(s, d):
    """The remote side has a stale file of some topics and the same of others."""
    listed = files.listing(s, written(s, d, "json")).select(F.concat(F.regexp_extract("path", "event_type=([^/]*)", 1), F.regexp_extract("path", "/part-[0-9]+", 0)).alias("key"), "path")
    local = files.file_digests(listed)
    k = F.length(F.regexp_extract("key", "^[^/]*", 0)) % 3
    remote = local.withColumn("k", k).filter("k > 0").select("key", F.when(F.col("k") == 1, "stale").otherwise(F.col("digest")).alias("digest"))
    return tasks.sync_plan(local, remote).select(F.regexp_extract("key", "^[^/]*", 0).alias("topic"), "reason").distinct()


@query("short_digest", "SELECT event_id, left(sha256(event_id || '_' || event_type), 8) AS digest FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", C.short_digest(F.col("event_id"), F.col("event_type")).alias("digest"))


# Streams


def stream(s: SparkSession, d: str, *fields: str) -> DataFrame:
    """Events as a live source: their file, or the files of their folder, read as a stream; ``fields`` more of a message."""
    source, path = table(s, d, "events"), f"{d}/events.parquet"
    fs, at = live.file_system(s, path)
    reader = s.readStream.schema(source.schema)
    live_events = reader.parquet(path) if fs.getFileStatus(at).isDirectory() else reader.option("pathGlobFilter", "events.parquet").parquet(d)
    timed = live.with_timestamp(live_events, C.seconds_of(F.col("ts")))
    return timed.select(
        F.lit("events").alias("log_id"), F.col("event_type").alias("topic"), F.col("event_id").alias("seq"), "timestamp_seconds", F.struct("value", "user_id", *fields).alias("message")
    )


def collected(s: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A stream's output, written to a table until all there is has come through."""
    folder = new_folder(s, name)
    q = df.writeStream.format("parquet").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema(df.schema).parquet(f"{folder}/table")


def ingested(s, d, **options) -> str:
    folder = new_folder(s, "ingest")
    q = live.ingest(stream(s, d), f"{folder}/table", f"{folder}/checkpoint", ["click", "view"], name=folder.rpartition("/")[2], **options)
    q.awaitTermination()
    return folder


LIVE = f"{M} SELECT topic, count(*) AS n, round(sum(value), 2) AS total FROM m WHERE topic IN ('click', 'view') GROUP BY topic"


@query("stream_ingest", LIVE)
def _(s, d):
    return live.snapshot(s, f"{ingested(s, d)}/table").groupBy("topic").agg(F.count("*").alias("n"), F.round(F.sum("message.value"), 2).alias("total"))


@query("stream_snapshot", f"{M} SELECT seq, topic FROM m WHERE topic = 'view'")
def _(s, d):
    return live.snapshot(s, f"{ingested(s, d)}/table").filter("topic = 'view'").select("seq", "topic")


@query("stream_pause", LIVE)
def _(s, d):
    folder = ingested(s, d)
    # Overwriting starts the table anew, so nothing is in it twice.
    q = live.ingest(stream(s, d), f"{folder}/table", f"{folder}/checkpoint", ["click", "view"], name=folder.rpartition("/")[2], overwrite=True)
    q.awaitTermination()
    live.pause(q)
    return live.snapshot(s, f"{folder}/table").groupBy("topic").agg(F.count("*").alias("n"), F.round(F.sum("message.value"), 2).alias("total"))


@query("stream_resume", f"{M} SELECT topic, count(*) AS n, round(sum(value), 2) AS total FROM m WHERE topic IN ('click', 'view') AND (t < {T0 + 8 * DAY} OR t >= {T0 + 16 * DAY}) GROUP BY topic")
def _(s, d):
    """Paused on the 8th day and resumed on the 16th: what came between is lost, the rest is there once."""
    folder, t = new_folder(s, "resumed"), F.col("timestamp_seconds")
    where = (f"{folder}/table", f"{folder}/checkpoint", ["click", "view"])
    q = live.ingest(stream(s, d).filter(t < T0 + 8 * DAY), *where, name="resumed")
    q.awaitTermination()
    live.pause(q)
    live.resume(stream(s, d), *where, name="resumed", since=t >= T0 + 16 * DAY).awaitTermination()
    return live.snapshot(s, f"{folder}/table").groupBy("topic").agg(F.count("*").alias("n"), F.round(F.sum("message.value"), 2).alias("total"))


@query("stream_topics", f"{M} SELECT topic, count(*) AS message_count FROM m GROUP BY topic")
def _(s, d):
    folder, out = new_folder(s, "topics"), {}
    q = (
        live.live_topics(stream(s, d))
        .writeStream.outputMode("complete")
        .foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/table"))
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return s.read.parquet(f"{folder}/table")


THROTTLED = (
    ", c AS (SELECT topic, t, seq, row_number() OVER (PARTITION BY topic ORDER BY t, seq) AS i FROM m), g AS (SELECT topic, seq, t FROM c WHERE i = 1 "
    "UNION ALL SELECT topic, seq, t FROM (SELECT c.topic, c.seq, c.t, row_number() OVER (PARTITION BY g.topic ORDER BY c.t, c.seq) AS k FROM g JOIN c ON c.topic = g.topic AND c.t - g.t >= 43200) WHERE k = 1) SELECT topic, seq FROM g"
)


@query("throttle", M + THROTTLED)
def _(s, d):
    return live.throttle(one(s, d), 43_200_000).select("topic", "seq")


@query("throttle_huge_log", M + THROTTLED)
def _(s, d):
    return live.throttle(one(s, d), 43_200_000, huge=True).select("topic", "seq")


@query("throttle_stream", M + THROTTLED)
def _(s, d):
    return collected(s, live.throttle_stream(stream(s, d), 43_200_000), "throttled").select("topic", "seq")


RETAINED = ", x AS (SELECT *, sum(strlen(props) + 1) OVER (PARTITION BY log_id, topic ORDER BY t DESC, seq DESC) AS held FROM m) SELECT log_id, topic, seq FROM x WHERE held <= {}"


@query("retain_bytes", FLEET + RETAINED.format(100))
def _(s, d):
    return live.retain_bytes(fleet(s, d), 100, F.col("message.props")).select("log_id", "topic", "seq")


@query("retain_bytes_huge_log", M + RETAINED.format(9000))
def _(s, d):
    return live.retain_bytes(one(s, d), 9000, F.col("message.props"), huge=True).select("log_id", "topic", "seq")


@query(
    "stream_ticks",
    f"{M}, c AS (SELECT topic, t, (row_number() OVER (PARTITION BY topic ORDER BY t, seq) - 1) AS i FROM m) SELECT topic, t AS asof_seconds FROM c WHERE i % 100 = 0",
)
def _(s, d):
    return collected(s, live.stream_ticks(stream(s, d), Every(100, "frame")), "ticks").select("topic", "asof_seconds")


@query("stream_bounded", f"{M}, x AS (SELECT *, sum(strlen(props) + 1) OVER (PARTITION BY topic ORDER BY t DESC, seq DESC) AS held FROM m WHERE topic IN ('click', 'view')) SELECT topic, seq FROM x WHERE held <= 9000")
def _(s, d):
    """A live table that keeps the newest lines of each topic within 9000 bytes."""
    folder = new_folder(s, "bounded")
    known = ["click", "error", "purchase", "signup", "view"]
    q = bounded.ingest_bounded(
        stream(s, d, "props"), f"{folder}/table", f"{folder}/checkpoint", ["click", "view"], 9000, F.col("message.props"), name=folder.rpartition("/")[2], available=known, huge=True
    )
    q.awaitTermination()
    return bounded.bounded_snapshot(s, f"{folder}/table", huge=True).select("topic", "seq")


CLICK_TICKS = f"{M}, c AS (SELECT t, (row_number() OVER (ORDER BY t, seq) - 1) AS i FROM m WHERE topic = 'click'), k AS (SELECT i // 100 AS tick_no, t AS upto FROM c WHERE i % 100 = 0)"


@query("stream_run", f"{CLICK_TICKS} SELECT upto AS asof_seconds, count(*) AS n FROM k JOIN m ON m.t BETWEEN upto - 3600 AND upto GROUP BY ALL")
def _(s, d):
    """A pipeline over the live table, at the ticks of its own topic."""
    folder = new_folder(s, "run")
    live.ingest(stream(s, d), f"{folder}/live", f"{folder}/live-checkpoint", name=folder.rpartition("/")[2]).awaitTermination()
    buffer = lambda: live.snapshot(s, f"{folder}/live")
    p = Pipeline("watch", "click", Every(100, "frame"), Every(1, "hour"), {}, {"seen": lambda t, seen: seen(buffer()).groupBy(*lookback.TICK).agg(F.count("*").alias("n"))})
    live.stream_run(live.stream_ticks(stream(s, d), Every(100, "frame")), p, buffer, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return s.read.schema("asof_seconds double, n long").parquet(f"{folder}/out/seen").select("asof_seconds", "n")


@query(
    "stream_pipeline",
    f"{CLICK_TICKS}, x AS (SELECT tick_no, upto, count(*) AS n, max(value) AS high FROM k JOIN m ON m.t BETWEEN upto - 3600 AND upto GROUP BY ALL), f AS (SELECT min(tick_no) AS stopped FROM x WHERE tick_no >= 3 AND n >= 10) "
    "SELECT tick_no, upto AS asof_seconds, n, high, CASE WHEN tick_no = stopped THEN 'failed' ELSE 'executed' END AS status FROM x, f WHERE stopped IS NULL OR tick_no <= stopped",
)
def _(s, d):
    """A live pipeline that stops at its first tick, from the fourth on, that sees ten messages."""
    folder = new_folder(s, "pipeline")
    figures = lambda t, seen: seen.aggregate(None, {"n": panes.count(), "high": panes.high(value())})

    def crowded(t: DataFrame, seen) -> DataFrame:
        made = seen.aggregate(None, {"n": panes.count()}, empty=True)
        return made.withColumn("error", F.when((F.col("tick_no") >= 3) & (F.col("n") >= 10), "crowded"))

    p = Pipeline("watch", "click", Every(100, "frame"), Every(1, "hour"), {}, {"figures": figures, "crowded": crowded})
    pipelines.run_live(stream(s, d), p, folder, f"{folder}/checkpoint").awaitTermination()
    log = s.read.schema("log_id string, tick_no long, status string").parquet(f"{folder}/run_log")
    made = s.read.schema("log_id string, tick_no long, asof_seconds double, n long, high double").parquet(f"{folder}/figures")
    return made.join(log, ["log_id", "tick_no"]).select("tick_no", "asof_seconds", "n", "high", "status")


@query("stream_finish", f"{M} SELECT log_id, topic, max(t) AS asof_seconds FROM m GROUP BY log_id, topic HAVING topic <> 'error'")
def _(s, d):
    ran = one(s, d).filter("topic = 'error'").groupBy("log_id", "topic").agg(F.max("timestamp_seconds").alias("asof_seconds"))
    return live.final_ticks(one(s, d), ran)
