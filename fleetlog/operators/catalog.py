"""Logs and topics: what there is, how much, how often."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import split_type
from .quantiles import exact_quantiles
from .rowindex import join_same, with_previous


class MissingTopicError(ValueError):
    """Topics were asked for that the log doesn't have."""


def describe_logs(messages: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Count, start, end and duration of each log; ``files`` (log_id, size_bytes) adds sizes."""
    t = F.col("timestamp_seconds")
    out = messages.groupBy("log_id").agg(
        F.count("*").alias("total_message_count"),
        F.min(t).alias("start_seconds"),
        F.max(t).alias("end_seconds"),
        (F.max(t) - F.min(t)).alias("duration_seconds"),
    )
    return out if files is None else out.join(files.groupBy("log_id").agg(F.sum("size_bytes").alias("size_bytes")), "log_id", "left")


def topics(messages: DataFrame) -> DataFrame:
    return messages.select("log_id", "topic").distinct()


def topic_counts(messages: DataFrame) -> DataFrame:
    """Messages of each topic; of an unbounded source the count isn't known (NULL)."""
    if messages.isStreaming:
        return messages.select("log_id", "topic").dropDuplicates(["log_id", "topic"]).withColumn("message_count", F.lit(None).cast("long"))
    return messages.groupBy("log_id", "topic").agg(F.count("*").alias("message_count"))


def gaps(messages: DataFrame, huge: bool = False) -> DataFrame:
    """Each message's ``latency``: seconds since the one before in its log and topic."""
    made = with_previous(messages, ["log_id", "topic"], ["timestamp_seconds", "seq"], F.col("timestamp_seconds"), "latency", huge)
    return made.withColumn("latency", F.col("timestamp_seconds") - F.col("latency"))


def topic_frequency(messages: DataFrame, huge: bool = False) -> DataFrame:
    """Messages a second: one over the median gap."""
    gap = gaps(messages.select("log_id", "topic", "seq", "timestamp_seconds"), huge)
    if huge:
        middle = exact_quantiles(gap, ["log_id", "topic"], F.col("latency"), [0.5]).withColumn("middle", F.get("quantiles", F.lit(0)))
        found = join_same(gap.select("log_id", "topic").distinct(), middle, ["log_id", "topic"], how="left")
        return found.select("log_id", "topic", F.when(F.col("middle") > 0, 1 / F.col("middle")).alias("frequency"))
    middle = F.median("latency")
    return gap.groupBy("log_id", "topic").agg(F.when(middle > 0, 1 / middle).alias("frequency"))


def describe_topic(messages: DataFrame, topic: str, definitions: DataFrame | None = None) -> DataFrame:
    """A row a field: column, type, description, units, and the topic's message count; ``definitions``
    (topic, definition) adds the text of its message definition."""
    require_topics(messages, [topic])
    fields = messages.schema["message"].dataType.fields
    rows = [(f.name, f.dataType.simpleString(), f.metadata.get("description"), f.metadata.get("units")) for f in fields]
    made = messages.sparkSession.createDataFrame(rows, "column string, type string, description string, units string")
    count = messages.filter(F.col("topic") == topic).groupBy("topic").agg(F.count("*").alias("message_count"))
    out = count.join(made.withColumn("topic", F.lit(topic)), "topic")
    return out if definitions is None else out.join(definitions.select("topic", "definition"), "topic", "left")


def describe_source(messages: DataFrame) -> DataFrame:
    """Metadata and sorted topic list of each log."""
    listed = messages.groupBy("log_id").agg(F.array_sort(F.collect_set("topic")).alias("topics"))
    return describe_logs(messages).join(listed, "log_id")


def unknown_topics(messages: DataFrame, names: DataFrame) -> DataFrame:
    """Of ``names`` (topic), those that no log has."""
    return names.join(messages.select("topic").distinct(), "topic", "left_anti")


def require_topics(messages: DataFrame, names: list[str]) -> None:
    asked = messages.sparkSession.createDataFrame([(n,) for n in names], "topic string")
    if missing := sorted(r["topic"] for r in unknown_topics(messages, asked).collect()):
        raise MissingTopicError(f"no such topics: {', '.join(missing)}")


def topics_of_type(known: DataFrame, type_name: str, asked: list[str] | None = None) -> DataFrame:
    """Of ``known`` (log_id, topic, type_name), topics of one type; asking for others is an error."""
    found = known.filter(F.col("type_name") == type_name)
    if asked is not None:
        names = {r["topic"] for r in found.select("topic").distinct().collect()}
        if wrong := sorted(set(asked) - names):
            raise MissingTopicError(f"no topics of type {type_name}: {', '.join(wrong)}")
        found = found.filter(F.col("topic").isin(asked))
    return found


def with_type(messages: DataFrame) -> DataFrame:
    """Type name and multi id of topics named type_id."""
    name, index = split_type(F.col("topic"))
    return messages.withColumns({"type_name": name, "multi_id": index})


def drop_untimed(messages: DataFrame, types: list[str]) -> DataFrame:
    """Without record types that carry no time."""
    return messages.filter(~F.col("topic").isin(types))


def annotate(df: DataFrame, dictionary: dict[str, dict[str, str]]) -> DataFrame:
    """Description, units and default as metadata of the fields named."""
    return df.select(*(F.col(f"`{c}`").alias(c, metadata=dictionary.get(c, {})) for c in df.columns))


def field_paths(schema: T.StructType, above: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], str]]:
    """Path, as names from the outside in, and type name of every leaf field."""
    found = []
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            found += field_paths(f.dataType, (*above, f.name))
        else:
            found.append(((*above, f.name), f.dataType.simpleString()))
    return found


def field_rows(schema: T.StructType) -> list[tuple[str, str]]:
    """Dotted path and type name of every leaf field."""
    return [(".".join(path), kind) for path, kind in field_paths(schema)]


def describe_text(fields: DataFrame) -> DataFrame:
    """(topic, text): a line ``type name # description`` for each of (topic, position, type, name,
    description), after a comment line with the topic."""
    line = F.concat(F.col("type"), F.lit(" "), F.col("name"), F.coalesce(F.concat(F.lit(" # "), "description"), F.lit("")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"])
    return fields.groupBy("topic").agg(lines.alias("lines")).select(
        "topic", F.concat(F.lit("# "), "topic", F.lit("\n"), F.array_join("lines", "\n")).alias("text")
    )


def leaf(path: tuple[str, ...]) -> Column:
    """The field at a path; names may hold dots."""
    return F.col(".".join(f"`{p.replace('`', '``')}`" for p in path))


def leaves(schema: T.StructType) -> list[Column]:
    """Every leaf field as a column named by its path, joined by ``_``."""
    return [leaf(path).alias("_".join(path).replace(".", "_")) for path, _ in field_paths(schema)]
