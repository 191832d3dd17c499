"""The time-ordered message relation: one row a message, one nullable struct column a topic."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import shared_dir, stage
from .catalog import field_paths, leaves, require_topics
from .rowindex import join_same, row_index

KEYS = ("log_id", "seq", "timestamp_seconds")


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def topic_relation(messages: DataFrame, topic: str) -> DataFrame:
    """One topic's messages, in a column named after it."""
    return messages.filter(F.col("topic") == topic).select(*KEYS, F.col("message").alias(topic))


def wide(messages: DataFrame, topics: Iterable[str] | None = None) -> DataFrame:
    """A row a message, the other topics NULL; no shuffle. Without ``topics``, all there are."""
    if topics is None:
        topics = sorted(r["topic"] for r in messages.select("topic").distinct().collect())
    elif topics := list(topics):
        require_topics(messages, topics)
    return messages.filter(F.col("topic").isin(topics)).select(
        *KEYS, *(F.when(F.col("topic") == t, F.col("message")).alias(t) for t in topics)
    )


def wide_typed(frames: dict[str, DataFrame]) -> DataFrame:
    """Like ``wide`` for topics of different schemas, each a frame of its own."""
    out = None
    for topic, df in frames.items():
        one = df.select(*KEYS, F.col("message").alias(topic))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def topic_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (*KEYS, "chunk")]


def ffill(relation: DataFrame, huge: bool = False) -> DataFrame:
    """Each row with the last known message of every topic, its own included.

    Logs are filled in parallel. With ``huge`` a log is also cut into ranges of time: each range is
    filled alone, and the last values of earlier ranges (one small row a range) fill what is left.
    """
    order, names = ("timestamp_seconds", "seq"), topic_columns(relation)
    if not huge:
        w = Window.partitionBy("log_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return relation.select(*KEYS, *(F.last(quoted(c), ignorenulls=True).over(w).alias(c) for c in names))
    dealt = relation.repartitionByRange("log_id", *order).withColumn("chunk", F.spark_partition_id())
    dealt = stage(dealt, "ffill")
    w = Window.partitionBy("log_id", "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.select(*KEYS, "chunk", *(F.last(quoted(c), ignorenulls=True).over(w).alias(c) for c in names))
    at = F.struct(*order)
    tails = dealt.groupBy("log_id", "chunk").agg(
        *(F.max_by(quoted(c), F.when(F.col(quoted(c)).isNotNull(), at)).alias(f"t{i}") for i, c in enumerate(names))
    )
    before = Window.partitionBy("log_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select("log_id", "chunk", *(F.last(f"t{i}", ignorenulls=True).over(before).alias(f"t{i}") for i in range(len(names))))
    return join_same(local, carry, ["log_id"], ["chunk"]).select(
        *KEYS, *(F.coalesce(quoted(c), f"t{i}").alias(c) for i, c in enumerate(names))
    )


def between(df: DataFrame, lo: float | None, hi: float | None) -> DataFrame:
    """Both ends inclusive, either open."""
    t = F.col("timestamp_seconds")
    df = df if lo is None else df.filter(t >= lo)
    return df if hi is None else df.filter(t <= hi)


def empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], df.schema)


def merge_topics(frames: list[DataFrame]) -> DataFrame:
    """Frames in time order, ties by topic, then position."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out.orderBy("timestamp_seconds", "topic", "seq")


def fill_defaults(message: Column, schema: T.StructType) -> Column:
    """The struct with each NULL or missing field replaced by its metadata's ``default``."""

    def value(f: T.StructField) -> Column:
        default = f.metadata.get("default")
        own = message[f.name] if f.metadata.get("present", True) else F.lit(None)
        return (own if default is None else F.coalesce(own, F.lit(default))).cast(f.dataType).alias(f.name)

    return F.struct(*(value(f) for f in schema.fields))


def converted(c: Column, kind: T.DataType) -> Column:
    """Casts nested arrays and structs field by field, by name."""
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: converted(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(converted(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return c.cast(kind)


def leaf_paths(schema: T.StructType) -> list[tuple[str, str]]:
    """Quoted dotted path and type name of every leaf."""
    return [(".".join(f'"{p}"' for p in path), kind) for path, kind in field_paths(schema)]


def flatten(df: DataFrame) -> DataFrame:
    """A column for every leaf field, named by its path."""
    return df.select(*leaves(df.schema))


def as_messages(df: DataFrame, seconds: Column, log_id: str, order: list[str]) -> DataFrame:
    """A table as the one topic ``message``: all columns as a struct. ``seq`` is the position in the log
    by time, ties by ``order``."""
    made = df.select(F.lit(log_id).alias("log_id"), F.lit("message").alias("topic"), seconds.alias("timestamp_seconds"), F.struct("*").alias("message"), *order)
    made = row_index(made, ["log_id"], ["timestamp_seconds", *order], huge=True)
    return made.withColumnRenamed("row_index", "seq").drop(*order)


def materialise(df: DataFrame, *key: str) -> DataFrame:
    """The table of ``df`` kept under a digest of ``key``; made if there is none, removed if that fails."""
    import hashlib

    spark = df.sparkSession
    path = f"{shared_dir(spark)}/relations/topics_{hashlib.sha256('_'.join(key).encode()).hexdigest()[:8]}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        try:
            df.write.mode("overwrite").parquet(path)
        except Exception:
            fs.delete(at, True)
            raise
    return spark.read.parquet(path)
