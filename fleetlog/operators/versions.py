"""Topics whose message type differs by log and version: payloads are variants, and a topic's relation has one struct.

The types of a topic come from its definitions (a bounded catalog, one schema a version), which merge field by field into one that
holds them all: a field that some versions lack is NULL there, numbers widen, structs and arrays merge inside. Fields
that can't be held by one type are conflicts, and are named. Payloads are cast to the merged struct as they are read, so
a fleet of any mix of versions is one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .definitions import definition_fields, definition_lines, definition_sections, resolve_types, to_struct
from .relation import KEYS, between, quoted

#: Numbers by what holds them; a fixed value. Whole numbers and floats meet in double.
WHOLE = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
REAL = [T.FloatType(), T.DoubleType()]


class SchemaConflictError(ValueError):
    """Versions of a topic have types for a field that no type holds."""


def widest(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The smallest type that holds values of both, exactly for numbers up to 32 bits; None if there is none."""
    if a == b:
        return a
    for kinds in (WHOLE, REAL):
        if a in kinds and b in kinds:
            return kinds[max(kinds.index(a), kinds.index(b))]
    if {type(a), type(b)} <= {T.DecimalType, *map(type, WHOLE)}:  # unsigned 64-bit numbers are decimals
        return a if isinstance(a, T.DecimalType) else b
    small = WHOLE[:2]
    if a in WHOLE + REAL and b in WHOLE + REAL:
        whole, real = (a, b) if a in WHOLE else (b, a)
        return real if whole in small else T.DoubleType()
    return None


def merged(a: T.DataType, b: T.DataType, path: str, conflicts: list[str]) -> T.DataType:
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = [*a.names, *(n for n in b.names if n not in a.names)]
        out = []
        for name in names:
            held = [x[name] for x in (a, b) if name in x.names]
            kind = held[0].dataType if len(held) == 1 else merged(held[0].dataType, held[1].dataType, f"{path}.{name}" if path else name, conflicts)
            out.append(T.StructField(name, kind, True, held[-1].metadata))
        return T.StructType(out)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merged(a.elementType, b.elementType, f"{path}[]", conflicts))
    kind = widest(a, b)
    if kind is None:
        conflicts.append(f"{path}: {a.simpleString()} and {b.simpleString()}")
        return a
    return kind


def merge_schemas(schemas: dict[str, T.StructType]) -> T.StructType:
    """One schema that holds those of all versions, in order of version; conflicts raise, all named at once."""
    conflicts: list[str] = []
    out = T.StructType([])
    for version in sorted(schemas):
        found: list[str] = []
        out = merged(out, schemas[version], "", found)
        conflicts += [f"{x} (version {version})" for x in found]
    if conflicts:
        raise SchemaConflictError("; ".join(conflicts))
    return out


def schemas_of(definitions: DataFrame, topic: str) -> dict[str, T.StructType]:
    """The schema of each version of a topic from ``definitions`` (topic, version, text)."""
    texts = definitions.filter(F.col("topic") == topic).select(F.col("version").cast("string").alias("text_id"), "text").distinct()
    sections = definition_sections(definition_lines(texts))
    fields = definition_fields(sections)
    resolved = resolve_types(fields, sections)
    if wrong := [r["error"] for r in resolved.filter("error IS NOT NULL").orderBy("text_id", "line_no").collect()]:
        raise ValueError(f"{topic}: {'; '.join(wrong)}")
    return {r["text_id"]: to_struct(fields, resolved, r["text_id"]) for r in texts.select("text_id").collect()}


def json_payloads(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with its JSON text as ``payload``, a variant; NULL where it is no JSON."""
    return df.withColumn("payload", F.try_parse_json(text))


def typed_topic(messages: DataFrame, topic: str, schema: T.StructType) -> DataFrame:
    """One topic of ``messages`` (log_id, topic, seq, timestamp_seconds, payload) as a struct column of its name. A
    payload that doesn't fit the schema is NULL."""
    typed = F.try_variant_get("payload", "$", schema.simpleString())
    return messages.filter(F.col("topic") == topic).select(*KEYS, typed.alias(topic))


def query_versions(
    messages: DataFrame, definitions: DataFrame, sql: str, topics: list[str], lo: float | None = None, hi: float | None = None
) -> DataFrame:
    """SQL over topics of different schemas, each a view and a column of its own name, whatever versions logs have."""
    spark, views = messages.sparkSession, {}
    for topic in topics:
        views[topic] = between(typed_topic(messages, topic, merge_schemas(schemas_of(definitions, topic))), lo, hi)
    try:
        for topic, df in views.items():
            df.createOrReplaceTempView(quoted(topic))
        return spark.sql(sql)
    finally:
        for topic in topics:
            spark.catalog.dropTempView(topic)


def wide_versions(messages: DataFrame, definitions: DataFrame, topics: list[str]) -> DataFrame:
    """A row a message and a column a topic, the others NULL, of topics with schemas of their own; one scan."""
    typed = {t: merge_schemas(schemas_of(definitions, t)) for t in topics}
    column = lambda t: F.when(F.col("topic") == t, F.try_variant_get("payload", "$", typed[t].simpleString())).alias(t)
    return messages.filter(F.col("topic").isin(topics)).select(*KEYS, *map(column, topics))
