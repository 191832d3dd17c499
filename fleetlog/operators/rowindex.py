"""Positions of rows in their logs' order, without one task for one log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage


def join_same(left: DataFrame, right: DataFrame, nullable: list[str], keys: list[str] = (), how: str = "inner") -> DataFrame:
    """An equi-join of ``left`` and ``right`` in which NULLs of the ``nullable`` keys are equal, as they are in a window's
    groups; ``keys`` are never NULL."""
    named = {k: f"_same_{k}" for k in [*nullable, *keys]}
    on = [F.col(k).eqNullSafe(F.col(named[k])) for k in nullable] + [F.col(k) == F.col(named[k]) for k in keys]
    return left.join(right.withColumnsRenamed(named), on, how).drop(*named.values())


def row_index(df: DataFrame, keys: list[str], order: list[str], huge: bool = False) -> DataFrame:
    """``df`` with ``row_index``, from 0, by ``order`` within ``keys``.

    Small groups are numbered by a window. With ``huge``, rows are range-partitioned by keys and
    order and written; a row's position in its partition, the partition's offset and the group's
    first position (one small row a partition and a group) make up its index.
    """
    if not huge:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn("row_index", (F.row_number().over(w) - 1).cast("long"))
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    dealt = stage(dealt.withColumn("_at", F.monotonically_increasing_id()), "row-index")
    part, local = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    dealt = dealt.withColumns({"_part": part, "_local": local})
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # A group's rows in a partition are consecutive, so its index there starts at its first row.
    spans = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_local").alias("_first"))
    spans = spans.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).drop("_n", "_first")
    joined = join_same(dealt, spans, keys, ["_part"])
    return joined.select(*df.columns, (F.col("_base") + F.col("_local")).cast("long").alias("row_index"))


def ranged(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` dealt by ranges of keys and order and written, with each row's range as ``chunk``."""
    return stage(df.repartitionByRange(*keys, *order).withColumn("chunk", F.spark_partition_id()), name)


def earlier(keys: list[str]) -> Window:
    """The ranges of a group before this one."""
    return Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)


def with_previous(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, huge: bool = False) -> DataFrame:
    """``df`` with ``name``, the ``value`` of the row before in its group; NULL at its first row.

    With ``huge`` a group is cut into ranges; a range's first row looks at the last of the range before
    (one small row a range).
    """
    held = F.struct(value.alias("v"))
    if not huge:
        return df.withColumn(name, F.lag(held).over(Window.partitionBy(*keys).orderBy(*order))["v"])
    dealt = ranged(df, keys, order, "previous")
    last = dealt.groupBy(*keys, "chunk").agg(F.max_by(held, F.struct(*order)).alias("_last"))
    carry = last.withColumn("_last", F.last("_last").over(earlier(keys)))
    local = F.lag(held).over(Window.partitionBy(*keys, "chunk").orderBy(*order))
    made = join_same(dealt.withColumn("_own", local), carry, keys, ["chunk"])
    return made.withColumn(name, F.coalesce("_own", "_last")["v"]).select(*df.columns, name)


def with_running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, huge: bool = False) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` from its group's first row to this one; ``huge`` as above."""
    first = lambda own: Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if not huge:
        return df.withColumn(name, F.sum(value).over(first(keys)))
    dealt = ranged(df.withColumn("_v", value), keys, order, "running")
    total = dealt.groupBy(*keys, "chunk").agg(F.sum("_v").alias("_sum"))
    carry = total.withColumn("_sum", F.coalesce(F.sum("_sum").over(earlier(keys)), F.lit(0)))
    made = join_same(dealt.withColumn("_own", F.sum("_v").over(first([*keys, "chunk"]))), carry, keys, ["chunk"])
    return made.withColumn(name, F.col("_own") + F.col("_sum")).select(*df.columns, name)
