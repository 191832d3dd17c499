"""Helpers shared by the corpus operators: tables, hashes and sizes."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from ..storage import new_folder, shared_dir, stage

__all__ = ["SPACE", "ascii_lower", "hash_pair", "new_folder", "partitions", "shared_dir", "stage", "table"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The ASCII white space of the contracts: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; the quick path is for texts of one byte a character."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def hash_pair(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes: equal pairs stand for equal values."""
    return [F.xxhash64(F.lit(11), *cols), F.xxhash64(F.lit(97), *cols)]
