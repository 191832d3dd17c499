"""A message table that skips files: written by log and time, with an index of what each file holds.

Rows are range-partitioned by log, time and position, and a range is written as files of so many rows, so a file holds a
stretch of one log, or some small logs whole. The
index has a row for each file and log: first and last time, and the topics. A question with a time window, logs or
topics chooses files from the index before any is opened; within them the window is pushed to the row groups. Each write
is a folder of its own, and its files are there once the index lists them.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relation import between

FILE_ROWS = 1_000_000
MOST_TASKS = 200  # of a write, or as many as a shuffle has
MOST_PATHS = 20_000  # files that are named one by one; beyond, folders are read with the same filters
INDEX = "batch string, path string, log_id string, low double, high double, rows long, topics array<string>"


@dataclass(frozen=True)
class MessageTable:
    """Messages (log_id, topic, seq, timestamp_seconds, message) in ``folder``."""

    spark: SparkSession
    folder: str

    def write(self, messages: DataFrame, file_rows: int = FILE_ROWS) -> None:
        """Adds messages. A folder that a failed write has left is never read."""
        batch = uuid.uuid4().hex
        order = ["log_id", "timestamp_seconds", "seq"]
        # A task writes its range as files of file_rows; each task reports to the driver, so there are few where files are many.
        files = max(1, math.ceil(messages.count() / file_rows))
        tasks = min(files, max(MOST_TASKS, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        dealt = messages.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
        dealt.write.option("maxRecordsPerFile", file_rows).parquet(f"{self.folder}/data/{batch}")
        made = self.spark.read.parquet(f"{self.folder}/data/{batch}").withColumn("path", F.col("_metadata.file_path"))
        index = made.groupBy("path", "log_id").agg(
            F.min("timestamp_seconds").alias("low"), F.max("timestamp_seconds").alias("high"), F.count("*").alias("rows"), F.array_sort(F.collect_set("topic")).alias("topics")
        )
        names = [x.split(":")[0].split(" ")[0] for x in INDEX.split(", ")]
        index.withColumn("batch", F.lit(batch)).select(*names).coalesce(1).write.mode("append").parquet(f"{self.folder}/index")

    def index(self) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(f"{self.folder}/index")

    def files(self, lo: float | None = None, hi: float | None = None, logs: list[str] | None = None, topics: list[str] | None = None) -> DataFrame:
        """(batch, path): files that can hold messages of the window, logs and topics."""
        found = self.index()
        found = found if lo is None else found.filter(F.col("high") >= lo)
        found = found if hi is None else found.filter(F.col("low") <= hi)
        found = found if logs is None else found.filter(F.col("log_id").isin(logs))
        found = found if topics is None else found.filter(F.arrays_overlap("topics", F.array(*map(F.lit, topics)).cast("array<string>")))
        return found.select("batch", "path").distinct()

    def messages(self, lo: float | None = None, hi: float | None = None, logs: list[str] | None = None, topics: list[str] | None = None) -> DataFrame:
        """Messages of the window (inclusive, either end open), logs and topics."""
        batches = sorted(r["batch"] for r in self.index().select("batch").distinct().collect())  # one a write
        if not batches:
            raise ValueError(f"no messages in {self.folder}")
        schema = self.spark.read.parquet(f"{self.folder}/data/{batches[0]}").schema
        paths = [f"{self.folder}/data/{b}" for b in batches]
        if not (lo is None and hi is None and logs is None and topics is None):
            chosen = self.files(lo, hi, logs, topics)
            named = [r["path"] for r in chosen.limit(MOST_PATHS + 1).collect()]
            if len(named) <= MOST_PATHS:
                paths = sorted(named)
        out = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        out = between(out, lo, hi)
        out = out if logs is None else out.filter(F.col("log_id").isin(logs))
        return out if topics is None else out.filter(F.col("topic").isin(topics))
