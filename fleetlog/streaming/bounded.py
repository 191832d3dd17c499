"""Live tables that stay bounded: each topic of a log keeps its newest lines within a budget of bytes.

A micro-batch adds a *segment* of files to each of some hash buckets of topics, and commits a manifest that lists the
segments there are. A bucket that has grown to twice what its last compaction left (and twice the budget) is compacted: its
segments become one, of the lines within budget. So a line is rewritten about once for each time that a bucket
doubles, and the table holds about twice what it keeps. Readers take the last manifest; files that neither it nor
the one before lists are removed, so a snapshot that has begun stays whole. A batch that is repeated after a failure
starts from the manifest before its own.

The newest lines are those that arrived last: by micro-batch, and in it by time and position.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalog import MissingTopicError
from .live import GIB, AlreadySubscribedError, file_system, newest_lines

MAGIC = "FLEETLOG_SINK"
MOST_SEGMENTS = 32  # of a bucket, before they become one
ORDER = ["_arrival", "timestamp_seconds", "seq"]
OWN = ["line_bytes", "_arrival"]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """The whole file appears at once."""
    fs, at = file_system(spark, path)
    _, part = file_system(spark, f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(at, False)
    fs.rename(part, at)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def manifests(spark: SparkSession, folder: str) -> list[int]:
    fs, at = file_system(spark, f"{folder}/manifests")
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(name[:-5]) for name in names if name.endswith(".json"))


def manifest(spark: SparkSession, folder: str, number: int | None = None) -> dict | None:
    """The manifest of batch ``number``, else the last one."""
    known = manifests(spark, folder)
    if number is None:
        number = known[-1] if known else -1
    return json.loads(read_text(spark, f"{folder}/manifests/{number:012d}.json")) if number in known else None


def segments_of(spark: SparkSession, folder: str, written: str, base: bool) -> list[dict]:
    """A segment for each bucket of a folder that was just written."""
    fs, at = file_system(spark, f"{folder}/{written}")
    if not any(x.getPath().getName().startswith("bucket=") for x in fs.listStatus(at)):
        return []
    sizes = spark.read.parquet(f"{folder}/{written}").groupBy("bucket").agg(F.sum("line_bytes").alias("bytes"), F.count("*").alias("rows"))
    return [{"path": f"{written}/bucket={r['bucket']}", "bucket": r["bucket"], "bytes": r["bytes"], "rows": r["rows"], "base": base} for r in sizes.collect()]


def read_segments(spark: SparkSession, folder: str, schema: str, segments: list[dict]) -> DataFrame:
    return spark.read.schema(schema).parquet(*(f"{folder}/{s['path']}" for s in segments)) if segments else spark.createDataFrame([], schema)


def full(segments: list[dict], budget: int | None) -> bool:
    """Whether a bucket's segments are to be compacted."""
    kept = sum(s["bytes"] for s in segments if s["base"])
    grown = budget is not None and sum(s["bytes"] for s in segments) > 2 * max(kept, budget)
    return len(segments) > 1 and (grown or len(segments) > MOST_SEGMENTS)


def add_batch(df: DataFrame, number: int, folder: str, budget: int | None, line: Column | None, buckets: int, huge: bool) -> None:
    """Commits one micro-batch and removes what nobody reads any more."""
    spark = df.sparkSession
    if number in manifests(spark, folder):
        return  # committed before the stream's own checkpoint was
    before = manifest(spark, folder, number - 1) or {"segments": []}
    line = F.to_json(F.struct("timestamp_seconds", "message")) if line is None else line
    made = df.withColumns({"line_bytes": (F.octet_length(line) + 1).cast("long"), "_arrival": F.lit(number).cast("long")})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields)
    bucket = F.pmod(F.xxhash64("log_id", "topic"), F.lit(buckets)).cast("int")

    def written(rows: DataFrame, name: str, base: bool) -> list[dict]:
        kept = newest_lines(rows, budget, ORDER, huge).withColumn("bucket", bucket)
        kept.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{name}")
        return segments_of(spark, folder, name, base)

    segments = before["segments"] + written(made, f"data/batch-{number:012d}", False)
    by_bucket: dict[int, list[dict]] = {}
    for s in segments:
        by_bucket.setdefault(s["bucket"], []).append(s)
    due = [s for own in by_bucket.values() if full(own, budget) for s in own]
    if due:
        paths = {s["path"] for s in due}
        segments = [s for s in segments if s["path"] not in paths] + written(read_segments(spark, folder, schema, due), f"data/compact-{number:012d}", True)
    write_text(spark, f"{folder}/manifests/{number:012d}.json", json.dumps({"magic": MAGIC, "batch": number, "budget": budget, "schema": schema, "segments": segments}))
    clear(spark, folder, {s["path"] for s in segments} | {s["path"] for s in before["segments"]}, number - 1)


def clear(spark: SparkSession, folder: str, kept: set[str], since: int) -> None:
    """Removes segments that are not ``kept``, and manifests from before ``since``."""
    fs, data = file_system(spark, f"{folder}/data")
    for written in fs.listStatus(data):
        name, left = written.getPath().getName(), 0
        for one in fs.listStatus(written.getPath()):
            if one.isDirectory() and f"data/{name}/{one.getPath().getName()}" not in kept:
                fs.delete(one.getPath(), True)
            else:
                left += one.isDirectory()
        if not left:
            fs.delete(written.getPath(), True)
    for number in manifests(spark, folder):
        if number < since:
            fs.delete(file_system(spark, f"{folder}/manifests/{number:012d}.json")[1], False)


def ingest_bounded(
    source: DataFrame,
    folder: str,
    checkpoint: str,
    topics: list[str] | None = None,
    budget: int | None = GIB,
    line: Column | None = None,
    name: str = "ingest",
    buckets: int = 16,
    trigger: dict | None = None,
    overwrite: bool = False,
    available: list[str] | None = None,
    huge: bool = False,
) -> StreamingQuery:
    """Adds each message of the topics to a live table in which a topic of a log keeps its newest whole lines (JSON,
    or ``line``) within ``budget`` bytes; without one, all. One live query a name; ``overwrite`` stops it and starts a
    new table. ``available`` are the topics that the source has: others are refused. ``trigger`` is that of the
    stream (``{"processingTime": "1 second"}``); without one all there is now is added."""
    spark = source.sparkSession
    if available is not None and (missing := sorted(set(topics or []) - set(available))):
        raise MissingTopicError(f"no such topics: {', '.join(missing)}")
    running = [q for q in spark.streams.active if q.name == name]
    if running and not overwrite:
        raise AlreadySubscribedError(name)
    for q in running:
        q.stop()
    if overwrite:
        for path in (folder, checkpoint):
            fs, at = file_system(spark, path)
            fs.delete(at, True)
    write_text(spark, f"{folder}/metadata.yaml", f"magic: {MAGIC}\ntopics: {json.dumps(topics or available or [])}\nbuffer_size_bytes: {'null' if budget is None else budget}\n")
    df = source if topics is None else source.filter(F.col("topic").isin(topics))
    add: Callable[[DataFrame, int], None] = lambda batch, number: add_batch(batch, number, folder, budget, line, buckets, huge)
    return df.writeStream.queryName(name).foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def bounded_snapshot(spark: SparkSession, folder: str, huge: bool = False) -> DataFrame:
    """What a bounded live table keeps at its last commit."""
    known = manifest(spark, folder)
    if known is None:
        raise ValueError(f"no live table in {folder}")
    rows = read_segments(spark, folder, known["schema"], known["segments"])
    return newest_lines(rows, known["budget"], ORDER, huge).drop(*OWN)
