"""Files as sources: what they are, what they hold, and whether they are sound."""

from __future__ import annotations

import base64
import csv
import json
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import to_seconds_col
from ..operators.catalog import leaf
from ..operators.lookback import TICK, asof_rows, lookback_time
from ..operators.rowindex import row_index
from ..operators.tasks import file_digest
from ..plans.pipeline import Every
from .jsonform import JsonRecogniser

#: First bytes of formats, and the size of what is looked at; fixed values.
MAGIC = [
    ("ros1.bag", b"#ROSBAG V2"),
    ("ros2.db3", b"SQLite format 3\0"),
    ("ros2.mcap", b"\x89MCAP0\r\n"),
    ("px4.ulg", b"ULog"),
    ("ardupilot.bin", b"\xa3\x95\x80"),
]
BLACKBOX = b"H Product:"
#: Directories: storage that a bag's manifest names, and the magic of a topic sink's; fixed values.
BAGS = {"ros2.db3": "sqlite3", "ros2.mcap": "mcap"}
TABLES = ("table.json", "table.csv")
SINK = r"^[A-Z]+_SINK$"
DELIMITERS = ",;\t|"  # letters are no delimiters, so prose is no table
HEAD = 4096
CONTENT_BYTES = 64 << 20
EXTENSIONS = {"ros1.bag": ".bag", "ros2.db3": ".db3", "ros2.mcap": ".mcap", "px4.ulg": ".ulg", "ardupilot.bin": ".bin"}


def opened(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def listing(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """Path, size and modified time of all files below ``root``; contents aren't read."""
    if root.startswith(("http://", "https://")):
        raise NotImplementedError("logs are read from folders, not from URLs")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").options(**options).load(root)
    return files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def format_of(path: str, head: bytes, document: Callable[[], bool] | None = None) -> str | None:
    """The format that a file's name and content say, in order of precedence: ``head``, its first bytes;
    ``document()``, whether its first line, or all of it, is JSON (of ``head``, if that is not given)."""
    name = path.lower()
    for fmt, magic in MAGIC:
        if head.startswith(magic) or (fmt == "ros2.db3" and name.endswith(".db3.zstd")) or (fmt == "ros2.mcap" and name.endswith(".mcap.zstd")):
            return fmt
    if head.startswith(BLACKBOX):
        for kind in ("bbl", "bfl"):
            if name.endswith(f".{kind}"):
                return f"betaflight.{kind}"
    nested = head.lstrip()[:1] in (b"{", b"[")
    document = document or (lambda: is_json_table(head, lambda n: b""))
    if document() if nested else is_json(head.split(b"\n", 1)[0]):
        return "table.json"
    try:
        text = head.decode("utf-8", "strict" if len(head) < HEAD else "ignore")
        if text.strip() and "\0" not in text:
            csv.Sniffer().sniff(text, DELIMITERS)
            return "table.csv"
    except (UnicodeDecodeError, csv.Error):
        pass
    return None


def is_json(data: bytes) -> bool:
    try:
        json.loads(data)
    except ValueError:
        return False
    return True


def is_json_table(head: bytes, read: Callable[[int], bytes]) -> bool:
    """Whether the first line is JSON, or else all there is, a block at a time."""
    seen, block, first = JsonRecogniser(), head, True
    while block:
        line, newline, rest = block.partition(b"\n") if first else (block, b"", b"")
        if not seen.feed(line):
            return False
        if newline:
            if line.strip() and seen.complete:
                return True
            first = False
            if not seen.feed(newline + rest):
                return False
        block = read(1 << 20)
    return seen.feed(b"", last=True) and seen.complete


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Format of each file below ``root`` by its first 4 KiB, JSON by its first line or else by all of it, a block
    at a time; ``topic.buffer`` where the file lies under a ``data`` folder of line files."""

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = []
            for path in pdf["path"]:
                fs, at = opened(path)
                with fs.open_input_stream(at) as f:
                    head = f.read(HEAD)
                    found.append(format_of(path, head, lambda head=head, f=f: is_json_table(head, f.read)))
            yield pdf.assign(format=found)

    made = listing(spark, root).mapInPandas(look, "path string, size_bytes long, modified timestamp, format string")
    buffer = F.col("path").rlike(r"/data/[^/]+/[^/]*\.jsonl$")
    return made.withColumn("format", F.when(buffer, "topic.buffer").otherwise(F.col("format")))


def directory_formats(inventory: DataFrame, manifests: DataFrame, sink: str = SINK) -> DataFrame:
    """(folder, format, files): what each folder with files is as a whole, or NULL.

    A sink's ``metadata.yaml`` has a magic that matches ``sink``; a bag's lists only files that are there
    and have its format; a folder of tables has nothing else in it. ``manifests``: parsed ones.
    """
    folder = F.regexp_replace("path", "/[^/]*$", "")
    file = F.col("format").isNotNull() & ~F.col("path").endswith("/metadata.yaml")
    plain = inventory.groupBy(folder.alias("folder")).agg(
        *(F.bool_and(F.coalesce(F.col("format") == f, F.lit(False))).alias(f.replace(".", "_")) for f in TABLES),
        F.count_if(file).alias("files"),
    )
    known = manifests.select(folder.alias("folder"), "storage", F.coalesce(F.col("magic").rlike(sink), F.lit(False)).alias("sink"), F.explode_outer("files.file").alias("file"))
    there = inventory.select("path", F.col("format").alias("found"))
    listed = known.withColumn("path", F.concat("folder", F.lit("/"), "file")).join(there, "path", "left")
    is_bag = lambda fmt, storage: F.bool_and(F.col("storage").isin(storage, "") & F.coalesce(F.col("found") == fmt, F.col("file").isNull()))
    bags = listed.groupBy("folder").agg(F.bool_or("sink").alias("sink"), *(is_bag(fmt, storage).alias(fmt.replace(".", "_")) for fmt, storage in BAGS.items()))
    verdict = F.coalesce(*(F.when(F.col(c), F.lit(name)) for c, name in (("sink", "topic.buffer"), *((f.replace(".", "_"), f) for f in (*BAGS, *TABLES)))))
    return plain.join(bags, "folder", "left").select("folder", verdict.alias("format"), "files")


def validate_paths(inventory: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (path, format) with an ``error``: missing, wrong extension, wrong content, or NULL."""
    known = inventory.select("path", F.col("format").alias("found"))
    extension = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))[F.col("format")]
    return wanted.join(known.withColumn("there", F.lit(True)), "path", "left").select(
        "path",
        "format",
        F.when(F.col("there").isNull(), "missing")
        .when(extension.isNotNull() & ~F.lower("path").endswith(extension), "wrong extension")
        .when(F.col("found").isNull() | (F.col("found") != F.col("format")), "wrong content")
        .alias("error"),
    )


def content_uuid(files: DataFrame) -> DataFrame:
    """A log's id by content: MD5 of the first 64 MiB of each of ``files`` (log_id, path), sorted by
    path and joined, as a uuid5."""

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(md5=[file_digest("md5", *opened(p), CONTENT_BYTES).hex() for p in pdf["path"]])

    @F.pandas_udf("string")
    def as_uuid(joined: pd.Series) -> pd.Series:
        return joined.map(lambda x: str(uuid.uuid5(uuid.NAMESPACE_OID, x)))

    made = files.select("log_id", "path").mapInPandas(digest, "log_id string, path string, md5 string")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("path", "md5"))), lambda x: x["md5"])
    return made.groupBy("log_id").agg(F.array_join(parts, "_").alias("joined")).select("log_id", as_uuid("joined").alias("content_uuid"))


def file_digests(files: DataFrame) -> DataFrame:
    """(key, digest) of ``files`` (key, path): base64 of SHA-256."""

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"key": pdf["key"], "digest": [base64.b64encode(file_digest("sha256", *opened(p))).decode() for p in pdf["path"]]})

    return files.select("key", "path").mapInPandas(digest, "key string, digest string")


def files_modified(found: DataFrame, ticks: DataFrame, lookback: Every | None, directory: str) -> DataFrame:
    """Files of a log that each tick's lookback holds by modified time, and where they are to go.

    ``found``: (log_id, file, size_bytes, modified), ``file`` below the source's root. Both ends count.
    A file may not leave ``directory``.
    """
    if lookback is not None and lookback.unit == "frame":
        raise ValueError("files have no frames to look back on")
    rows = found.select("log_id", "file", "size_bytes", (F.unix_micros("modified") / 1e6).alias("timestamp_seconds"))
    seen = asof_rows(rows, ticks) if lookback is None else lookback_time(rows, ticks, lookback.seconds())
    # Each .. takes the name before it away; one that is left over leads out.
    parts = F.filter(F.split("file", "/"), lambda x: ~x.isin("", "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda s, x: deeper(s, F.when(x == "..", -1).otherwise(1)))
    target = F.concat(F.lit(directory.rstrip("/") + "/"), "file")
    inside = F.when(depth["low"] < 0, F.raise_error(F.concat(F.lit("a file would leave the folder: "), "file"))).otherwise(target)
    return seen.select(*TICK, "file", inside.alias("destination"), "size_bytes", F.col("timestamp_seconds").alias("modified_seconds"))


def deeper(s: Column, by: Column) -> Column:
    return F.struct((s["at"] + by).alias("at"), F.least(s["low"], s["at"] + by).alias("low"))


def with_seconds(df: DataFrame, path: str | list[str] | None, fmt: str | None) -> DataFrame:
    """``df`` with ``timestamp_seconds`` from the field at ``path`` (names from the outside in), by its type
    and ``fmt``; without a path, processing time."""
    if path is None:
        return df.withColumn("timestamp_seconds", to_seconds_col(None, ""))
    field = leaf((path,) if isinstance(path, str) else tuple(path))
    kind = df.select(field).schema[0].dataType
    name = "string" if isinstance(kind, T.StringType) else "number" if isinstance(kind, T.NumericType) else "timestamp"
    return df.withColumn("timestamp_seconds", to_seconds_col(field, name, fmt))


def chosen(spark: SparkSession, root: str, fmt: str, ignore: list[str] | None, exclude_invalid: bool) -> list[str]:
    """Files below ``root`` whose names start with none of ``ignore``, and that are what they should be."""
    found = file_inventory(spark, root) if exclude_invalid else listing(spark, root)
    for prefix in ignore or []:
        found = found.filter(~F.regexp_extract("path", "[^/]*$", 0).startswith(prefix))
    if exclude_invalid:
        found = found.filter(F.col("format") == fmt)
    return [r["path"] for r in found.select("path").collect()]


def read_files(reader: DataFrameReader, fmt: str, path: str, parts: list[str] | None, base: str | None, ignore: list[str] | None, exclude_invalid: bool, flavor: str) -> DataFrame:
    spark = SparkSession.active()
    paths = chosen(spark, path, f"table.{fmt}", ignore, exclude_invalid) if ignore or exclude_invalid else [path]
    if not paths:
        raise ValueError(f"no {fmt} files below {path}")
    reader = reader.option("recursiveFileLookup", "true") if parts else reader.option("basePath", base or path) if len(paths) > 1 else reader
    df = reader.format(fmt).load(paths)
    if parts and flavor == "filename":
        place = F.split(F.regexp_extract("_metadata.file_name", r"^([^.]*)", 1), "_")
    else:
        place = F.split(F.regexp_replace("_metadata.file_path", f"^.*{re.escape((base or path).rstrip('/').rpartition('/')[2])}/", ""), "/")
    return df.select("*", *(F.get(place, F.lit(i)).alias(name) for i, name in enumerate(parts or [])))


def read_csv(
    spark: SparkSession,
    path: str,
    schema: str | None = None,
    parts: list[str] | None = None,
    base: str | None = None,
    ignore: list[str] | None = None,
    exclude_invalid: bool = False,
    flavor: str = "directory",
    timestamp: str | None = None,
    fmt: str | None = None,
) -> DataFrame:
    """A CSV source. Folders named ``key=value`` are partitions of themselves; ``parts`` names positional ones:
    folders below ``base`` or, with the flavor ``filename``, parts of file names between underscores.
    ``ignore``: prefixes of file names that are left out; ``exclude_invalid``: so are files of other
    formats (each is looked at). ``timestamp`` and ``fmt`` add ``timestamp_seconds``."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    df = read_files(reader, "csv", path, parts, base, ignore, exclude_invalid, flavor)
    return with_seconds(df, timestamp, fmt) if timestamp else df


def read_json(
    spark: SparkSession,
    path: str,
    schema: str | None = None,
    lines: bool = True,
    parts: list[str] | None = None,
    base: str | None = None,
    ignore: list[str] | None = None,
    exclude_invalid: bool = False,
    flavor: str = "directory",
    timestamp: list[str] | None = None,
    fmt: str | None = None,
) -> DataFrame:
    """A JSON source; options as in ``read_csv``, ``timestamp`` is the path of a nested field."""
    reader = (spark.read.schema(schema) if schema else spark.read).option("multiLine", not lines)
    df = read_files(reader, "json", path, parts, base, ignore, exclude_invalid, flavor)
    return with_seconds(df, timestamp, fmt) if timestamp else df


def read_buffer(spark: SparkSession, folder: str, topics: dict[str, str]) -> DataFrame:
    """A folder of per-topic JSON lines ``{timestamp_seconds, topic: message}`` as messages; the
    overflow file of a topic comes before its current one. ``topics``: each topic's schema."""
    out = None
    for topic, ddl in topics.items():
        df = spark.read.schema(f"timestamp_seconds double, `{topic}` struct<{ddl}>").json(f"{folder}/data/{topic}/*.json*")
        one = df.select(
            F.lit(folder.rstrip("/").rpartition("/")[2]).alias("log_id"),
            F.lit(topic).alias("topic"),
            "timestamp_seconds",
            F.when(F.col("_metadata.file_name").contains("overflow"), 0).otherwise(1).alias("part"),
            F.col(f"`{topic}`").alias("message"),
        )
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


MANIFEST = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("magic", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("storage", T.StringType()),
        T.StructField("compression", T.StringType()),
        T.StructField("messages", T.LongType()),
        T.StructField("files", T.ArrayType(T.StructType([T.StructField("file", T.StringType()), T.StructField("start_ns", T.LongType()), T.StructField("duration_ns", T.LongType()), T.StructField("messages", T.LongType())]))),
        T.StructField("topics", T.ArrayType(T.StructType([T.StructField("topic", T.StringType()), T.StructField("type_name", T.StringType()), T.StructField("serialization", T.StringType()), T.StructField("messages", T.LongType())]))),
    ]
)


def parsed_manifests(texts: DataFrame) -> DataFrame:
    """``texts`` (path, value) of manifests: a row a bag, with arrays of files and topics."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)  # libyaml's, which is ten times as fast
        for pdf in frames:
            out = []
            for path, text in zip(pdf["path"], pdf["value"]):
                whole = yaml.load(text, loader) or {}
                info = whole.get("rosbag2_bagfile_information", {})
                listed = info.get("files") or [{"path": p} for p in info.get("relative_file_paths", [])]
                files = [(x.get("path"), x.get("starting_time", {}).get("nanoseconds_since_epoch"), x.get("duration", {}).get("nanoseconds"), x.get("message_count")) for x in listed]
                topics = [(x["topic_metadata"].get("name"), x["topic_metadata"].get("type"), x["topic_metadata"].get("serialization_format"), x.get("message_count")) for x in info.get("topics_with_message_count", [])]
                names = [[f.name for f in MANIFEST[k].dataType.elementType] for k in ("files", "topics")]
                out.append((path, whole.get("magic"), info.get("version"), info.get("storage_identifier"), info.get("compression_format") or None, info.get("message_count"), [dict(zip(names[0], x)) for x in files], [dict(zip(names[1], x)) for x in topics]))
            yield pd.DataFrame(out, columns=MANIFEST.names)

    return texts.mapInPandas(parse, MANIFEST)


def bag_manifests(spark: SparkSession, root: str) -> DataFrame:
    """``metadata.yaml`` files below ``root``."""
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata.yaml").text(root, wholetext=True)
    return parsed_manifests(texts.select(F.col("_metadata.file_path").alias("path"), "value"))


def missing_files(manifests: DataFrame, known: DataFrame) -> DataFrame:
    """Files that manifests list and ``known`` (path) lacks."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    listed = manifests.select(F.col("path").alias("manifest"), F.explode(F.transform("files", lambda f: F.concat(folder, F.lit("/"), f["file"]))).alias("path"))
    return listed.join(known.select("path"), "path", "left_anti")


def param_snapshot(params: DataFrame) -> DataFrame:
    """The last value of each parameter: ``params`` (log_id, name, value, timestamp_seconds, seq)."""
    return params.groupBy("log_id", "name").agg(F.max_by("value", F.struct("timestamp_seconds", "seq")).alias("value"))


def buffer_messages(df: DataFrame, huge: bool = False) -> DataFrame:
    """``read_buffer``'s rows with ``seq``, from 1: in time order within a topic, overflow first. With ``huge`` a topic is
    numbered by ranges."""
    made = row_index(df, ["log_id", "topic"], ["part", "timestamp_seconds"], huge)
    return made.withColumn("seq", F.col("row_index") + 1).drop("part", "row_index")
