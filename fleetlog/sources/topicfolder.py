"""Log folders as a Spark data source: ``<root>/<log>/data/<topic>/*.json`` or ``*.jsonl``, a line ``{timestamp_seconds,
topic: message}``. Names that begin with a dot or an underscore are no files of a log, and packed files can't be split and are left out.

``register(spark)`` adds the format ``topic_folder`` for ``spark.read`` and ``spark.readStream``. A partition is a range of
bytes of a file, and a line belongs to the range that its line break lies in, so files of any size are split and a line
longer than a range comes once. ``seq`` is the line's position in bytes, those of an overflow file before those of the
current one, so batch, stream and repeated reads agree on it without counting lines.

Logs and topics of a filter choose folders; its times choose parts, where an index (``write_index``) knows what they hold.
Parts that it doesn't know are read. All filters are applied to the rows again.

A stream's offset is the bytes seen of each file, so a restart repeats nothing. A line comes once its line break is there;
a batch takes a last line without one if it is whole JSON. Streams are of files that grow or are added: one that has
become shorter than what was read of it was rotated, which is an error, as its lines can't be told apart any more.

Lines that are no JSON object have no time and no message; blank lines are left out. The listing and the index's rows (one
a part) go through the planning process, as with Spark's own file source.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..operators.rowindex import row_index
from .files import opened

FORMAT = "topic_folder"
ROW = "log_id string, topic string, seq long, timestamp_seconds double, message string, path string, part long"
LAYOUT = re.compile(r"(?:^|/)(?P<log>[^/]+)/data/(?P<topic>[^/]+)/(?P<name>[^/._][^/]*\.jsonl?)$")
NAMES = [x.split()[0] for x in ROW.split(", ")]
PART_BYTES = 64 << 20
BLOCK = 1 << 20
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20
CURRENT = 1 << 48  # positions of a current file come after those of its overflow file


class RotatedFileError(RuntimeError):
    """A streamed file has become shorter."""


@dataclass
class Part(InputPartition):
    """Lines of ``path`` whose line breaks lie in [start, end); ``last``: and what follows the last break."""

    path: str
    start: int
    end: int
    last: bool = False


@dataclass
class Bounds:
    """What filters leave: sets of logs and topics (all, if None), and times."""

    logs: set | None = None
    topics: set | None = None
    lo: float | None = None
    hi: float | None = None

    def add(self, f: Filter) -> None:
        name = getattr(f, "attribute", None)
        if name in (("log_id",), ("topic",)) and isinstance(f, (EqualTo, In)):
            of = "logs" if name == ("log_id",) else "topics"
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            known = getattr(self, of)
            setattr(self, of, values if known is None else known & values)
        elif name == ("timestamp_seconds",) and isinstance(getattr(f, "value", None), (int, float)):
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.lo = f.value if self.lo is None else max(self.lo, f.value)
            if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.hi = f.value if self.hi is None else min(self.hi, f.value)


def listed(root: str, bounds: Bounds) -> dict[str, int]:
    """Sizes of the log files below ``root`` by path, of the logs and topics within ``bounds``."""
    from pyarrow.fs import FileSelector, FileType

    fs, at = opened(root)
    found = {}
    for x in fs.get_file_info(FileSelector(at, recursive=True)):
        place = LAYOUT.search(x.path)
        if x.type != FileType.File or not place:
            continue
        if (bounds.logs is None or place["log"] in bounds.logs) and (bounds.topics is None or place["topic"] in bounds.topics):
            found[x.path] = x.size
    return dict(sorted(found.items()))


def parts_of(path: str, start: int, end: int, size: int, last: bool) -> list[Part]:
    """[start, end) cut at multiples of ``size``."""
    cuts = [start, *range((start // size + 1) * size, end, size), end]
    return [Part(path, a, b, last and b == end) for a, b in zip(cuts, cuts[1:]) if a < b]


def line_start(f, before: int) -> int:
    """Where the line begins that the byte at ``before`` would go on."""
    at = before
    while at > 0:
        low = max(0, at - BLOCK)
        f.seek(low)
        found = f.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


def lines_of(f, part: Part) -> Iterator[tuple[int, bytes]]:
    """(position, bytes) of the part's lines; holds a block and a line."""
    pieces, begin, at = [], None, part.start  # begin: of the line that ``pieces`` are the end of, if known

    def head() -> tuple[int, bytes]:
        low = line_start(f, part.start)
        f.seek(low)
        return low, f.read(part.start - low)

    while at < part.end:
        f.seek(at)
        block = f.read(min(BLOCK, part.end - at))
        if not block:
            break
        done = 0
        while (stop := block.find(b"\n", done)) >= 0:
            pieces.append(block[done:stop])
            if begin is None:
                begin, first = head()
                pieces.insert(0, first)
            yield begin, b"".join(pieces)
            pieces, done = [], stop + 1
            begin = at + done
        pieces.append(block[done:])
        at += len(block)
    if part.last and (begin is None or any(pieces)):
        if begin is None:
            begin, first = head()
            pieces.insert(0, first)
        rest = b"".join(pieces)
        if parsed(rest) is not None:
            yield begin, rest


def parsed(line: bytes) -> dict | None:
    try:
        row = json.loads(line)
    except (ValueError, RecursionError):
        return None
    return row if isinstance(row, dict) else None


def batches_of(part: Part) -> Iterator[pa.RecordBatch]:
    fs, at = opened(part.path)
    place = LAYOUT.search(part.path)
    base = 0 if "overflow" in place["name"] else CURRENT
    seqs, times, texts, held = [], [], [], 0

    def made() -> pa.RecordBatch:
        n = len(seqs)
        same = lambda x, kind: pa.array([x] * n, kind)
        columns = [same(place["log"], pa.string()), same(place["topic"], pa.string()), pa.array(seqs, pa.int64()), pa.array(times, pa.float64()), pa.array(texts, pa.string()), same(part.path, pa.string()), same(part.start, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=NAMES)

    with fs.open_input_file(at) as f:
        for position, line in lines_of(f, part):
            if not line.strip():
                continue
            row = parsed(line) or {}
            time, message = row.get("timestamp_seconds"), row.get(place["topic"])
            seqs.append(base + position)
            times.append(float(time) if isinstance(time, (int, float)) and not isinstance(time, bool) else None)
            texts.append(None if message is None else json.dumps(message))
            held += len(line)
            if len(seqs) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield made()
                seqs, times, texts, held = [], [], [], 0
    if seqs:
        yield made()


class TopicFolderReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.index = options["path"], options.get("index")
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))
        self.bounds = Bounds()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            self.bounds.add(f)
            yield f

    def partitions(self) -> list[Part]:
        files = listed(self.root, self.bounds)
        parts = [p for path, size in files.items() for p in parts_of(path, 0, size, self.part_bytes, True)]
        lo, hi = self.bounds.lo, self.bounds.hi
        if self.index and (lo is not None or hi is not None):
            known = index_rows(self.index, self.part_bytes)
            parts = [p for p in parts if within(known.get((p.path, p.start)), lo, hi)]
        return parts or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return batches_of(partition) if partition.path else iter(())


class TopicFolderStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.root, self.part_bytes = options["path"], int(options.get("part_bytes", PART_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return listed(self.root, Bounds())

    def partitions(self, start: dict, end: dict) -> list[Part]:
        short = sorted(path for path, size in end.items() if size < start.get(path, 0))
        if short:
            raise RotatedFileError(f"shorter than what was read of it: {', '.join(short[:5])}")
        return [p for path, size in end.items() for p in parts_of(path, start.get(path, 0), size, self.part_bytes, False)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return batches_of(partition)

    def commit(self, end: dict) -> None:
        pass


class TopicFolder(DataSource):
    """Options: ``path``; ``part_bytes``, the size of a partition; ``index``, a folder that ``write_index`` wrote."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROW

    def reader(self, schema: StructType) -> TopicFolderReader:
        return TopicFolderReader(self.options)

    def streamReader(self, schema: StructType) -> TopicFolderStreamReader:
        return TopicFolderStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Adds the format to the session, and lets filters reach Python data sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TopicFolder)


def write_index(spark: SparkSession, root: str, index: str, part_bytes: int = PART_BYTES) -> None:
    """First and last time of each part that later lines of its file prove to be full; files may grow, but not be
    replaced under one name. It serves reads with the same ``part_bytes``, and replaces an earlier index."""
    register(spark)
    rows = spark.read.format(FORMAT).option("part_bytes", part_bytes).load(root)
    made = rows.groupBy("path", "part").agg(F.min("timestamp_seconds").alias("low"), F.max("timestamp_seconds").alias("high"))
    later = F.max("part").over(Window.partitionBy("path"))
    full = made.withColumn("later", later).filter("part < later").drop("later").withColumn("part_bytes", F.lit(part_bytes))
    full.coalesce(1).write.mode("overwrite").parquet(index)


def index_rows(index: str, part_bytes: int) -> dict[tuple[str, int], tuple[float, float]]:
    import pyarrow.parquet as pq

    fs, at = opened(index)
    rows = pq.read_table(at, filesystem=fs).to_pylist()
    if any(r["part_bytes"] != part_bytes for r in rows):
        raise ValueError(f"the index {index} is of parts of another size than {part_bytes} bytes")
    return {(r["path"], r["part"]): (r["low"], r["high"]) for r in rows}


def within(known: tuple[float, float] | None, lo: float | None, hi: float | None) -> bool:
    """Whether a part with times ``known`` can hold rows of the window."""
    if known is None:
        return True
    low, high = known
    return low is not None and (lo is None or high >= lo) and (hi is None or low <= hi)


def typed(messages: DataFrame, topics: dict[str, str]) -> dict[str, DataFrame]:
    """Messages of each topic as a struct of its schema (DDL), the text's fields by name."""
    one = lambda ddl: F.from_json("message", ddl)
    return {topic: messages.filter(F.col("topic") == topic).withColumn("message", one(ddl)) for topic, ddl in topics.items()}


def in_order() -> list[Column]:
    """The order of a topic's lines."""
    return [F.col(c) for c in ("log_id", "topic", "seq", "path")]


def numbered(messages: DataFrame, huge: bool = False) -> DataFrame:
    """Messages whose ``seq`` are numbers from 0 in the order of a topic's lines, instead of positions in bytes. With ``huge`` a
    topic is numbered by ranges. Number a whole topic: a window has numbers of its own."""
    made = row_index(messages, ["log_id", "topic"], ["seq", "path"], huge)
    return made.withColumn("seq", F.col("row_index")).drop("row_index")
