"""Token ids as length-delimited binary records with a separate offset index.

A record is: payload length (uint64), masked CRC-32 of those eight bytes (uint32), payload, masked
CRC-32 of the payload (uint32), all little-endian. The payload is doc_id (int64) and the ids, two
bytes each where the vocabulary allows, else four. The mask rotates the checksum right by 15 bits
and adds 0xa282ead8, so that a checksum of data that holds checksums stays telling. The index has
for each record doc_id (int64), byte offset (uint64) and ids (uint64), for shuffled reads.

Shards are ranges of doc_id, so files in name order are in doc_id order, and are cut by bytes. A task
writes under a name of its own and renames, so a lost or repeated task leaves whole files only.

Defined cases: null or empty texts are the end id alone; a null doc_id is written as -2^63, comes
first and is read back as null; repeated rows are repeated records, ordered by text hash; an empty
table gives no records; other columns are ignored; a very long text is one record, which a task holds
whole.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import new_folder, partitions
from ._tokens import encoder, slices

NO_ID = -(1 << 63)
ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("ids", "<u8")])
MANIFEST = pa.schema([("shard", pa.string()), ("records", pa.int64()), ("ids", pa.int64())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def read_record(f, offset: int | None = None) -> bytes | None:
    """The payload at ``offset``, or the next one; None at the end. Raises on damage."""
    if offset is not None:
        f.seek(offset)
    head = f.read(12)
    if not head:
        return None
    size, crc = struct.unpack("<QI", head)
    if crc != masked(head[:8]):
        raise ValueError("damaged record length")
    payload, crc = f.read(size), f.read(4)
    if len(payload) != size or struct.unpack("<I", crc)[0] != masked(payload):
        raise ValueError("damaged record")
    return payload


def split_payload(payload: bytes, width: int) -> tuple[int | None, np.ndarray]:
    doc_id = struct.unpack("<q", payload[:8])[0]
    return None if doc_id == NO_ID else doc_id, np.frombuffer(payload, f"<u{width}", offset=8)


def opened(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Shards:
    """Writes records one after another and begins a new shard when one has ``most`` bytes.

    A shard is written under a name of its own and renamed when it is whole.
    """

    def __init__(self, folder: str, width: int, most: int):
        self.fs, self.base = opened(folder)
        self.fs.create_dir(self.base)
        self.width, self.most, self.made, self.f = width, most, [], None

    def open(self) -> None:
        self.name = f"shard-{TaskContext.get().partitionId():07d}-{len(self.made):06d}-w{self.width}"
        self.own, self.index, self.at, self.ids = f"{self.base}/.{self.name}-{uuid.uuid4().hex}", [], 0, 0
        self.f = self.fs.open_output_stream(f"{self.own}.rec")

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        if not self.f:
            self.open()
        record = framed(struct.pack("<q", doc_id) + ids.astype(f"<u{self.width}").tobytes())
        self.f.write(record)
        self.index.append((doc_id, self.at, len(ids)))
        self.at, self.ids = self.at + len(record), self.ids + len(ids)
        if self.at >= self.most:
            self.close()

    def close(self) -> None:
        if not self.f:
            return
        self.f.close()
        self.f = None
        with self.fs.open_output_stream(f"{self.own}.idx") as f:
            f.write(np.array(self.index, ENTRY).tobytes())
        for kind in ("rec", "idx"):
            self.fs.move(f"{self.own}.{kind}", f"{self.base}/{self.name}.{kind}")
        self.made.append({"shard": self.name, "records": len(self.index), "ids": self.ids})


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, shard_bytes: int = 256 << 20) -> DataFrame:
    """Write ``docs`` to ``folder``; the manifest: shard, records, ids.

    The number of ranges follows the texts' bytes, and a range with more than ``shard_bytes`` of records
    (or one record) is cut into several shards.
    """
    spark = docs.sparkSession

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4")
        shards = Shards(folder, 2 if max(enc.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else 4, shard_bytes)
        for b in batches:
            for low, high in slices(b.column(1)):
                ids, starts, ends = enc.encode(b.column(1)[low:high])
                for doc_id, at, to in zip(b.column(0)[low:high].to_pylist(), starts.tolist(), ends.tolist()):
                    shards.add(NO_ID if doc_id is None else doc_id, np.append(ids[at:to], end))
        shards.close()
        yield pa.RecordBatch.from_pylist(shards.made, MANIFEST)

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    done = (
        docs.select("doc_id", "text")
        .repartitionByRange(max(partitions(spark), -(-size // shard_bytes)), *order)
        .sortWithinPartitions(*order)
        .mapInArrow(written, "shard string, records long, ids long")
    )
    done.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of ``folder``: doc_id, start (ids before it), n_tokens and ids (uint32 bytes).

    Shards are read by their index; ``start`` adds the ids of earlier shards
    (a running sum over shards, one small row each) to the index's own running sum.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(folder)
        for b in batches:
            for shard, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                width = int(shard.rpartition("w")[2])
                with fs.open_input_stream(f"{base}/{shard}.idx") as f:
                    index = np.frombuffer(f.read(), ENTRY)
                with fs.open_input_file(f"{base}/{shard}.rec") as f:
                    found, held = [], 0
                    for entry in index:
                        doc_id, ids = split_payload(read_record(f, int(entry["offset"])), width)
                        found.append((doc_id, start, len(ids), ids.astype("<u4").tobytes()))
                        start, held = start + len(ids), held + 4 * len(ids)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*found), READ)], schema=READ)
                            found, held = [], 0
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*found), READ)], schema=READ)

    return shards.repartition(max(partitions(spark), manifest.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def output_folder(spark: SparkSession) -> str:
    return new_folder(spark, "token-records")
