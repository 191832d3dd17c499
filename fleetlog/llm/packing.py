"""Packing: bounded-space online best fit.

Each partition streams its documents past a fixed number of open windows. A piece goes to the
window it fills best; when none holds it, the fullest is emitted (topped up with the head of the
piece if the gap is worth a cut). What is open at the end is merged: within the partition, then
over groups of partitions, so that one padded window a group is left.

Defined cases: a null or empty text is the end id alone; repeated rows and null ids are packed
like any others; an empty table gives no pieces; other columns are ignored; ties go to the window
opened first; a very long text fills windows of its own, and only its end is placed.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stage
from ._tokens import encoder, slices

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
ARROW = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    + [("ids", pa.binary())]
)
STAGED = ARROW.append(pa.field("part", pa.int64())).append(pa.field("open", pa.bool_()))
BATCH = 20_000


class Windows:
    """At most ``most`` open windows; ``done`` gets (window, full) lists of pieces.

    A piece is (doc_id, start, doc_tokens, ids) with ids as bytes, four a token.
    """

    def __init__(self, size: int, most: int, min_cut: int):
        self.size, self.most, self.min_cut = size, most, min_cut
        self.order: list[tuple[int, int]] = []  # (room, number) of open windows
        self.held: dict[int, list] = {}
        self.opened = 0

    def place(self, doc_id: int, ids: bytes) -> Iterator[list]:
        total, start = len(ids) // 4, 0
        while total - start >= self.size:
            yield [(doc_id, start, total, ids[4 * start : 4 * (start + self.size)])]
            start += self.size
        while start < total:
            need = total - start
            at = bisect_left(self.order, (need, -1))
            if at < len(self.order):  # best fit
                room, number = self.order.pop(at)
            elif len(self.order) < self.most:
                room, number = self.size, self.opened
                self.opened += 1
                self.held[number] = []
            else:  # emit the fullest
                room, number = self.order.pop(0)
                if room >= self.min_cut:
                    self.held[number].append((doc_id, start, total, ids[4 * start : 4 * (start + room)]))
                    start += room
                yield self.held.pop(number)
                continue
            self.held[number].append((doc_id, start, total, ids[4 * start :]))
            if room == need:
                yield self.held.pop(number)
            else:
                insort(self.order, (room - need, number))
            return

    def rest(self) -> tuple[list[list], list]:
        """Full windows from what is open, and one that is not full."""
        return cut([p for n in sorted(self.held) for p in self.held[n]], self.size)


def cut(pieces: list, size: int) -> tuple[list[list], list]:
    """Pieces one after another, cut at each multiple of ``size``: full windows and the last."""
    full, now, room = [], [], size
    for doc_id, start, total, ids in pieces:
        while ids:
            now.append((doc_id, start, total, ids[: 4 * room]))
            start, took, ids = start + room, len(now[-1][3]) // 4, ids[4 * room :]
            room -= took
            if not room:
                full.append(now)
                now, room = [], size
    return full, now


def rows(window: list, sequence_id: int, with_ids: bool) -> Iterator[tuple]:
    offset = 0
    for doc_id, start, total, ids in window:
        n = len(ids) // 4
        yield doc_id, start, n, zlib.crc32(ids), total, sequence_id, offset, ids if with_ids else None
        offset += n


def batch(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*found)) if found else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    size: int = 2048,
    open_windows: int = 64,
    min_cut: int = 16,
    group: int = 32,
    with_ids: bool = True,
) -> DataFrame:
    """One row for each piece of the documents' ids: where it lies in which sequence.

    ``tokenizer`` is a file of the tokenizers library. ``min_cut``: a smaller gap is padded, not
    filled. ``group``: so many partitions merge their last windows in one task. Without
    ``with_ids`` the ids themselves are left out once they are in place.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        windows, encode = Windows(size, open_windows, min_cut), encoder(tokenizer).encode
        end, made, sequence = np.array([end_id], "<u4").tobytes(), [], part << 32
        for b in batches:
            for low, high in slices(b.column(1)):
                ids, starts, ends = encode(b.column(1)[low:high])
                for doc_id, at, to in zip(b.column(0)[low:high].to_pylist(), starts.tolist(), ends.tolist()):
                    for window in windows.place(doc_id, ids[at:to].tobytes() + end):
                        made += [(*r, part, False) for r in rows(window, sequence, with_ids)]
                        sequence += 1
                    if len(made) >= BATCH:
                        yield batch(made, STAGED)
                        made = []
        full, last = windows.rest()
        for window in full:
            made += [(*r, part, False) for r in rows(window, sequence, with_ids)]
            sequence += 1
        made += [(*r, part, True) for r in rows(last, sequence, True)]
        yield batch(made, STAGED)

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("offset", "ascending")])
        pieces = list(zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))))
        full, last = cut(pieces, size)
        first = (1 << 61) + (key[0].as_py() << 32)
        return pa.Table.from_batches(
            [batch([r for i, w in enumerate([*full, last]) for r in rows(w, first + i, with_ids)], ARROW)]
        )

    made = stage(docs.select("doc_id", "text").mapInArrow(packed, f"{PIECE}, part long, open boolean"), "packed")
    names = [f.name for f in ARROW]
    rest = made.filter("open").withColumn("group", F.floor(F.col("part") / group))
    return made.filter("NOT open").select(*names).union(rest.groupBy("group").applyInArrow(merged, PIECE).select(*names))
