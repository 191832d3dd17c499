"""Suffix-array dedup: bytes that an earlier document already holds, by a distributed merge sort.

A byte is removed if a string of ``length`` bytes that covers it also starts in a document with a
smaller id. Texts are UTF-8 bytes in chunks of whole documents.

1. Each chunk picks anchor positions so that equal windows of ``length`` bytes pick the same place
   (modulo minimisers), and sends only hashes of the bytes after each anchor. Anchors whose hash no
   other document has are settled: their suffixes need no order.
2. The other suffixes, cut at ``length`` bytes and followed by the bytes before them, are sorted in
   each chunk, equal ones made one (with the smallest doc_id), front-coded and exchanged by ranges.
3. A range combines its runs with a loser tree that keeps, for each string, the prefix it shares
   with the last winner, and compares on from there only. The merged order and its common prefixes
   give the groups of equal windows and each group's smallest doc_id.
4. The answers, a few bits a string, go back to the chunks, which cover their bytes.

Between steps a chunk is read from one and the same shuffle of the texts. A string that a third of
all documents hold is one entry a chunk, so no task gathers its holders.

Defined cases: null texts are empty and stay empty; rows with a null doc_id are kept whole and are
no sources; rows with equal doc_ids don't remove from each other; texts shorter than ``length`` stay;
an empty table gives an empty result; other columns are ignored; a very long text is a chunk of its
own or makes one larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 50
STEP = 17  # anchors of equal windows lie less than this after their starts
KMER = LENGTH - STEP + 1
TMER = 17  # (KMER - 4) % STEP + 4: the length whose minimum picks the anchor
LEFT = STEP - 1
WIDTH = LENGTH + 1 + LEFT + 1  # suffix, its length, bytes before it (nearest first), their number
BASE = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 1 << 16  # positions worked on at once
MOST_DRAWN = 1_000_000  # strings that the driver draws range bounds from; more ranges need larger ``range_bytes``
SENT = pa.schema([("part", pa.int64()), ("sender", pa.int64()), ("payload", pa.binary())])
BACK = pa.schema([("home", pa.int64()), ("kind", pa.int64()), ("part", pa.int64()), ("payload", pa.binary())])
RUN = pa.schema([("part", pa.int64()), ("sender", pa.int64()), ("shared", pa.binary()), ("tails", pa.binary()), ("least", pa.binary())])
KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
ddl = lambda s: ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary'}" for f in s)


def power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Chunk:
    """The documents of a chunk, one after another, in an order that is the same in every step."""

    def __init__(self, t: pa.Table):
        ids = t.column("doc_id").to_pylist()
        texts = [x or b"" for x in t.column("text").cast(pa.large_binary()).to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
        self.ids, self.texts = [ids[i] for i in order], [texts[i] for i in order]
        self.bytes = np.frombuffer(b"".join(self.texts), np.uint8)
        self.ends = np.cumsum([len(x) for x in self.texts], dtype=np.int64)
        self.starts = self.ends - [len(x) for x in self.texts]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, hashes of the bytes after them, and documents of the anchors."""
        positions, hashes = [], []
        for at in range(0, len(self.bytes), BLOCK - LENGTH):
            d = self.bytes[at : at + BLOCK].astype(np.uint64) + np.uint64(1)
            if len(d) < LENGTH:
                break
            h2 = d[:-1] * power(1) + d[1:]
            h4 = h2[:-2] * power(2) + h2[2:]
            h8 = h4[:-4] * power(4) + h4[4:]
            h16 = h8[:-8] * power(8) + h8[8:]
            h17 = h16[:-1] * power(1) + d[16:]
            m = mixed(h17) & ~np.uint64(BLOCK - 1) | np.arange(len(h17), dtype=np.uint64)
            for s in (1, 2, 4, 8, 16):
                m = np.minimum(m[:-s], m[s:])
            m = np.minimum(m[:-2], m[2:])  # over the 34 positions of a window
            start = np.arange(len(m))
            first = (m & np.uint64(BLOCK - 1)).astype(np.int64)
            picked = np.zeros(len(d), bool)
            picked[(start + (first - start) % STEP)[start + LENGTH <= self.limits(at, len(m))]] = True
            a = np.flatnonzero(picked)
            h32 = h16[a] * power(16) + h16[a + 16]
            positions.append(a + at)
            hashes.append(mixed(h32 * power(2) + h2[a + 32]) >> np.uint64(16))
        if not positions:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        position, hashes = np.concatenate(positions), np.concatenate(hashes)
        order = np.argsort(position, kind="stable")
        order = order[np.r_[True, np.diff(position[order]) > 0]]  # blocks overlap
        position, hashes = position[order], hashes[order]
        doc = np.searchsorted(self.ends, position, "right")
        sound = np.array([i is not None for i in self.ids], bool)[doc]
        return position[sound], hashes[sound], doc[sound]

    def limits(self, at: int, n: int) -> np.ndarray:
        """Where the document of each of ``n`` bytes from ``at`` on ends, counted from ``at``."""
        first, last = np.searchsorted(self.ends, (at, at + n - 1), "right")
        ends = self.ends[first : last + 1] - at
        return np.repeat(ends, np.diff(np.minimum(ends, n), prepend=0))

    def run(self, elsewhere: np.ndarray) -> "Run":
        """Sorted distinct strings at the anchors that several documents share."""
        position, h, doc = self.anchors()
        ids = np.array([i or 0 for i in self.ids], np.int64)[doc]
        order = np.lexsort((ids, h))
        hs, ds = h[order], ids[order]
        near = (hs[1:] == hs[:-1]) & (ds[1:] != ds[:-1])
        shared = np.isin(h, elsewhere) | np.isin(h, hs[1:][near])
        position, doc, ids = position[shared], doc[shared], ids[shared]
        right = np.minimum(self.ends[doc] - position, LENGTH)
        left = np.minimum(position - self.starts[doc], LEFT)
        padded = np.concatenate([np.zeros(LEFT, np.uint8), self.bytes, np.zeros(LENGTH, np.uint8)])
        key = np.zeros((len(position), WIDTH), np.uint8)
        around = np.lib.stride_tricks.sliding_window_view(padded, LEFT + LENGTH)[position]
        key[:, :LENGTH], key[:, LENGTH + 1 : -1] = around[:, LEFT:], around[:, LEFT - 1 :: -1]
        key[:, LENGTH], key[:, WIDTH - 1] = right, left + 1
        # What lies beyond the document's ends is zero.
        for own, n, first in ((right, LENGTH, 0), (left, LEFT, LENGTH + 1)):
            short = np.flatnonzero(own < n)
            key[short, first : first + n] *= np.arange(n) < own[short, None]
        strings, which = np.unique(np.ascontiguousarray(key).view(f"S{WIDTH}").ravel(), return_inverse=True)
        least = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(least, which, ids)
        matrix = np.frombuffer(strings.tobytes(), np.uint8).reshape(-1, WIDTH)
        return Run(matrix, least, position, ids, which, left, right)


class Run:
    def __init__(self, matrix, least, position, ids, which, left, right):
        self.matrix, self.least, self.position, self.ids = matrix, least, position, ids
        self.which, self.left, self.right = which, left, right

    def ends(self, splitters: np.ndarray) -> np.ndarray:
        """Where the strings of each range end; the last bytes of a splitter are no zeros. Strings that
        may hold equal windows have equal heads."""
        heads = np.ascontiguousarray(self.matrix[:, :KMER]).view(f"S{KMER}").ravel()
        return np.r_[0, np.searchsorted(heads, splitters), len(heads)]


def front_coded(matrix: np.ndarray) -> tuple[bytes, bytes]:
    """Shared prefix lengths of neighbours, and the bytes after them."""
    differs = matrix[1:] != matrix[:-1]
    shared = np.r_[0, differs.argmax(1)].astype(np.uint8)
    return packed(shared.tobytes()), packed(matrix[np.arange(WIDTH) >= shared[:, None]].tobytes())


def packed(data: bytes) -> bytes:
    import zstandard

    return zstandard.compress(data, 1)


def unpacked(data: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(data)


def strings_of(shared: bytes, tails: bytes) -> Iterator[tuple[bytes, int]]:
    """Each string of a run and the prefix it shares with the one before."""
    shared, tails, now, at = unpacked(shared), unpacked(tails), b"", 0
    for n in shared:
        end = at + WIDTH - n
        now = now[:n] + tails[at:end]
        at = end
        yield now, n


def merged(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, bytes, int]]:
    """(run, string, prefix shared with the string before) of all runs in order.

    A loser tree. Each waiting string knows how long a prefix it shares with the winner that beat
    it. Of two that share different lengths with the last winner, the longer comes first; of two that
    share the same, bytes after that prefix decide, and the loser's shared length becomes theirs.
    """
    size = 1
    while size < len(runs):
        size *= 2
    text: list[bytes] = [b""] * size
    known = [-1] * size  # a run that has ended loses to all others
    for i, r in enumerate(runs):
        text[i], known[i] = next(r, (b"", -1))

    def loses(a: int, b: int) -> bool:
        """Whether ``a`` comes after ``b``, where both share ``known`` with the last winner; the loser's
        shared length becomes theirs."""
        x, y, same = text[a], text[b], known[a]
        if x == y:
            known[b] = WIDTH if same >= 0 else -1
            return False
        rest_x, rest_y = int.from_bytes(x[same:]), int.from_bytes(y[same:])
        same = WIDTH - ((rest_x ^ rest_y).bit_length() + 7) // 8
        if rest_x < rest_y:
            known[b] = same
            return False
        known[a] = same
        return True

    loser, winner = [0] * size, [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        if known[a] < known[b] or known[a] == known[b] and loses(a, b):
            a, b = b, a
        winner[node], loser[node] = a, b
    top = winner[1] if size > 1 else 0
    while known[top] >= 0:
        yield top, text[top], known[top]
        text[top], n = next(runs[top], (b"", -1))
        known[top] = n
        node = (top + size) >> 1
        while node:
            other = loser[node]
            m = known[other]
            if n < m or n == m and loses(top, other):
                loser[node], top = top, other
                n = known[top]
            node >>= 1


def covered_bits(matrix: np.ndarray, shared: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each string of the merged order: bit o is set if the window that starts o bytes before
    the anchor also starts in a document smaller than ``least``."""
    bits = np.zeros(len(matrix), np.uint32)
    near = np.r_[shared[1:] >= KMER, False] | np.r_[False, shared[1:] >= KMER]
    if not near.any():
        return bits
    at = np.flatnonzero(near)
    group = np.cumsum(np.r_[True, shared[1:] < KMER])  # strings left out are alone in their groups
    right, left = matrix[at, LENGTH].astype(int), matrix[at, WIDTH - 1].astype(int) - 1
    before = np.ascontiguousarray(matrix[at, LENGTH + 1 : LENGTH + 1 + LEFT]).view(">u8").astype(np.uint64).reshape(-1, 2)
    for o in range(STEP):
        group = np.cumsum(np.r_[True, shared[1:] < LENGTH - o])[at]
        use = np.flatnonzero((right >= LENGTH - o) & (left >= o))
        if not len(use):
            continue
        hi = before[use, 0] >> np.uint64(64 - 8 * min(o, 8)) if o else np.zeros(len(use), np.uint64)
        lo = before[use, 1] >> np.uint64(64 - 8 * (o - 8)) if o > 8 else np.zeros(len(use), np.uint64)
        g, who = group[use], least[at][use]
        order = np.lexsort((who, lo, hi, g))
        g, hi, lo, who = g[order], hi[order], lo[order], who[order]
        new = np.r_[True, (g[1:] != g[:-1]) | (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]
        smallest = who[np.flatnonzero(new)][np.cumsum(new) - 1]
        bits[at[use[order]]] |= np.where(smallest < who, np.uint32(1 << o), np.uint32(0))
    return bits


def six_bytes(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six(payload: bytes) -> np.ndarray:
    wide = np.zeros((len(payload) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(payload, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def rows(schema: pa.Schema, found: list[tuple]) -> pa.Table:
    columns = list(zip(*found)) if found else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def remove_repeats(docs: DataFrame, chunk_bytes: int = 4 << 20, range_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each of ``docs``; ``kept``: the bytes left.

    ``chunk_bytes`` and ``range_bytes``: about how much text a chunk, and the strings of a range,
    stand for; they bound a task's memory whatever the input's size.
    """
    size = F.octet_length("text")
    total = docs.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    chunks, parts = (max(1, -(-total["bytes"] // n)) for n in (chunk_bytes, range_bytes))
    # Range bounds from a sample of strings, as large as the ranges are many: they only balance the ranges.
    drawn = min(MOST_DRAWN, max(4000, 8 * parts))
    at = F.explode(F.transform(F.sequence(F.lit(1), F.lit(-(-drawn // max(1, total["n"])))), lambda i: F.pmod(F.xxhash64("text", i), F.length("text")).cast("int") + 1))
    sample = docs.filter(size >= LENGTH).sample(min(1.0, drawn / max(1, total["n"])), seed=7).select("text", at.alias("at"))
    heads = sorted({r[0].encode()[:KMER].rstrip(b"\0") for r in sample.select(F.substring("text", F.col("at"), F.lit(KMER))).collect()})
    splitters = np.array([heads[len(heads) * i // parts] for i in range(1, parts)] if heads else [], f"S{KMER}")
    homes = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("home"))

    def hashes(key: tuple, t: pa.Table) -> pa.Table:
        h = np.unique(Chunk(t).anchors()[1])
        part = (h >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32)  # ascending, of equal width
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(h) else []
        return rows(SENT, [(int(part[a]), key[0].as_py(), six_bytes(h[a:b])) for a, b in zip(first, [*first[1:], len(h)])])

    def repeated(key: tuple, t: pa.Table) -> pa.Table:
        h = [from_six(x) for x in t.column("payload").to_pylist()]
        found, n = np.unique(np.concatenate(h), return_counts=True)
        found, out = found[n > 1], []
        for sender, own in zip(t.column("sender").to_pylist(), h):
            if len(hit := own[np.isin(own, found, assume_unique=True)]):
                out.append((sender, 0, key[0].as_py(), six_bytes(hit)))
        return rows(BACK, out)

    def known(back: pa.Table) -> np.ndarray:
        told = [from_six(p) for k, p in zip(back.column("kind").to_pylist(), back.column("payload").to_pylist()) if k == 0]
        return np.concatenate(told) if told else np.zeros(0, np.uint64)

    def runs(key: tuple, t: pa.Table, back: pa.Table) -> pa.Table:
        if not t.num_rows:
            return RUN.empty_table()
        run = Chunk(t).run(known(back))
        ends, out = np.asarray(run.ends(splitters)), []
        for r in np.flatnonzero(np.diff(ends)).tolist():  # ranges that the chunk has strings for
            a, b = ends[r], ends[r + 1]
            out.append((r, key[0].as_py(), *front_coded(run.matrix[a:b]), packed(run.least[a:b].tobytes())))
        return rows(RUN, out)

    def combine(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("sender")
        senders, shared, tails, least = (t.column(c).to_pylist() for c in ("sender", "shared", "tails", "least"))
        least = [np.frombuffer(unpacked(x), np.int64) for x in least]
        order, strings, same = [], [], []
        for run, text, n in merged([strings_of(a, b) for a, b in zip(shared, tails)]):
            order.append(run)
            strings.append(text)
            same.append(n)
        order, same = np.array(order), np.array(same)
        by_run = np.argsort(order, kind="stable")  # a run's strings keep their order
        smallest = np.empty(len(order), np.int64)
        smallest[by_run] = np.concatenate(least)
        bits = covered_bits(np.frombuffer(b"".join(strings), np.uint8).reshape(-1, WIDTH), same, smallest)[by_run]
        cut = np.cumsum([len(x) for x in least])[:-1]
        return rows(BACK, [(s, 1, key[0].as_py(), b.tobytes()) for s, b in zip(senders, np.split(bits, cut))])

    def cover(key: tuple, t: pa.Table, back: pa.Table) -> pa.Table:
        if not t.num_rows:
            return KEPT.empty_table()
        chunk = Chunk(t)
        run = chunk.run(known(back))
        told = sorted((r, p) for k, r, p in zip(*(back.column(c).to_pylist() for c in ("kind", "part", "payload"))) if k == 1)
        bits = np.frombuffer(b"".join(p for _, p in told), np.uint32)
        depth = np.zeros(len(chunk.bytes) + 1, np.int32)
        if len(run.position):
            later, own = run.ids > run.least[run.which], bits[run.which]
            for o in range(STEP):
                fits = (run.left >= o) & (run.right >= LENGTH - o)
                start = run.position[fits & (later | (own >> np.uint32(o) & 1).astype(bool))] - o
                np.add.at(depth, start, 1)
                np.add.at(depth, start + LENGTH, -1)
        gone = np.cumsum(depth, dtype=np.int32)[:-1] > 0
        begins = gone & ~np.r_[False, gone[:-1]]
        out = []
        for doc_id, text, a, b in zip(chunk.ids, chunk.texts, chunk.starts, chunk.ends):
            own = gone[a:b]
            n = int(own.sum())
            spans = int(begins[a + 1 : b].sum()) + int(own[0]) if n else 0
            out.append((doc_id, b - a, n, spans, chunk.bytes[a:b][~own].tobytes() if n else text))
        return rows(KEPT, out)

    told = homes.groupBy("home").applyInArrow(hashes, ddl(SENT)).groupBy("part").applyInArrow(repeated, ddl(BACK))
    sent = homes.groupBy("home").cogroup(told.groupBy("home")).applyInArrow(runs, ddl(RUN))
    answers = sent.groupBy("part").applyInArrow(combine, ddl(BACK))
    return homes.groupBy("home").cogroup(told.union(answers).groupBy("home")).applyInArrow(cover, ddl(KEPT))
