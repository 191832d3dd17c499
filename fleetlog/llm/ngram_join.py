"""N-gram Jaccard join by a token-group matrix.

Sets of word shingles are partitioned into groups of similar sets. The matrix says which groups hold
which tokens; a set is compared only with groups that can hold a partner: enough of the set's
rarest tokens (its prefix) are in the group's row of the matrix (prefixes are a little longer than
one shared token would need, so as many more must be shared), sizes fit, and at least the share
``percent`` of all its tokens is in the group's union. Inside an opened group overlaps are counted
exactly. The join loses no link; links that join nothing new within a task are not written out.

1. One pass gives each document its set's size and class (equal sets are one class) and a count
   sketch of tokens, 2 MB at any input size, which only orders tokens from rare to common.
2. A second pass sends each set's prefix, packed, to ranges of tokens. Tokens that a single class
   holds end there.
3. A class joins the group of its commonest shared token; large groups are split.
   Members of a home that is split meet a few pivots first; those which that connects don't meet again.
4. Classes that share a prefix token with a group are its queries. Whole sets are made again for the
   classes concerned only, and met in blocks: one group of bounded size, a bounded number of queries.

Defined cases: A-Z are lower-cased and words split at ASCII white space; fewer words than a shingle
are one shingle; null or wordless texts have no shingles and no links; a null doc_id gets its size
and a null component; repeated rows share a class; an empty table gives an empty result; other
columns are ignored; all shingles of very long texts count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import stage
from ._tokens import slices
from .components import components

SKETCH_BITS, SLICES = 18, 16
SPARE = 20  # a prefix is longer than it must be by a part in so many, and must share that much more
CLASS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.binary()), ("key", pa.int64()), ("slice", pa.int64())])
SENT = pa.schema([("range", pa.int64()), ("tokens", pa.binary()), ("owner", pa.binary()), ("keys", pa.binary()), ("n", pa.binary())])
SHARED = pa.schema([("token", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("holders", pa.int64())])
SETS = pa.schema([("cls", pa.binary()), ("text", pa.binary())])
HOT = 10_000  # a class with more than one in so many of all rows is joined by broadcast: at most so many rows
TEXT_BYTES = 4 << 20
PIVOTS = 8  # sets of a crowded home that all others of it meet first
LINK = pa.schema([("u", pa.int64()), ("v", pa.int64())])


class Words(dict):
    """Word hashes, made as they are met; bounded."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


WORDS = Words()


def shingles(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    v = h[: len(h) - size + 1] + np.uint64(size)
    for j in range(1, size):
        v = v * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - size + 1 + j]
        v ^= v >> np.uint64(31)
    return np.unique(v * np.uint64(0xD6E8FEB86659FD93))


def class_of(tokens: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh128_digest(tokens.tobytes())


def key_of(cls: bytes) -> int:
    """Half of a class's name: enough to find candidates by, which whole names then decide."""
    return int.from_bytes(cls[:8], "little", signed=True)


def packed(data: bytes) -> bytes:
    import zstandard

    return zstandard.compress(data, 1)


def unpacked(data: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(data)


def sorted_numbers(t: np.ndarray) -> bytes:
    """Sorted numbers of 48 bits by their gaps, a byte plane after the other."""
    return packed(np.diff(t, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes())


def from_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unpacked(data), np.uint8).reshape(6, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :6] = planes.T
    return np.cumsum(wide.view("<u8").ravel()).view(np.int64)


def texts(b: pa.RecordBatch) -> Iterator[bytes | None]:
    """A batch's texts, of which only a few MB at a time are held twice."""
    for low, high in slices(b.column(1), TEXT_BYTES):
        yield from b.column(1).slice(low, high - low).cast(pa.large_binary()).to_pylist()


def made(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def classify(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, cls, key) of every document, and the sketch."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, held, size = np.zeros(1 << SKETCH_BITS, np.int64), [], 0

        def count() -> None:
            if held:
                cells = (np.concatenate(held) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                sketch[:] += np.bincount(cells, minlength=len(sketch))
                held.clear()

        for b in batches:
            n, cls = [], []
            for text in texts(b):
                tokens = shingles(text)
                n.append(len(tokens))
                cls.append(class_of(tokens))
                held.append(tokens)
                size += len(tokens)
                if size > 1 << 18:
                    count()
                    size = 0
            yield made(CLASS, b.column(0), n, cls, list(map(key_of, cls)), [None] * len(n))
        count()
        parts = [zlib.compress(p.tobytes(), 1) for p in np.split(sketch, SLICES)]
        yield made(CLASS, [None] * SLICES, [-1] * SLICES, parts, [None] * SLICES, list(range(SLICES)))

    def add(key: tuple, t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in t.column("cls").to_pylist())
        return pa.table({"slice": [key[0].as_py()], "total": [total.tobytes()]})

    found = stage(docs.select("doc_id", "text").mapInArrow(read, "doc_id long, n long, cls binary, key long, slice long"), "join-classes")
    slices = found.filter("slice IS NOT NULL").groupBy("slice").applyInArrow(add, "slice long, total binary")
    parts = {r["slice"]: np.frombuffer(bytes(r["total"]), np.int64) for r in slices.collect()}
    empty = np.zeros((1 << SKETCH_BITS) // SLICES, np.int64)
    return found.filter("slice IS NULL").drop("slice"), np.concatenate([parts.get(i, empty) for i in range(SLICES)])


def shared_tokens(docs: DataFrame, sketch: np.ndarray, percent: int, ranges: int) -> DataFrame:
    """Prefix tokens that classes of fitting sizes share: token, key, n and how many hold it."""
    rarity = docs.sparkSession.sparkContext.broadcast(sketch)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, tokens, owner, keys, n, size = set(), [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            t, o = np.concatenate(tokens), np.concatenate(owner)
            order = np.argsort(t, kind="stable")
            t, o = t[order], o[order]
            to = ((t >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            first, rows = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]), []
            for low, high in zip(first.tolist(), [*first[1:].tolist(), len(to)]):
                names, who = np.unique(o[low:high], return_inverse=True)
                own = [np.array([x[i] for i in names], np.int64).tobytes() for x in (keys, n)]
                rows.append((int(to[low]), sorted_numbers(t[low:high] >> np.uint64(16)), who.astype(np.uint16).tobytes(), *own))
            for x in (tokens, owner, keys, n):
                x.clear()
            return made(SENT, *zip(*rows))

        for b in batches:
            for text in texts(b):
                found = shingles(text)
                if not len(found):
                    continue
                key = key_of(class_of(found))
                if key in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(key)
                order = np.lexsort((found, rarity.value[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))
                prefix = found[order[: len(found) - -(-percent * len(found) // 100) + 1 + len(found) // SPARE]]
                tokens.append(prefix)
                owner.append(np.full(len(prefix), len(keys)))
                keys.append(key)
                n.append(len(found))
                size += len(prefix)
                if size > 1 << 19 or len(keys) == 1 << 16:
                    yield flush()
                    size = 0
        if keys:
            yield flush()

    def meet(t: pa.Table) -> pa.Table:
        token, who, n, names, base = [], [], [], [], 0
        for part, owner, keys, sizes in zip(*(t.column(c).to_pylist() for c in ("tokens", "owner", "keys", "n"))):
            token.append(from_sorted(part))
            own = np.frombuffer(owner, np.uint16).astype(np.int64)
            who.append(own + base)
            n.append(np.frombuffer(sizes, np.int64)[own])
            names.append(np.frombuffer(keys, np.int64))
            base += len(names[-1])
        token, who, n, names = map(np.concatenate, (token, who, n, names))
        # One number a class, whichever task it came from.
        names, number = np.unique(names, return_inverse=True)
        who = number[who]
        order = np.lexsort((who, n, token))
        token, who, n = token[order], who[order], n[order]
        new = np.r_[True, (token[1:] != token[:-1]) | (who[1:] != who[:-1])]
        token, who, n = token[new], who[new], n[new]
        fits = np.r_[(token[1:] == token[:-1]) & (100 * n[:-1] >= percent * n[1:]), False]
        keep = fits | np.r_[False, fits[:-1]]
        token, who, n = token[keep], who[keep], n[keep]
        _, at, holders = np.unique(token, return_inverse=True, return_counts=True)
        return pa.Table.from_batches([made(SHARED, token, names[who], n, holders[at])])

    sent = docs.select("doc_id", "text").mapInArrow(send, "range long, tokens binary, owner binary, keys binary, n binary")
    return sent.groupBy("range").applyInArrow(meet, "token long, key long, n long, holders long")


def needed(n: Column) -> Column:
    """How many prefix tokens partners of sizes n or more share at least."""
    return F.floor(n / SPARE) + 1


def smallest_partner(percent: int) -> Column:
    return F.ceil(percent * F.col("n") / 100)


def likely(shared: DataFrame, percent: int) -> DataFrame:
    """Tokens of the classes that share enough of them to have a partner, and the class's ``home``, its
    commonest shared token."""
    w = Window.partitionBy("key")
    made = shared.withColumns({"k": F.count("*").over(w), "home": F.max(F.struct("holders", "token")).over(w)["token"]})
    return made.filter(F.col("k") >= needed(smallest_partner(percent))).select("token", "key", "n", "home")


def bitmap_of(ids: DataFrame, n: int) -> np.ndarray:
    """Bits at the hashes of ``n`` ``ids`` (doc_id), 16 bits an id: a filter that lets all of them through,
    and few others."""
    bits = 1 << max(16, (16 * n - 1).bit_length())
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    rows = (
        ids.select(F.floor(at / 32768).alias("bucket"), F.pmod(at, F.lit(32768)).alias("bit"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bitmap"))
        .collect()
    )
    out = np.zeros((bits // 32768, 4096), np.uint8)
    for r in rows:
        out[r["bucket"]] = np.frombuffer(bytes(r["bitmap"]), np.uint8)
    return out.ravel()


def sets_of(docs: DataFrame, wanted: DataFrame, most: int = 1 << 24) -> DataFrame:
    """(cls, text) of the documents ``wanted`` (doc_id), and of a few others; texts are compressed, as
    their words take less room than their tokens. More than ``most`` documents (whose filter would have
    over 64 MB) are found by a join instead."""
    n = wanted.count()
    docs = docs.filter("doc_id IS NOT NULL").select("doc_id", "text")
    filtered = None
    if n > most:
        docs = docs.join(wanted, "doc_id", "left_semi")
    else:
        filtered = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted, n))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            if filtered:
                bits = filtered.value
                h = b.column(2).to_numpy().astype(np.uint64) % np.uint64(8 * len(bits))
                hit = (bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1
                b = b.filter(pa.array(hit.astype(bool)))
            found = {}
            for text in texts(b):
                if len(tokens := shingles(text)) and (cls := class_of(tokens)) not in seen:
                    found[cls] = packed(text)
            if len(seen) < 200_000:  # copies in one task are sent once
                seen.update(found)
            yield made(SETS, list(found), list(found.values()))

    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62)).alias("h")
    return docs.select("doc_id", "text", h).mapInArrow(read, "cls binary, text binary")


def compare(met: pa.Table, first: bool, percent: int) -> list[tuple[int, int]]:
    """Links between members (if ``first``) and of queries to members that join something new."""
    rows = {}
    for rep, asks, text in zip(*(met.column(c).to_pylist() for c in ("rep", "asks", "text"))):
        rows[asks, rep] = shingles(unpacked(text))  # a set may have been sent by several tasks
    rows = sorted(rows.items(), key=lambda x: x[0])
    ids, sets = [rep for (_, rep), _ in rows], [x for _, x in rows]
    m, sizes = sum(not asks for (asks, _), _ in rows), np.array([len(x) for x in sets])
    if not m:
        return []
    token, who = np.concatenate(sets[:m]), np.repeat(np.arange(m), sizes[:m])
    order = np.argsort(token, kind="stable")
    token, who = token[order], who[order]
    union, start, count = np.unique(token, return_index=True, return_counts=True)
    root, links = list(range(len(ids))), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for q in range(0 if first else m, len(ids)):
        at = np.minimum(np.searchsorted(union, sets[q]), len(union) - 1)
        at = at[union[at] == sets[q]]
        if 100 * len(at) < percent * sizes[q]:  # the group's union cannot hold enough of the query
            continue
        lengths = count[at]
        steps = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        both = np.bincount(who[np.repeat(start[at], lengths) + steps], minlength=m)
        for i in np.flatnonzero(100 * both >= percent * (sizes[q] + sizes[:m] - both)).tolist():
            a, b = top(q), top(i)
            if a != b:
                root[a] = b
                links.append((ids[q], ids[i]))
    return links


def pieces(n: Column, tokens: Column, most: int, room: int) -> Column:
    """Into how many parts ``n`` sets of so many ``tokens`` are cut: at most ``most`` sets each, and about
    ``room`` tokens."""
    return F.greatest(F.ceil(n / most), F.ceil(tokens / room))


def compared(docs: DataFrame, wanted: DataFrame, going: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) found where ``going`` (cls, rep, grp, block, asks) sends the sets of ``wanted``; members
    meet each other in block 0."""

    def check(key: tuple, met: pa.Table) -> pa.Table:
        found = compare(met, key[1].as_py() == 0, percent)
        return pa.Table.from_batches([made(LINK, *(zip(*found) if found else ([], [])))])

    sent = sets_of(docs, wanted).join(going, "cls").select("grp", "block", "rep", "asks", "text")
    return sent.groupBy("grp", "block").applyInArrow(check, "u long, v long")


def settled(member: DataFrame, crowded: DataFrame, docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links of the members of ``crowded`` homes (home, parts) to a few pivots of theirs, and ``member`` with
    what they settle: ``top``, the component that most of a home's members are in; ``settled``, the same for
    those members; and ``loose``, whether a member of such a home is not. Each set is sent once."""
    inside = member.withColumn("home", F.col("grp.home")).join(crowded, "home")
    chosen = F.min(F.struct(F.xxhash64(F.lit(5), "cls").alias("h"), "cls", "rep")).alias("p")
    pivots = inside.groupBy("home", "parts", F.pmod(F.xxhash64("cls"), F.lit(PIVOTS)).alias("slot")).agg(chosen)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    pivots = pivots.select("p.cls", "p.rep", "home", every).select("cls", "rep", F.struct("home", "part").alias("grp"), F.lit(False).alias("asks"))
    going = stage(inside.select("cls", "rep", "grp", F.lit(True).alias("asks")).union(pivots).withColumn("block", F.lit(1).cast("long")), "join-pivots")
    links = stage(compared(docs, inside.select(F.col("rep").alias("doc_id")), going, percent), "join-pivot-links")
    reached = components(links)
    label = inside.join(reached, inside.rep == reached.node, "left").select("home", "cls", F.coalesce("component", "rep").alias("label"))
    most = label.groupBy("home", "label").agg(F.count("*").alias("n")).groupBy("home").agg(F.max(F.struct("n", "label"))["label"].alias("top"))
    label = label.join(most, "home").select("cls", "label", "top")
    tagged = member.join(label, "cls", "left").withColumns(
        {"settled": F.when(F.col("label") == F.col("top"), F.col("top")), "loose": F.coalesce(F.col("label") != F.col("top"), F.lit(False))}
    )
    return links, stage(tagged.drop("label"), "join-settled")


def links_of(shared: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, group_size: int, block: int, room: int) -> DataFrame:
    """Links (u, v) between the smallest doc_ids of classes; enough of them to connect all that link.

    Members of one component of their home don't ask groups whose home mostly is in that component, as all
    of those are connected already; the few loose ones of such groups ask them.
    """
    reps = classes.filter("n > 0 AND doc_id IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("key").alias("key"), F.first("n").alias("n"))
    home = shared.groupBy("key").agg(F.first("home").alias("home"))
    home = stage(home.join(reps, "key"), "join-homes")
    parts = home.groupBy("home").agg(pieces(F.count("*"), F.sum("n"), group_size, room).alias("parts"))
    grp = F.struct("home", F.pmod(F.xxhash64("cls"), "parts").alias("part")).alias("grp")
    member = stage(home.join(parts, "home").select("cls", "key", "n", "rep", grp), "join-groups")
    crowded, links = stage(parts.filter("parts > 1"), "join-crowded"), None
    if crowded.isEmpty():
        none = F.lit(None).cast("long")
        member = member.withColumns({"top": none, "settled": none, "loose": F.lit(False)})
    else:
        links, member = settled(member, crowded, docs, percent)
    held = shared.select("token", "key", "n").join(member.select("key", "grp", "settled", "loose"), "key")
    row = held.groupBy("token", F.col("grp").alias("to")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    group = member.groupBy(F.col("grp").alias("to")).agg(F.min("n").alias("smallest"), F.max("top").alias("top"), F.count("*").alias("members"), F.bool_or("loose").alias("any_loose"))
    asks = (F.col("grp") > F.col("to")) | (F.col("loose") & (F.col("grp") != F.col("to")))
    query = stage(
        held.join(row, "token")
        .filter(asks & (100 * F.col("n") >= percent * F.col("least")) & (100 * F.col("most") >= percent * F.col("n")))
        .groupBy("key", "n", "to", "settled")
        .agg(F.count("*").alias("k"))
        .join(group, "to")
        .filter(F.col("k") >= F.least(needed(F.col("n")), F.greatest(needed(F.col("smallest")), needed(smallest_partner(percent)))))
        .filter("settled IS NULL OR top IS NULL OR settled <> top")
        .select("key", F.col("to").alias("grp")),
        "join-queries",
    )
    # Alone in a group that nobody opens, and opening none: no partner.
    crowd = group.filter("members > 1 AND (top IS NULL OR any_loose)").select(F.col("to").alias("grp"))
    met = member.join(crowd.union(query.select("grp")).distinct(), "grp", "left_semi").select("key").union(query.select("key"))
    member = stage(member.select("cls", "key", "n", "rep", "grp").join(met, "key", "left_semi"), "join-met")
    # Where each set is to go, before any set moves: members to all blocks of their group, queries to one.
    query = query.join(member.select("cls", "key", "n", "rep"), "key")
    blocks = query.groupBy("grp").agg(pieces(F.count("*"), F.sum("n"), block, room).alias("blocks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1)).alias("block")
    mine = member.join(blocks, "grp", "left").select("cls", "rep", "grp", every, F.lit(False).alias("asks"))
    theirs = query.join(blocks, "grp").select("cls", "rep", "grp", F.pmod(F.xxhash64("cls"), "blocks").alias("block"), F.lit(True).alias("asks"))
    going = stage(mine.union(theirs), "join-going")
    found = compared(docs, member.select(F.col("rep").alias("doc_id")), going, percent)
    return found if links is None else found.union(links)


def with_top(classes: DataFrame, top: DataFrame) -> DataFrame:
    """``classes`` with their class's ``top``; classes with very many rows by broadcast, so that no task
    gathers theirs."""
    rows = classes.groupBy("cls").agg(F.count("*").alias("rows")).filter(F.col("rows") > classes.count() / HOT)
    hot = stage(rows.join(top, "cls").select("cls", F.col("top").alias("hot_top")), "join-hot")
    marked = classes.join(F.broadcast(hot), "cls", "left")
    held = [*classes.columns, "top"]
    cold = marked.filter("hot_top IS NULL").join(top, "cls", "left").select(*held)
    return cold.union(marked.filter("hot_top IS NOT NULL").withColumnRenamed("hot_top", "top").select(*held))


def jaccard_join(docs: DataFrame, percent: int = 75, group_size: int = 1024, block: int = 512, range_rows: int = 8192, room: int = 1 << 21) -> DataFrame:
    """For each document: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest doc_id that
    links of ``percent`` Jaccard or more reach. Two documents with equal sets are linked.

    ``group_size`` and ``block``: sets of a group, and queries that meet it in one task; ``room``: about as
    many tokens as each of the two may hold. ``range_rows``: documents for each range of tokens.
    """
    classes, sketch = classify(docs)
    ranges = max(8, classes.count() // range_rows)
    shared = stage(likely(shared_tokens(docs, sketch, percent, ranges), percent), "join-shared")
    reached = components(links_of(shared, classes, docs, percent, group_size, block, room))
    reps = classes.filter("doc_id IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"))
    top = reps.join(reached, reps.rep == reached.node, "left").select("cls", F.coalesce("component", "rep").alias("top"))
    own = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("top"))
    return with_top(classes.select("doc_id", "n", "cls"), stage(top, "join-tops")).select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
