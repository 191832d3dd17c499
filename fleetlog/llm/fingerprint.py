"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, in DataFrame functions only.

A paragraph is a line, or a line's next piece of at most ``PIECE`` code points. A sketch is a table of
cells (count, XOR of digests, XOR of their checks); each distinct digest is added to one cell of each
third of the table. The cells of two versions subtract, so that shared paragraphs cancel out, and
peeling recovers the digests that differ: a cell with one digest left gives it away, and it is taken
out of its other cells. One third is peeled at a time, so no digest is taken out twice. The
fingerprint is a sketch of ``CELLS`` cells. Two texts are compared by the cells of their fingerprints;
where those don't peel empty, by tables for all their paragraphs, then by ones twice as large.

Defined cases: a null text is empty; an empty text has no paragraphs, and two of those are alike (1);
a null doc_id comes first in the order of documents, equal ones are ordered by text hash; repeated
rows are documents of their own; a table of one document is its own next; other columns are ignored;
all paragraphs of very long texts count. A fingerprint is of a text's set of paragraphs, so it
doesn't see their order, how often they come, or blank lines.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import partitions, stage

PIECE, CELLS, SEED = 128, 24, 1
MOST_BUCKETS = 1 << 15  # bounds what the driver holds and what is broadcast: one small row a bucket


def digests(text: Column) -> Column:
    """Distinct digests of the text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"[^\\n]{{1,{PIECE}}}"), F.lit(0)), lambda p: F.xxhash64(p)))


def check_of(digest: Column) -> Column:
    return F.shiftright(F.xxhash64(F.lit(77), digest), 33)


def cell_of(digest: Column, third: int, size: Column, seed: int) -> Column:
    """Where a digest lies in the given third of a table whose thirds have ``size`` cells."""
    return third * size + F.pmod(F.xxhash64(F.lit(1000 * seed + third), digest), size)


def cells_of(found: Column, cells: int = CELLS, seed: int = SEED) -> Column:
    """The sketch of distinct digests: for each cell count, XOR of digests and XOR of their checks."""
    size = F.lit(cells // 3).cast("long")
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("c"))

    def third(t: int) -> Column:
        placed = F.transform(found, lambda d: F.struct(d.alias("d"), check_of(d).alias("c"), cell_of(d, t, size, seed).alias("at")))
        places = F.sequence(t * size, (t + 1) * size - 1)
        cells = lambda own: F.transform(places, lambda at: F.aggregate(F.filter(own, lambda x: x["at"] == at), zero, lambda s, x: combined(s, x, 1)))
        # In an array of one, so that the digests are placed once and not once a cell.
        return F.get(F.transform(F.array(placed), cells), F.lit(0))

    return F.concat(*(third(t) for t in range(3)))


def combined(a: Column, b: Column, n: int | Column) -> Column:
    """``a`` with ``n`` times the digest ``b``."""
    return F.struct((a["n"] + n).alias("n"), a["d"].bitwiseXOR(b["d"]).alias("d"), a["c"].bitwiseXOR(b["c"]).alias("c"))


def sketch(found: Column, cells: int = CELLS, seed: int = SEED) -> Column:
    """The fingerprint as a string: number of digests, then count, XORs of digests and checks by cell."""
    text = F.transform(cells_of(found, cells, seed), lambda x: F.concat_ws(".", F.hex(x["n"]), F.hex(x["d"]), F.hex(x["c"])))
    return F.concat_ws("|", F.size(found).cast("string"), text)


def bucket_of(key: Column, bounds: list[tuple]) -> Column:
    """How many of the sorted ``bounds`` are at or below ``key``, a struct: found in two steps."""
    fan = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + fan] for i in range(0, len(bounds), fan)]
    kind = "array<struct<doc_id: long, h: long>>"
    fixed = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    named = lambda x: [{"doc_id": i, "h": h} for i, h in x]
    below = lambda c: F.size(F.filter(c, lambda b: b <= key))
    whole = below(fixed(named(g[-1] for g in groups), kind))
    inside = F.get(fixed([named(g) for g in groups], f"array<{kind}>"), whole)
    return (whole * fan + F.coalesce(F.when(inside.isNotNull(), below(inside)), F.lit(0))).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, found, next_text, next_found): each document and the next in doc_id order.

    Documents are dealt to buckets of neighbours, about 256 each by a sample of ids and text hashes; a
    bucket also gets the first document of the next one, found among bucket minima, so texts are shuffled
    once. Beyond ``MOST_BUCKETS`` buckets grow, and the window over one spills.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    n = docs.count()
    buckets = min(MOST_BUCKETS, max(1, n // 256))
    drawn = docs.sample(min(1.0, 16 * buckets / max(1, n)), seed=3).select("doc_id", "h").collect()
    in_order = lambda x: (x[0] is not None, x[0] or 0, x[1])
    drawn = sorted({(r["doc_id"], r["h"]) for r in drawn}, key=in_order)
    # Where rows repeat there are fewer bounds, but all that were drawn.
    bounds = sorted({drawn[len(drawn) * i // buckets] for i in range(1, buckets)}, key=in_order) if drawn else []
    docs = docs.withColumn("bucket", bucket_of(F.struct("doc_id", "h"), bounds))
    firsts = docs.groupBy("bucket").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    order = Window.orderBy("bucket")  # at most MOST_BUCKETS small rows
    firsts = firsts.select(
        F.col("first.doc_id").alias("first_id"),
        F.col("first.h").alias("first_h"),
        F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("also"),
    )
    dealt = docs.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h")), "left").select(
        "doc_id", "text", "h", F.inline(F.filter(F.array(F.struct("bucket", F.lit(False).alias("copy")), F.struct(F.col("also").alias("bucket"), F.lit(True).alias("copy"))), lambda x: x["bucket"].isNotNull()))
    )
    following = Window.partitionBy("bucket").orderBy("copy", "doc_id", "h")
    dealt = dealt.repartition("bucket").withColumn("found", digests(F.col("text")))
    return dealt.select(
        "doc_id", "text", "found", "copy", F.lead("text").over(following).alias("next_text"), F.lead("found").over(following).alias("next_found")
    ).filter("NOT copy").drop("copy")


def edited(text: Column, next_text: Column) -> Column:
    """The text with its last half replaced by as much of the start of the next."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(next_text, F.lit(1), half))


def summed(cells: DataFrame) -> DataFrame:
    """Adds up rows of one cell; cells that are empty go."""
    return (
        cells.groupBy("pid", "kind", "cell", "digest")
        .agg(F.sum("n").alias("n"), F.bit_xor("d").alias("d"), F.bit_xor("c").alias("c"), F.max("size").alias("size"))
        .filter("cell < 0 OR n <> 0 OR d <> 0 OR c <> 0")
    )


def subtracted(pairs: DataFrame, seed: int) -> DataFrame:
    """Cells of ``mine`` less cells of ``yours`` for each pair (pid, kind, mine, yours, size)."""
    signed = lambda a, n: F.transform(a, lambda d: F.struct(d.alias("d"), F.lit(n).cast("long").alias("n")))
    items = pairs.select("pid", "kind", "size", F.inline(F.concat(signed("mine", 1), signed("yours", -1))))
    places = F.explode(F.array(*(cell_of(F.col("d"), t, F.col("size"), seed) for t in range(3))))
    none = F.lit(None).cast("long").alias("digest")
    return summed(items.select("pid", "kind", places.alias("cell"), none, "n", "d", check_of(F.col("d")).alias("c"), "size"))


def peeled(cells: DataFrame, third: int, seed: int) -> DataFrame:
    """Takes the digests that lie alone in a cell of this third out of their other cells."""
    d, size = F.col("d"), F.col("size")
    alone = (F.col("cell") >= 0) & (F.abs("n") == 1) & (F.col("c") == check_of(d)) & (F.col("cell") == cell_of(d, third, size, seed))
    row = lambda cell, digest, n, d, c: F.struct(cell.alias("cell"), digest.alias("digest"), n.alias("n"), d.alias("d"), c.alias("c"))
    none = F.lit(None).cast("long")
    taken = [row(F.lit(-1).cast("long"), d, F.col("n"), d, F.lit(0).cast("long"))]
    taken += [row(cell_of(d, t, size, seed), none, -F.col("n"), d, F.col("c")) for t in range(3) if t != third]
    same = row(F.col("cell"), F.col("digest"), F.col("n"), d, F.col("c"))
    return summed(cells.select("pid", "kind", "size", F.inline(F.when(alone, F.array(*taken)).otherwise(F.array(same)))))


def differing(pairs: DataFrame, seed: int) -> DataFrame:
    """(pid, kind, whole, differ) of the pairs that differ: whether the cells peeled empty, and the
    digests recovered. All steps keep the pairs' partitioning, so none of them shuffles."""
    cells = subtracted(pairs, seed)
    for third in (0, 1, 2, 0, 1, 2):
        cells = peeled(cells, third, seed)
    return cells.groupBy("pid", "kind").agg(
        F.bool_and(F.col("cell") < 0).alias("whole"), F.collect_list("digest").alias("differ")
    )


def by_fingerprints(df: DataFrame, pairs: dict[str, tuple[str, str]], seed: int = SEED) -> DataFrame:
    """``df`` with a column for each of ``pairs`` (two columns of cells): how many digests differ, found
    by subtracting one's cells from the other's and peeling; null where they don't peel empty."""
    size = F.lit(CELLS // 3).cast("long")
    less = lambda a, b: F.zip_with(a, b, lambda x, y: combined(x, y, -y["n"]))
    df = df.withColumns({f"{name}_left": less(a, b) for name, (a, b) in pairs.items()})
    df = df.withColumns({name: F.lit(0) for name in pairs})
    for third in (0, 1, 2, 0, 1, 2):
        alone = lambda x, i: (F.abs(x["n"]) == 1) & (x["c"] == check_of(x["d"])) & (cell_of(x["d"], third, size, seed) == i + third * size)  # noqa: B023, E731
        lone = {f"{name}_lone": F.filter(F.slice(f"{name}_left", third * CELLS // 3 + 1, CELLS // 3), alone) for name in pairs}
        placed = lambda x: F.struct(x["n"].alias("n"), x["d"].alias("d"), x["c"].alias("c"), F.array(*(cell_of(x["d"], t, size, seed) for t in range(3))).alias("at"))  # noqa: B023, E731
        df = df.withColumns({name: F.transform(c, placed) for name, c in lone.items()})

        def without(name: str) -> Column:
            own = F.col(f"{name}_lone")
            taken = lambda x, i: F.aggregate(own, x, lambda s, p: F.when(F.array_contains(p["at"], i.cast("long")), combined(s, p, -p["n"])).otherwise(s))
            return F.when(F.size(own) == 0, F.col(f"{name}_left")).otherwise(F.transform(f"{name}_left", taken))

        df = df.withColumns({f"{name}_left": without(name) for name in pairs} | {name: F.col(name) + F.size(f"{name}_lone") for name in pairs})
    empty = lambda name: F.forall(f"{name}_left", lambda x: (x["n"] == 0) & (x["d"] == 0) & (x["c"] == 0))
    df = df.withColumns({name: F.when(empty(name), F.col(name)) for name in pairs})
    return df.drop(*(f"{name}_{x}" for name in pairs for x in ("left", "lone")))


def compare(pairs: DataFrame, attempts: int = 4, size: Column | None = None) -> DataFrame:
    """(pid, kind, differ): how many digests differ, for those of ``pairs`` (pid, kind, mine, yours) that
    differ at all.

    Each pair has a table for all its paragraphs (thirds of ``size`` cells); cells that don't peel empty
    are tried again with tables twice as large and other places. What ``attempts`` leave undecided
    (practically never) is counted from the digests themselves.
    """
    both = F.size("mine") + F.size("yours")
    if size is None:
        size = F.greatest(F.lit(CELLS // 3), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(both, F.lit(1)))))).cast("long")
    done, left = None, pairs.withColumn("size", size)
    for attempt in range(1, attempts):
        # Cells are many times the digests, so the number of partitions is kept, whatever the digests' size.
        dealt = left.repartition(2 * partitions(pairs.sparkSession), "pid")
        found = stage(differing(dealt, SEED + attempt).withColumn("differ", F.size("differ")), "sketch-found")
        good = found.filter("whole").select("pid", "kind", "differ")
        done = good if done is None else done.union(good)
        # A table of its own, so that the next join knows how small it is: then only these pairs are dealt again.
        failed = stage(found.filter("NOT whole").select("pid", "kind"), "sketch-failed")
        if failed.isEmpty():
            return done
        left = left.join(failed, ["pid", "kind"], "left_semi").withColumn("size", F.col("size") * 2)
    exact = F.size(F.array_except("mine", "yours")) + F.size(F.array_except("yours", "mine"))
    return done.union(left.select("pid", "kind", exact.alias("differ")))


def likeness(mine: Column, yours: Column, differ: Column) -> Column:
    """Shared digests as a share of all, from both numbers and how many differ."""
    both, d = F.size(mine) + F.size(yours), F.coalesce(differ, F.lit(0))
    return F.when(both == 0, 1.0).otherwise((both - d) / (both + d))


def fingerprints(docs: DataFrame) -> DataFrame:
    """For each of ``docs``: doc_id, n_chars, the edited text's SHA-256, both fingerprints, and how
    like its fingerprint is to the edited text's and to the next document's."""
    new = edited(F.col("text"), F.col("next_text"))
    made = with_next(docs).withColumn("new", new).select(
        F.monotonically_increasing_id().alias("pid"),
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("new").cast("binary"), 256).alias("edited_sha256"),
        "found",
        digests(F.col("new")).alias("new_found"),
        "next_found",
    )
    names = {f"{c}_cells": c for c in ("found", "new_found", "next_found")}
    own = made.withColumns({name: cells_of(F.col(c)) for name, c in names.items()})
    own = by_fingerprints(own, {"own_edited": ("found_cells", "new_found_cells"), "own_next": ("found_cells", "next_found_cells")})
    base = stage(own.drop(*names), "sketch-digests")
    pair = lambda kind, other: F.when(F.col(f"own_{kind}").isNull(), F.struct(F.lit(kind).alias("kind"), F.col("found").alias("mine"), F.col(other).alias("yours")))
    left = F.array_compact(F.array(pair("edited", "new_found"), pair("next", "next_found")))
    unsettled = base.filter("own_edited IS NULL OR own_next IS NULL")
    differ = compare(unsettled.select("pid", F.inline(left)))
    by_pid = differ.groupBy("pid").agg(
        F.max(F.when(F.col("kind") == "edited", F.col("differ"))).alias("d_edited"),
        F.max(F.when(F.col("kind") == "next", F.col("differ"))).alias("d_next"),
    )
    return base.join(by_pid, "pid", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        sketch(F.col("found")).alias("fingerprint"),
        sketch(F.col("new_found")).alias("edited_fingerprint"),
        likeness(F.col("found"), F.col("new_found"), F.coalesce("own_edited", "d_edited")).alias("near_edited"),
        likeness(F.col("found"), F.col("next_found"), F.coalesce("own_next", "d_next")).alias("near_next"),
    )
