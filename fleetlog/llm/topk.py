"""Exact top-k search by MaxScore over integer vectors.

A query's terms are its dimensions. Within a shard a term's bound is the most it can add to a score.
Terms are sorted by bound and split: while the bounds of the last ones (non-essential) cannot lift a
vector past the k-th score so far, only postings of the others (essential) are traversed. Vectors
that stay competitive are probed for the remaining terms, the largest bound first, and dropped as
soon as the bounds left cannot lift them. Each shard gives its k best; shards are merged by rank.

Queries and vectors meet in blocks: every block of queries with every shard, so no task holds more
than one of each. A vector is dense, so a term's postings are a column of the shard. Queries of like
essential terms go together, and traverse the columns that one of them holds essential as one matrix
product.

Defined cases: vectors that are null or hold null or non-finite components (scaled ones too), and those with a null
id, take no part; shorter vectors count as ending in zeros; repeated ids are separate candidates, and repeated queries separate
queries with k rows each; a query doesn't find its own row, which is one of its id and vector, but other rows
of its id; an empty table gives no rows; other columns are ignored; ties go to the smaller id. Numbers of any size are scored
exactly: in floats where these hold all sums, else in whole numbers; a score that no long holds is ranked like the others,
and an error only where it is returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import partitions, stage

TOGETHER = 64  # queries of one matrix product
LEAST = 4096  # rows that a shard has at least, where there are enough
FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("beyond", pa.int32()), ("score", pa.int64()), ("exact", pa.binary())])
LONG = 1 << 63
OFFSET = 1 << 4095  # above any sum of products of doubles, so that bytes of a score with it are in the order of scores


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as a double; null where the vector takes no part."""
    scaled = F.transform(vector, lambda x: F.lit(float(scale)) * x.cast("double"))
    sound = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # Doubles from 2^52 on are whole already, and may be too large for floor's long.
    return F.when(sound, F.transform(scaled, lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)))


def matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Whole numbers as 64-bit integers, or as Python's where one is larger."""
    size, numbers = lengths(vectors), pc.list_flatten(vectors).to_numpy()
    large = len(numbers) and float(np.abs(numbers.astype(float)).max()) >= 1 << 63
    out = np.zeros((len(size), width), object if large else np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = list(map(int, numbers.tolist())) if large else numbers
    return out


def exact_kind(a: np.ndarray, b: np.ndarray) -> type:
    """The narrowest kind of number that holds every sum of products of rows of ``a`` and ``b``."""
    largest = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
    most = largest(a) * largest(b) * max(1, a.shape[1])
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object


def score_columns(scores: list[int]) -> list[pa.Array]:
    """``beyond`` (-1 or 1 for a score that no long holds, else 0), ``score``, and the ``exact`` one where it is beyond."""
    beyond = [int(s >= LONG) - int(s < -LONG) for s in scores]
    exact = [(s + OFFSET).to_bytes(512, "big") if b else None for s, b in zip(scores, beyond)]
    return [pa.array(beyond, pa.int32()), pa.array([None if b else s for s, b in zip(scores, beyond)], pa.int64()), pa.array(exact, pa.binary())]


def highest_first() -> list[Column]:
    return [F.desc("beyond"), F.desc("score"), F.desc("exact")]


def as_long(beyond: Column, score: Column) -> Column:
    """A score that is returned."""
    return F.when(beyond != 0, F.raise_error(F.lit("a score is too large for a long")).cast("long")).otherwise(score)


def lengths(vectors: pa.ChunkedArray) -> np.ndarray:
    return pc.list_value_length(vectors).to_numpy().astype(np.int64)


def max_score(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int, block: int = 2048):
    """Exact k best (score, then smaller id) of the shard ``v`` for each query: ids and scores."""
    kind = exact_kind(q, v)
    order = np.argsort(v_ids, kind="stable")
    v_ids, v = v_ids[order], v[order].astype(kind)
    q = q.astype(kind)
    bound = np.maximum(q * v.max(0), q * v.min(0))  # what each term adds at most
    by_bound = np.argsort(bound, axis=1)  # ascending: non-essential first
    left = np.cumsum(np.take_along_axis(bound, by_bound, 1), axis=1)
    # The k-th score so far, exact: below all scores at first.
    low = np.full(len(q), -OFFSET if kind is object else np.iinfo(np.int64).min if kind is np.int64 else -np.inf, kind)
    best = [(np.zeros(0, np.int64), np.zeros(0, kind)) for _ in q]

    def search(own, part, ids, essential, skipped, spare, by_bound, left) -> None:
        """Queries ``own`` against one part of the shard."""
        terms = np.flatnonzero(essential.any(0))
        score = (q[own] * essential)[:, terms] @ part[:, terms].T
        rows, cols = np.nonzero(score + spare[:, None] > low[own][:, None])
        other = q_ids[own][rows] != ids[cols]
        rows, cols = rows[other], cols[other]
        sums = score[rows, cols]
        for step in range(int(skipped.max(initial=0)) - 1, -1, -1):  # probe, the largest bound first
            due = skipped[rows] > step
            term = by_bound[rows, step]
            sums = sums + np.where(due, q[own[rows], term] * part[cols, term], 0)
            rest = left[rows, step - 1] if step else 0
            keep = ~due | (sums + rest > low[own[rows]])
            rows, cols, sums = rows[keep], cols[keep], sums[keep]
        for r in np.unique(rows):
            lo, hi = np.searchsorted(rows, (r, r + 1))
            n = own[r]
            i, s = np.concatenate([best[n][0], ids[cols[lo:hi]]]), np.concatenate([best[n][1], sums[lo:hi]])
            top = np.lexsort((i, -s))[:k]
            best[n] = i[top], s[top]
            if len(top) == k:
                low[n] = s[top[-1]]

    for at in range(0, len(v), block):
        part, ids = v[at : at + block], v_ids[at : at + block]
        # Later ids lose ties, so a vector must beat the k-th score once k are found.
        skipped = (left < low[:, None]).sum(1) if at else np.zeros(len(q), int)
        essential = np.argsort(by_bound, axis=1) >= skipped[:, None]
        spare = np.where(skipped > 0, np.take_along_axis(left, np.maximum(skipped - 1, 0)[:, None], 1)[:, 0], 0)
        alike = np.lexsort(essential.T)
        for own in np.split(alike, range(TOGETHER, len(alike), TOGETHER)):
            search(own, part, ids, essential[own], skipped[own], spare[own], by_bound[own], left[own])
    return best


def top_k(
    queries: DataFrame, vectors: DataFrame, k: int = 20, scale: int = 64, query_block: int = 16384, shard_rows: int = 65536
) -> DataFrame:
    """The ``k`` best ``vectors`` (vec_id, embedding) for each of ``queries``: query_id, rank, vec_id, score.

    ``query_block`` and ``shard_rows`` bound a task's memory, and how often each side is copied: every
    vector once a block of queries, every query once a shard. Small inputs get smaller shards, so that
    all cores have one.
    """
    whole = lambda df: df.select("vec_id", whole_numbers(F.col("embedding"), scale).alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    q = stage(whole(queries).withColumn("query", F.monotonically_increasing_id()), "topk-queries")
    v = stage(whole(vectors), "topk-vectors")
    n = v.count()
    blocks, shards = max(1, math.ceil(q.count() / query_block)), max(1, math.ceil(n / shard_rows), min(partitions(v.sparkSession), n // LEAST))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select("query", "vec_id", "v", F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block"), every(shards).alias("shard"))
    v = v.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).alias("shard"), every(blocks).alias("block"))

    def searched(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return FOUND.empty_table()
        width = max(1, *(int(lengths(t.column("v")).max()) for t in (a, b)))
        b = b.sort_by("vec_id")
        query, own, ids = (t.column(c).to_numpy() for t, c in ((a, "query"), (a, "vec_id"), (b, "vec_id")))
        m, n = matrix(a.column("v"), width), matrix(b.column("v"), width)
        # By position, which is the order of ids; one more than k, as a query's own row may be among them.
        best = max_score(-1 - np.arange(len(m)), m, np.arange(len(n)), n, k + 1)
        asked, at, score = [], [], []
        for i, (found, scores) in enumerate(best):
            # One of the rows of a query's own id and vector is the query's own; the others, all of this shard, are like it.
            same = np.flatnonzero((ids[found] == own[i]) & (n[found] == m[i]).all(1))[:1]
            others = np.delete(np.arange(len(found)), same)[:k]
            asked.append(np.full(len(others), i))
            at.append(found[others])
            score.extend(int(x) for x in scores[others].tolist())
        asked, at = np.concatenate(asked), np.concatenate(at)
        return pa.table([pa.array(query[asked]), pa.array(own[asked]), pa.array(ids[at]), *score_columns(score)], schema=FOUND)

    keys = ("block", "shard")
    found = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(searched, "query long, query_id long, vec_id long, beyond int, score long, exact binary")
    best = Window.partitionBy("query").orderBy(*highest_first(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", as_long(F.col("beyond"), F.col("score")).alias("score"))
