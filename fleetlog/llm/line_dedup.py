"""Line dedup: drop lines that many documents share, in DataFrame functions only.

Lines are exploded, normalised and hashed; documents are counted by hash; lines over the
threshold are dropped, except in the largest ``doc_id``; texts are put together by position.

Defined cases: a null or empty text is one empty line; a null ``doc_id`` counts as no document
and never keeps a shared line; repeated rows are one document and get the same result each; an
empty table gives an empty result; other columns pass through, ``n_lines`` and ``n_dropped`` are
replaced; all lines of very long texts count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, ascii_lower, hash_pair, stage

HOT = 10_000


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """``docs`` with ``text`` replaced by its kept lines, plus ``n_lines`` and ``n_dropped``.

    Only hashes of lines are shuffled by line; texts are shuffled once. Lines with more than one in
    ``HOT`` of all holders are at most ``HOT`` lines, so they are broadcast and no task gathers theirs.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_dropped")]
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id",
        F.xxhash64(text).alias("rid"),
        F.split(text, "\n", -1).alias("lines"),
        (F.struct(*rest) if rest else F.lit(None)).alias("rest"),
    )
    keys = (
        base.select("doc_id", "rid", F.posexplode("lines").alias("pos", "line"))
        .select("doc_id", "rid", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("doc_id", "rid", "pos", *(h.alias(n) for h, n in zip(hash_pair(F.col("key")), ("h1", "h2"))))
    )
    keys = stage(keys, "line-keys")
    common = (
        keys.groupBy("h1", "h2")
        .agg(F.count_distinct("doc_id").alias("n"), F.count("*").alias("rows"), F.max("doc_id").alias("last"))
        .filter(F.col("n") >= min_docs)
        .drop("n")
    )
    common = stage(common, "line-common")
    many = F.col("rows") > keys.count() / HOT
    hot = common.filter(many).select("h1", "h2", F.col("last").alias("hot_last"))
    marked = keys.join(F.broadcast(hot), ["h1", "h2"], "left")
    held = ["doc_id", "rid", "pos", "last"]
    drops = (
        marked.filter("hot_last IS NOT NULL")
        .withColumnRenamed("hot_last", "last")
        .select(*held)
        .union(marked.filter("hot_last IS NULL").join(common.filter(~many), ["h1", "h2"]).select(*held))
        .filter(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("last")))
        .groupBy(F.col("doc_id").alias("drop_id"), F.col("rid").alias("drop_rid"))
        .agg(F.collect_set("pos").alias("gone"))
    )
    kept_at = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(
        F.transform(kept_at, lambda i: F.get(F.col("lines"), i))
    )
    return base.join(
        drops, F.col("doc_id").eqNullSafe(F.col("drop_id")) & (F.col("rid") == F.col("drop_rid")), "left"
    ).select(
        "doc_id",
        F.array_join(kept, "\n").alias("text"),
        *(F.col("rest").getField(c).alias(c) for c in rest),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
