"""Exact quantiles of groups of any size, by selection.

A group with few values is sorted in one buffer. In a large one, a rank is looked for in a range of values that
narrows: a mergeable sketch gives two values close to the rank on both sides, exact counts say which side of each the
rank is on (or that it is one of them, so that repeated values end it), and so on until few values are left. A round is two aggregations,
combined before they are shuffled; nothing is sorted but the last few values, and no buffer holds more than ``limit``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage
from .rowindex import join_same

ACCURACY = 1000  # of the sketch: ranks within a thousandth of the values
FEW = 10_000  # ranks looked for at once that are broadcast


def narrowed(values: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """``asked`` (keys, rank, below, inside, lo, hi) after one round: open ranges between lo and hi, which hold ``inside``
    values after ``below`` smaller ones, or the ``answer``."""
    small = F.broadcast(asked) if asked.count() <= FEW else asked
    within = (F.col("lo").isNull() | (F.col("v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") < F.col("hi")))
    target = [*keys, "rank", "below", "inside", "lo", "hi"]
    held = join_same(values, small, keys).filter(within)
    at = (F.col("rank") - F.col("below") + 0.5) / F.col("inside")
    # The sketch wants constant shares: all thousandths, of which two are near the rank.
    shares = [i / ACCURACY for i in range(ACCURACY + 1)]
    sketch = held.groupBy(*target).agg(F.percentile_approx("v", shares, 4 * ACCURACY).alias("s"))
    near = lambda d: F.get("s", F.least(F.greatest(F.floor(at * ACCURACY) + d, F.lit(0)), F.lit(ACCURACY)).cast("int"))
    probes = stage(sketch.select(*target, near(-1).alias("a"), near(2).alias("b")), "quantile-probes")
    probes = F.broadcast(probes) if probes.count() <= FEW else probes
    held, v, a, b = join_same(values, probes, keys).filter(within), F.col("v"), F.col("a"), F.col("b")
    parts = [v < a, v == a, (v > a) & (v < b), (v == b) & (b > a)]
    counts = held.groupBy(*target, "a", "b").agg(*(F.count_if(p).alias(f"c{i}") for i, p in enumerate(parts)))
    r, c = F.col("rank") - F.col("below"), [F.col(f"c{i}") for i in range(4)]
    upto = [c[0], c[0] + c[1], c[0] + c[1] + c[2], c[0] + c[1] + c[2] + c[3]]
    part = lambda answer, below, inside, lo, hi: F.struct(answer.cast("double").alias("answer"), below.alias("below"), inside.alias("inside"), lo.alias("lo"), hi.alias("hi"))
    none, below, lo, hi = F.lit(None), F.col("below"), F.col("lo"), F.col("hi")
    found = (
        F.when(r < upto[0], part(none, below, c[0], lo, a))
        .when(r < upto[1], part(a, below, F.lit(0).cast("long"), lo, hi))
        .when(r < upto[2], part(none, below + upto[1], c[2], a, b))
        .when(r < upto[3], part(b, below, F.lit(0).cast("long"), lo, hi))
        .otherwise(part(none, below + upto[3], F.col("inside") - upto[3], b, hi))
    )
    return stage(counts.select(*keys, "rank", found.alias("_")).select(*keys, "rank", "_.*"), "quantile-ranges")


def at_ranks(values: DataFrame, asked: DataFrame, keys: list[str], limit: int, rounds: int) -> DataFrame:
    """(keys, rank, answer) for ``asked`` (keys, rank, n): the value of each rank, from 0."""
    state = asked.select(*keys, "rank", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), *(F.lit(None).cast("double").alias(c) for c in ("lo", "hi", "answer")))
    state, done = stage(state, "quantile-ranges"), []
    for _ in range(rounds):
        wide = state.filter(F.col("answer").isNull() & (F.col("inside") > limit))
        done.append(state.filter(F.col("answer").isNotNull() | (F.col("inside") <= limit)))
        if wide.isEmpty():
            break
        state = narrowed(values, wide.drop("answer"), keys)
    else:
        raise RuntimeError(f"ranks did not settle in {rounds} rounds")
    settled = done[0]
    for one in done[1:]:
        settled = settled.unionByName(one)
    last = settled.filter("answer IS NULL").drop("answer")
    held = join_same(values, last, keys).filter((F.col("lo").isNull() | (F.col("v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") < F.col("hi"))))
    nth = F.row_number().over(Window.partitionBy(*keys, "rank").orderBy("v")) - 1
    picked = held.withColumn("_n", nth).filter(F.col("_n") == F.col("rank") - F.col("below")).select(*keys, "rank", F.col("v").alias("answer"))
    return settled.filter("answer IS NOT NULL").select(*keys, "rank", "answer").unionByName(picked)


def exact_quantiles(df: DataFrame, keys: list[str], value: Column, shares: list[float], limit: int = 100_000, rounds: int = 60) -> DataFrame:
    """(keys, quantiles): the exact quantiles of each group at ``shares``, interpolated between neighbours, as
    ``percentile`` gives them. NULL and NaN values are left out; groups without others have no row."""
    values = stage(df.select(*keys, value.cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)"), "quantile-values")
    large = stage(values.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > limit), "quantile-groups")
    n_large = large.count()
    if n_large <= FEW:
        large = F.broadcast(large)
    own = large.withColumnsRenamed({k: f"_{k}" for k in keys})
    small = values.join(own, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti") if n_large else values
    out = small.groupBy(*keys).agg(F.percentile("v", list(shares)).alias("quantiles"))
    if not n_large:
        return out
    at = [(F.col("n") - 1) * F.lit(p) for p in shares]
    ranks = F.array_distinct(F.array(*(f(x).cast("long") for x in at for f in (F.floor, F.ceil))))
    found = at_ranks(values, large.select(*keys, "n", F.explode(ranks).alias("rank")), keys, limit, rounds)
    held = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "answer"))).alias("m"))  # two a share

    def between(x: Column) -> Column:
        low, high = F.floor(x).cast("long"), F.ceil(x).cast("long")
        below, above = F.try_element_at("m", low), F.try_element_at("m", high)
        return F.when(low == high, below).otherwise((high - x) * below + (x - low) * above)

    joined = join_same(held, large, keys)
    return out.unionByName(joined.select(*keys, F.array(*(between(x) for x in at)).alias("quantiles")))
