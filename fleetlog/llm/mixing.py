"""Mixing sources to target weights, in DataFrame functions only.

A classifier fitted on the labelled table predicts each document's domain posteriors. Nonnegative
document rates are then fitted by projected gradient on the least squares between expected domain
token totals, sum(rate * tokens * posterior), and the targets. Every step is one aggregate of a
small staged table (tokens and posteriors), which gives the driver one number a domain.

Defined cases: null or empty texts have no tokens and rate 1; without labelled rows every domain has
the same posterior; a domain without documents cannot be met and is left out of the fit; repeated
rows are separate documents; an empty table gives an empty result; other columns pass through; all
words of very long texts count. Targets that the fit doesn't meet are logged with their gaps.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, stage

LOG = logging.getLogger(__name__)
#: Domains of the labelled table.
DOMAINS = ("high", "low", "toxic")


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 2).when(quality == 0, 1).when(quality == 1, 0)


def words(text: Column) -> Column:
    """Lower-cased words between ASCII white space."""
    spaced = F.translate(F.lower(F.coalesce(text, F.lit(""))), SPACE, " " * len(SPACE))
    return F.array_remove(F.split(spaced, " ", -1), "")


def fit_classifier(labelled: DataFrame, most: int = 4000, features: int = 1 << 14):
    """Multinomial logistic regression on hashed word presence of at most about ``most`` labelled rows
    (text, domain), taken by text hash; None if there are fewer than two domains."""
    rows = labelled.filter("domain IS NOT NULL AND text IS NOT NULL")
    n, kinds = rows.agg(F.count("*"), F.count_distinct("domain")).first()
    if kinds < 2:
        return None
    share = int((1 << 40) * min(1.0, most / n)) + 1
    sample = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < share).dropDuplicates(["text", "domain"])
    return Pipeline(
        stages=[
            HashingTF(inputCol="words", outputCol="presence", numFeatures=features, binary=True),
            Normalizer(inputCol="presence", outputCol="features"),
            LogisticRegression(labelCol="domain", regParam=0.01, maxIter=40, family="multinomial"),
        ]
    ).fit(sample.select(words(F.col("text")).alias("words"), F.col("domain").cast("double")))


def posteriors(docs: DataFrame, model, domains: tuple[str, ...]) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``posterior``, the classifier's probability of each domain.

    Each expression names a costly one once, or it would be worked out again.
    """
    k = len(domains)
    made = docs.withColumn("words", words(F.col("text")))
    if model is None:
        return made.withColumns({"n_tokens": F.size("words").cast("long"), "posterior": F.array(*[F.lit(1.0 / k)] * k)}).drop("words")
    padded = F.slice(F.concat(vector_to_array("probability"), F.array_repeat(F.lit(0.0), k)), 1, k)
    return model.transform(made).select(*docs.columns, F.size("words").cast("long").alias("n_tokens"), padded.alias("posterior"))


def rate_after(steps: list[np.ndarray], posterior: Column, start: Column) -> Column:
    """The rate after the projected steps: each adds posterior · step and is cut at 0."""
    rate = start
    for step in steps:
        rate = F.greatest(F.lit(0.0), rate + sum(posterior[i] * float(x) for i, x in enumerate(step)))
    return rate


def fit_rates(parts: DataFrame, targets: dict[int, float], steps: int = 60, every: int = 10, tolerance: float = 1e-5) -> DataFrame:
    """``parts`` (key, n_tokens, posterior) with ``rate``.

    Projected gradient from rate 1 on the least squares of the gaps between expected totals and
    targets. Documents are weighted by their tokens, so that length doesn't sway a rate, and gaps by
    the inverse of the domains' overlap (one small matrix), so that a unit step never overshoots and
    one step is exact while no rate is cut at 0. Each ``every`` steps the rates are written out. Where
    the targets can't be met with nonnegative rates, it ends at the least squares.
    """
    k = len(targets)
    t, p = F.col("n_tokens").cast("double"), F.col("posterior")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = parts.agg(*[F.coalesce(F.sum(t * p[i] * p[j]), F.lit(0.0)) for i, j in pairs]).first()
    overlap = np.zeros((k, k))
    for (i, j), x in zip(pairs, sums):
        overlap[i, j] = overlap[j, i] = x
    inverse = np.linalg.pinv(overlap, rcond=1e-9)
    aim = np.where(np.diag(overlap) > 0, [targets[i] for i in range(k)], 0.0)
    parts = parts.withColumn("rate", F.lit(1.0))
    taken: list[np.ndarray] = []
    before, enough = np.full(k, np.inf), tolerance * max(aim.sum(), 1e-9)
    for _ in range(steps):
        rate = rate_after(taken, p, F.col("rate"))
        gap = aim - np.array(parts.agg(*[F.coalesce(F.sum(rate * t * p[i]), F.lit(0.0)) for i in range(k)]).first())
        if np.abs(gap).max(initial=0) <= enough:
            break
        if np.abs(gap - before).max(initial=0) <= enough / 10:
            LOG.warning("least squares leave these gaps to the targets: %s", gap.tolist())
            break
        before = gap
        taken.append(inverse @ gap)
        if len(taken) == every:
            parts = stage(parts.withColumn("rate", rate_after(taken, p, F.col("rate"))), "mix-rates")
            taken = []
    else:
        LOG.warning("rates did not settle in %d steps; gaps to the targets: %s", steps, gap.tolist())
    return parts.withColumn("rate", rate_after(taken, p, F.col("rate")))


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``docs`` with ``n_tokens``, ``posterior``, ``rate`` and ``copies``.

    ``weights``: each domain's expected tokens as a share of all tokens of ``docs``; they may add up
    to more or less than 1. ``copies`` rounds the rate up or down by the document's hash, so that
    copies follow the rates in expectation and alike in every run.
    """
    own = [c for c in docs.columns if c not in ("n_tokens", "posterior", "rate", "copies")]
    domains = tuple(weights)
    marks = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    named = F.create_map(*(F.lit(x) for i, d in enumerate(DOMAINS) for x in (i, domains.index(d) if d in domains else None)))
    domain = named[domain_of(F.col("quality"), F.col("toxic"))].alias("domain")
    labelled = docs.select("doc_id", "text").join(marks, "doc_id").select("text", domain)
    model = fit_classifier(labelled)
    key = [F.col("doc_id").alias("k_id"), F.xxhash64("text").alias("k_text")]
    made = stage(posteriors(docs.select(*key, "text"), model, domains).drop("text"), "mix-posteriors")
    # Numbers by themselves, as arrays can't be aggregated by hash.
    each = {f"p{i}": F.col("posterior")[i] for i in range(len(domains))}
    same = made.withColumns(each).groupBy("k_id", "k_text").agg(
        *(F.max(c).alias(c) for c in each), F.max("n_tokens").alias("each"), F.sum("n_tokens").alias("n_tokens")
    )
    parts = stage(same.select("k_id", "k_text", F.array(*each).alias("posterior"), "each", "n_tokens"), "mix-parts")
    whole = float(parts.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0])
    rated = fit_rates(parts, {i: weights[d] * whole for i, d in enumerate(domains)})
    rated = stage(rated.select("k_id", "k_text", F.col("each").alias("n_tokens"), "posterior", "rate"), "mix-fitted")
    u = F.pmod(F.xxhash64(F.lit("copies"), "doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    rated = rated.withColumnRenamed("k_text", "r_text")
    return (
        docs.select("doc_id", F.xxhash64("text").alias("k_text"), u.alias("u"), F.struct(*own).alias("row"))
        .join(rated, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("k_text") == F.col("r_text")))
        .select("row.*", "n_tokens", "posterior", "rate", F.floor(F.col("rate") + F.col("u")).cast("int").alias("copies"))
    )
