"""Exact quantiles, greedy cadences and null keys of huge logs, against the plain ways."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlog.operators import analysis, catalog, jumps, lookback, quantiles, relation, ticks
from fleetlog.operators.rowindex import row_index, with_previous, with_running_sum
from fleetlog.plans.pipeline import Every
from fleetlog.storage import remove_staged
from fleetlog.streaming import live

ROW = "log_id string, topic string, timestamp_seconds double, seq long, message struct<value: double>"


def logs(spark, seed, n, span):
    r = random.Random(seed)
    rows = [(r.choice(("a", "a", "a", "b", None)), r.choice(("x", None)), r.choice((r.uniform(0, span), float(r.randint(0, int(span))))), i, (r.choice((None, float(r.randint(0, 9)), r.uniform(-1e6, 1e6))),)) for i in range(n)]
    return rows, spark.createDataFrame(rows, ROW).repartition(3)


@pytest.mark.parametrize("limit", [3, 40])
def test_quantiles_by_selection(spark, limit):
    r = np.random.default_rng(1)
    groups = {
        "normal": r.normal(0, 1, 900), "ties": r.integers(0, 3, 700).astype(float), "one": np.full(500, 7.0), "two": np.r_[np.zeros(400), np.ones(400)],
        "wide": 10.0 ** r.uniform(-300, 300, 400), "few": np.array([3.0, 1.0]), None: np.r_[r.normal(5, 1, 300), -np.inf, np.inf],
    }
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("normal", None), ("normal", float("nan")), ("none", None)]
    df, shares = spark.createDataFrame(rows, "k string, x double").repartition(4), [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {x["k"]: x["quantiles"] for x in quantiles.exact_quantiles(df, ["k"], F.col("x"), shares, limit=limit).collect()}
    want = {x["k"]: x["q"] for x in df.filter("x IS NOT NULL AND NOT isnan(x)").groupBy("k").agg(F.percentile("x", shares).alias("q")).collect()}
    assert got == want and set(got) == set(groups)
    remove_staged(spark)


def test_exits_lead_where_greedy_does():
    r = random.Random(2)
    for _ in range(300):
        t = np.sort([r.choice((r.uniform(0, 30), float(r.randint(0, 30)))) for _ in range(r.randint(1, 60))])
        every, entry = r.choice((0.0, 0.5, 1.0, 4.0, 100.0)), r.uniform(-20, t[0])
        before, leaves = jumps.exits(t, every)
        fired = ticks.greedy(t, every, entry) if every else list(range(len(t)))
        if every:
            inside = [x for b, x in zip(before, leaves) if b - entry < every and t[-1] - entry >= every]
            assert (inside[-1] if inside else None) == (t[fired[-1]] if fired else None)


@pytest.mark.parametrize("every", [0.3, 5.0, 60.0])
def test_greedy_cadence_in_ranges(spark, monkeypatch, every):
    monkeypatch.setattr(jumps, "RANGE_ROWS", 40)
    rows, df = logs(spark, 3, 600, 200)
    plain = {}
    for k in {x[0] for x in rows}:
        t = sorted((x[2], x[3]) for x in rows if x[0] == k)
        plain |= {(k, i): t[p][0] for i, p in enumerate(ticks.greedy(np.array([x for x, _ in t]), every))}
    got = {(x["log_id"], x["tick_no"]): x["asof_seconds"] for x in ticks.ticks_every_seconds(df, every, huge=True).collect()}
    assert got == plain and len(got) > 8
    kept = [sorted(x["seq"] for x in live.throttle(df, every * 1000, huge).collect()) for huge in (True, False)]
    assert kept[0] == kept[1] and kept[0]
    assert ticks.ticks_every_seconds(df.limit(0), every, huge=True).count() == 0
    remove_staged(spark)


def test_null_keys_in_ranges(spark):
    rows, df = logs(spark, 4, 400, 50)
    by = lambda x: sorted(map(repr, x.collect()))
    keys, order = ["log_id", "topic"], ["timestamp_seconds", "seq"]
    at = df.filter("seq % 9 = 0").select("log_id", F.col("seq").alias("tick_no"), F.col("timestamp_seconds").alias("asof_seconds"))
    value = F.col("message.value")
    for made in (
        lambda h: row_index(df, keys, order, h),
        lambda h: with_previous(df, keys, order, F.col("seq"), "p", h),
        lambda h: with_running_sum(df, keys, order, F.col("seq"), "s", h),
        lambda h: catalog.gaps(df, h).select(*keys, "seq", F.round("latency", 6)),
        lambda h: catalog.topic_frequency(df, h).select(*keys, F.round("frequency", 6)),
        lambda h: analysis.latency_stats(df, h).select(*keys, "low", "high", *(F.round(c, 6).alias(c) for c in ("mean", "middle", "spread"))),
        lambda h: analysis.summarise(df, value, h).select(*keys, "low", "high", "n", *(F.round(c, 3).alias(c) for c in ("mean", "middle", "spread"))),
        lambda h: analysis.rate_class(df, 1.0, h).select(*keys, F.round("frequency", 6), "kind"),
        lambda h: analysis.latency_anomalies(df, 1.0, h).select(*keys, "seq"),
        lambda h: analysis.every_nth(df, 3, h),
        lambda h: analysis.excursions(df, value, 3.0, h),
        lambda h: relation.ffill(df.select("log_id", "seq", "timestamp_seconds", F.when(F.col("topic") == "x", F.col("message")).alias("x")), h),
        lambda h: lookback.lookback_frames(df, at, 3, h),
        lambda h: lookback.asof_all(df, at, F.col("seq"), h),
        lambda h: live.retain_bytes(df, 300, F.lit("abcdefgh"), h),
    ):
        plain = by(made(False))
        assert by(made(True)) == plain and any("log_id=None" in x for x in plain) and any("log_id='a'" in x for x in plain)
    remove_staged(spark)


def test_units_of_huge_cadences():
    assert Every(2, "minute").seconds() == 120.0
