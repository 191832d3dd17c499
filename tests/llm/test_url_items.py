"""Tokens that always go together are one item, so no labelled row is cut."""

import itertools
import random

from pyspark.sql import functions as F

from fleetlog.llm import url_filter

ROW = "tokens array<string>, blocked boolean"


def test_forty_tokens_that_go_together(spark):
    """Two to the fortieth combinations of single tokens, but two items."""
    rows = [([f"g{i}" for i in range(40)] + ["a"], True)] * 40 + [(["a", f"x{i}"], False) for i in range(60)] + [(["g0"], None)]
    got = url_filter.learn_rules(spark.createDataFrame(rows[:-1], ROW), 0.01, 0.6, most_tokens=None).collect()
    by = {tuple(x["rule_tokens"]): x for x in got}
    assert set(by) == {("g0",), ("a", "g0")} and len(by[("g0",)]["choices"][0]) == 40 and by[("g0",)]["confidence"] == 1.0


def test_items_match_what_rules_of_single_tokens_match(spark):
    r = random.Random(11)
    groups = [["a0", "a1", "a2"], ["b0"], ["c0", "c1"], ["d0"], ["e0"]]
    rows = []
    for _ in range(500):
        held = [g for g in groups if r.random() < 0.5]
        bad = groups[0] in held and groups[2] in held
        rows.append(([t for g in held for t in g], r.random() < (0.9 if bad else 0.1)))
    names = [t for g in groups for t in g]
    pages = [(i, -i, [t for t in names if r.random() < 0.3]) for i in range(600)]
    rules = url_filter.learn_rules(spark.createDataFrame(rows, ROW), 0.01, 0.6, most_tokens=None)
    got = {x["u1"] for x in url_filter.match_rules(spark.createDataFrame(pages, "u1 long, u2 long, tokens array<string>"), rules).collect()}
    base, single = sum(b for t, b in rows if t) / sum(1 for t, _ in rows if t), []
    n = sum(1 for t, _ in rows if t)
    for size in range(1, len(names) + 1):
        for rule in itertools.combinations(names, size):
            seen = [b for t, b in rows if set(rule) <= set(t)]
            if sum(seen) < 20 or sum(seen) / n < 0.01 or sum(seen) / len(seen) < 0.6:
                continue
            p, m, z = sum(seen) / len(seen), len(seen), 2.33
            if (p + z * z / (2 * m) - z * (p * (1 - p) / m + z * z / (4 * m * m)) ** 0.5) / (1 + z * z / m) > base:
                single.append(set(rule))
    assert got == {i for i, _, t in pages if any(rule <= set(t) for rule in single)}
    assert 20 < len(got) < 580


def test_a_url_of_more_tokens_than_any_bound(spark):
    """Fourteen query keys, all needed: a rule of all of them blocks, one key less is allowed."""
    keys = [f"k{i:02}" for i in range(14)]
    url = lambda left, n: f"https://site.org/{n}?" + "&".join(f"{k}=1" for k in keys if k != left)
    pages = [(i, url(None, i)) for i in range(60)] + [(100 + i, url(keys[i % 14], i)) for i in range(140)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    labels = df.filter("page_id % 3 <> 0").select("page_id", (F.col("page_id") < 100).alias("blocked"))
    got = url_filter.filter_urls(df, [], labels, min_confidence=0.9)
    assert {x["page_id"] for x in got.filter("verdict = 'block'").collect()} == set(range(60))


def test_repeated_and_missing_tokens(spark):
    rows = [(["a", "a", None], True)] * 30 + [(["b"], False)] * 30 + [(None, True), ([], False)]
    got = url_filter.learn_rules(spark.createDataFrame(rows, ROW), 0.01, 0.6, most_tokens=None).collect()
    assert [x["choices"] for x in got] == [[["a"]]] and got[0]["confidence"] == 1.0
