"""Corpus operators on odd ids, hot keys and failures, and parts of them against plain Python."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from fleetlog.llm import fingerprint, language_id, line_dedup, ngram_join, suffix_dedup, topk, url_filter

LONG = 9_000_000_000_000_000_000


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_topk_leaves_null_ids_out(spark):
    r = np.random.default_rng(1)
    rows = [(None if i % 7 == 3 else i, [float(x) for x in r.normal(0, 0.3, 6)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in topk.top_k(df.filter("vec_id % 20 = 0"), df, k=5).collect()}
    whole = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None]
    for i, q in whole:
        if i % 20 == 0:
            best = sorted((-int(q @ v), j) for j, v in whole if j != i)[:5]
            assert [got[i, k + 1] for k in range(5)] == [(j, -s) for s, j in best]


def test_max_score_on_sparse_terms_equals_brute_force():
    r = np.random.default_rng(2)
    v = r.integers(-40, 40, (3000, 50)) * (r.random((3000, 50)) < 0.1)
    q = r.integers(-40, 40, (70, 50)) * (r.random((70, 50)) < 0.2)
    best = topk.max_score(np.arange(70), q, np.arange(3000), v, 20, block=256)
    for i in range(70):
        want = sorted((-int(q[i] @ v[j]), j) for j in range(3000) if j != i)[:20]
        assert [(-int(s), int(j)) for j, s in zip(*best[i])] == want


def paragraphs(text):
    return list(dict.fromkeys(re.findall("[^\n]{1,128}", text)))


def test_fingerprint_is_the_sketch_of_its_paragraphs(spark):
    r = random.Random(3)
    texts = ["", "one", *("\n".join(str(r.randint(0, 50)) for _ in range(n)) for n in (1, 5, 40, 300))]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    d, size = F.col("d"), F.lit(fingerprint.CELLS // 3).cast("long")
    places = [fingerprint.cell_of(d, t, size, fingerprint.SEED).alias(f"t{t}") for t in range(3)]
    hashed = spark.createDataFrame([(p,) for t in texts for p in paragraphs(t)] or [("",)], "p string").select("p", F.xxhash64("p").alias("d"))
    known = {x["p"]: x for x in hashed.select("p", "d", fingerprint.check_of(d).alias("c"), *places).distinct().collect()}
    for row in df.select("text", fingerprint.sketch(fingerprint.digests(F.col("text"))).alias("s")).collect():
        cells = [[0, 0, 0] for _ in range(fingerprint.CELLS)]
        for p in paragraphs(row["text"]):
            x = known[p]
            for t in range(3):
                c = cells[x[f"t{t}"]]
                c[0], c[1], c[2] = c[0] + 1, c[1] ^ x["d"], c[2] ^ x["c"]
        want = [str(len(paragraphs(row["text"]))), *(".".join(f"{v & (2**64 - 1):X}" for v in c) for c in cells)]
        assert row["s"] == "|".join(want)


def test_fingerprints_peel_or_say_that_they_fail(spark):
    r = random.Random(4)
    rows = []
    for i in range(200):
        base = [f"p{r.randint(0, 10**9)}" for _ in range(r.randint(0, 60))]
        other = [f"q{r.randint(0, 10**9)}" for _ in range(r.choice((0, 1, 2, 4, 8, 60)))]
        rows.append((i, "\n".join(base), "\n".join(base[: len(base) - len(other) // 2] + other)))
    df = spark.createDataFrame(rows, "id long, a string, b string")
    found = df.select("id", fingerprint.digests(F.col("a")).alias("mine"), fingerprint.digests(F.col("b")).alias("yours"))
    cells = found.withColumns({"ca": fingerprint.cells_of(F.col("mine")), "cb": fingerprint.cells_of(F.col("yours"))})
    got = {x["id"]: x["same"] for x in fingerprint.by_fingerprints(cells, {"same": ("ca", "cb")}).select("id", "same").collect()}
    want = {i: len(set(paragraphs(a)) ^ set(paragraphs(b))) for i, a, b in rows}
    assert all(got[i] in (None, n) for i, n in want.items())
    assert all(got[i] is not None for i, n in want.items() if n <= 2) and any(got[i] is None for i in want)
    # Tables that are too small fail, are tried again twice as large, and at last counted from the digests.
    pairs = found.select(F.col("id").alias("pid"), F.lit("x").alias("kind"), "mine", "yours")
    tight = fingerprint.compare(pairs, attempts=3, size=F.lit(1).cast("long"))
    assert {x["pid"]: x["differ"] for x in tight.collect() if x["differ"]} == {i: n for i, n in want.items() if n}


def test_fingerprints_of_far_apart_and_null_ids(spark):
    r = random.Random(5)
    text = lambda: "\n".join(str(r.randint(0, 10**6)) for _ in range(r.randint(1, 6)))
    rows = [(i, text()) for i in range(2000)] + [(-LONG, text()), (LONG, text()), (2**40, text())] + [(None, text()) for _ in range(1000)]
    got = {x["doc_id"]: x for x in fingerprint.fingerprints(documents(spark, rows)).collect() if x["doc_id"] is not None}
    docs = sorted((x for x in rows if x[0] is not None), key=lambda x: x[0])
    for (i, t), (_, n) in zip(docs, docs[1:]):
        a, b = set(paragraphs(t)), set(paragraphs(n))
        assert got[i]["near_next"] == pytest.approx(len(a & b) / len(a | b))
    keyed = documents(spark, rows).withColumn("h", F.xxhash64("text"))
    drawn = sorted({(x["doc_id"], x["h"]) for x in keyed.collect()}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    bounds = [drawn[len(drawn) * i // 12] for i in range(1, 12)]
    sizes = [x["count"] for x in keyed.groupBy(fingerprint.bucket_of(F.struct("doc_id", "h"), bounds).alias("b")).count().collect()]
    assert len(sizes) == 12 and max(sizes) < 2 * len(rows) / 12


def test_hot_lines_by_broadcast_give_the_same(spark, monkeypatch):
    r = random.Random(6)
    lines = [f"a line that is long enough {i}" for i in range(40)]
    rows = [(i, "\n".join([lines[0], *r.choices(lines, k=r.randint(0, 6))])) for i in range(300)] + [(None, lines[0])]
    made = []
    for hot in (10_000, 6, 1):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        made.append(sorted((x["doc_id"] or -1, x["text"], x["n_dropped"]) for x in line_dedup.dedup_lines(documents(spark, rows)).collect()))
    assert made[0] == made[1] == made[2] and sum(x[2] for x in made[0]) > 500


def test_mined_rules_are_those_of_a_plain_miner(spark):
    r = random.Random(7)
    rows = []
    for i in range(600):
        tokens = [f"t{k}" for k in range(6) if r.random() < 0.4] + (["rare"] if i % 200 == 0 else [])
        rows.append((tokens, r.random() < (0.9 if {"t1", "t3"} <= set(tokens) else 0.15)))
    rows += [([], True)]
    got = url_filter.learn_rules(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), 0.01, 0.6, min_rows=20, z=2.33)
    listed = [(set(t), b) for t, b in rows if t]
    n, base = len(listed), sum(b for _, b in listed) / len(listed)
    want = {}
    names = sorted({x for t, _ in listed for x in t if x != "rare"})
    for size in range(1, len(names) + 1):
        for rule in itertools.combinations(names, size):
            seen = [b for t, b in listed if set(rule) <= t]
            bad = sum(seen)
            if bad < 20 or bad / n < 0.01 or bad / len(seen) < 0.6:
                continue
            p, m, z = bad / len(seen), len(seen), 2.33
            if (p + z * z / (2 * m) - z * math.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m) > base:
                want[rule] = (p, bad / n)
    made = {tuple(x["rule_tokens"]): (x["confidence"], x["support"]) for x in got.collect()}
    assert ("t1", "t3") in want and set(made) == set(want)
    assert all(made[k] == pytest.approx(want[k]) for k in want)


def test_few_bad_rows_make_no_rules(spark):
    rows = [([f"t{i}"], i % 10 == 0) for i in range(100)]
    assert url_filter.learn_rules(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), 0.005, 0.6).count() == 0


def test_kernel_counts_shared_buckets():
    r = random.Random(8)
    texts = ["".join(r.choice("abc é") for _ in range(r.randint(1, 80))) for _ in range(12)]
    lengths, buckets = (1, 2, 3), 512

    def held(text):
        data, out = text.lower().encode(), set()
        for n in lengths:
            for a in range(len(data) - n + 1):
                h = n
                for c in data[a : a + n]:
                    h = (h ^ c) * 0x9E3779B1 & 0xFFFFFFFF
                out.add(h >> (32 - (buckets - 1).bit_length()))
        return out

    marks = np.zeros((3, buckets), np.float32)
    for i in range(3):
        marks[i, list(held(texts[i]))] = 1
    got = language_id.likeness(texts, marks, lengths)
    for t, row in zip(texts, got):
        weight = any(c.isalpha() for c in t)
        for i in range(3):
            a, b = held(t), held(texts[i])
            assert row[i] == pytest.approx(len(a & b) / math.sqrt(len(a) * len(b)) if weight else 0, abs=1e-6)


def test_suffixes_at_one_anchor_in_ten_are_sorted():
    import pyarrow as pa

    r = random.Random(9)
    passage = " ".join(str(r.randint(0, 10**6)) for _ in range(2000))
    texts = [" ".join(str(r.randint(0, 10**6)) for _ in range(2000)) for _ in range(10)]
    chunk = suffix_dedup.Chunk(pa.table({"doc_id": list(range(20)), "text": [passage + t for t in texts] + texts}))
    position, _, _ = chunk.anchors()
    run = chunk.run(np.zeros(0, np.uint64))
    assert 0.07 < len(position) / len(chunk.bytes) < 0.14
    # All but the few at the ends of passages have an equal one in another document, so all are sorted.
    assert len(run.position) > 0.99 * len(position)


def test_suffixes_of_null_ids_are_dealt_and_kept(spark):
    r = random.Random(10)
    text = " ".join(str(r.randint(0, 999)) for _ in range(60))
    rows = [(None, f"{text} {i}") for i in range(60)] + [(5, text), (6, text)]
    got = suffix_dedup.remove_repeats(documents(spark, rows), chunk_bytes=2000, range_bytes=3000).collect()
    assert sum(x["n_removed"] for x in got) == len(text) and {x["n_removed"] for x in got if x["doc_id"] != 6} == {0}


def test_join_of_a_large_group_of_copies(spark):
    r = random.Random(11)
    base = [f"w{r.randint(0, 99)}" for _ in range(60)]
    rows = [(i, " ".join(base)) for i in range(150)]
    for i in range(150, 330):
        w = list(base)
        w[r.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"y{r.randint(0, 10**6)}" for _ in range(30))) for i in range(20)]
    # Copies of copies: neighbours link, those far apart don't, and here and there the chain breaks.
    for chain in range(3):
        w = [f"z{r.randint(0, 99)}" for _ in range(70)]
        for i in range(90):
            for _ in range(12 if i % 40 == 39 else r.choice((0, 1, 2))):
                w[r.randrange(70)] = f"e{r.randint(0, 10**6)}"
            rows.append((2000 + 3 * i + chain, " ".join(w)))
    r.shuffle(rows)
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.jaccard_join(documents(spark, rows), group_size=16, block=8).collect()}
    sets = {i: {tuple(w[a : a + 5]) for a in range(len(w) - 4)} for i, t in rows for w in [t.split(" ")]}
    top = {i: i for i in sets}
    for i, j in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and top[i] != top[j]:
            old, new = max(top[i], top[j]), min(top[i], top[j])
            top = {k: new if g == old else g for k, g in top.items()}
    assert got == top and len(set(top.values())) > 25


def pipeline_documents(spark, rows):
    made = [(i, t, k, "src", len(t or ""), "x", "y") for i, t, k in rows]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, score string, rate string")


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    words = ["the", "with", "thing", "house", "water"]
    r = random.Random(12)
    rows = [(i, " ".join(r.choice(words) for _ in range(30)) + f" {i}", "en") for i in range(30)]
    rows += [rows[0], rows[0], (None, "the house with water", None), (40, None, None), (41, "", "en"), (42, "the water " * 30_000, None)]
    for docs in (pipeline_documents(spark, rows), pipeline_documents(spark, [])):
        for _, step in cp.STAGES[:-1]:
            before = docs.columns
            docs = step(spark, docs, str(tmp_path))
            assert docs.columns == before
        assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= (1 if rows and docs.count() else 0)
