"""The corpus pipeline, stage by stage, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from fleetlog.llm._tokens import encoder
from fleetlog.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(11)
    words = {"en": ["the", "with", "thing", "house", "water", "stone", "river"], "de": ["der", "und", "schön", "Straße", "nicht", "Haus", "Stein"]}
    text = lambda k, n: " ".join(r.choice(words[k]) + str(r.randint(0, 40)) * (r.random() < 0.3) for _ in range(n))
    rows = [(i, f"{text(k, r.randint(20, 60))}\n{text(k, 30)}", k) for i in range(120) for k in [("en", "de")[i % 2]]]
    shared = "this very line is in a great many of the documents here"
    rows = [(i, f"{t}\n{shared}" if i % 5 == 0 else t, k) for i, t, k in rows]
    base = rows[2][1].split(" ")
    for i in range(120, 130):
        w = list(base)
        w[r.randrange(len(w))] = "edit"
        rows.append((i, " ".join(w), "en"))
    rows += [(130, "12 34 !!", "en"), (131, None, None), (132, "", "de"), (133, rows[0][1], "en")]
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, k, "src", len(t or "")) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 120, 3)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    return folder


def by_id(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages_follow_each_other(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    names = docs.columns
    whole = by_id(docs)
    steps = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "ngram_join", "mixing", "packing"]

    first = steps["language_id"](spark, docs, corpus)
    kept = by_id(first)
    assert first.columns == names and kept == {i: t for i, t in whole.items() if i not in (130, 131, 132)}

    second = steps["line_dedup"](spark, first, corpus)
    holders = {}
    for i, t in kept.items():
        for line in t.split("\n"):
            holders.setdefault(line.strip().lower(), set()).add(i)
    stays = lambda i, line: len(line) < 20 or len(holders[line.strip().lower()]) < 3 or i == max(holders[line.strip().lower()])
    want = {i: "\n".join(x for x in t.split("\n") if stays(i, x)) for i, t in kept.items()}
    assert second.columns == names and by_id(second) == want
    assert second.filter(F.col("n_chars") != F.length("text")).count() == 0

    third = steps["ngram_join"](spark, second, corpus)
    sets = {}
    for i, t in want.items():
        w = re.split(r"\s+", t.strip().lower())
        sets[i] = {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if t.strip() else set()
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if g == old else g for k, g in group.items()}
    left = {i: want[i] for i in want if group[i] == i}
    assert third.columns == names and by_id(third) == left and len(left) < len(want) - 5

    fourth = steps["mixing"](spark, third, corpus)
    assert fourth.columns == names
    copies = {r["doc_id"]: r["n"] for r in fourth.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert set(copies) <= set(left) and max(copies.values()) <= 3

    pieces = steps["packing"](spark, fourth, corpus).collect()
    encode = encoder(tokenizer_file("word_bpe_49k.json")).whole
    tokens = {}
    for p in pieces:
        tokens[p["doc_id"]] = tokens.get(p["doc_id"], 0) + p["length"]
    assert tokens == {i: n * (len(encode(left[i])) // 4 + 1) for i, n in copies.items()}


def test_run_gives_packed_pieces(spark, corpus):
    made = cp.run(spark, corpus)
    fill = made.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert fill.filter("n <> end OR n > 2048").count() == 0
    assert made.filter("ids IS NULL").count() == 0
