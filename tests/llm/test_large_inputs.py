"""Corpus operators on inputs whose size or shape is unusual."""

import random
import zlib

from pyspark.sql import functions as F

import corpus_pipeline as cp
from fleetlog.llm import language_id

WORDS = {
    "en": ["the", "with", "thing", "house", "water", "stone"],
    "de": ["der", "und", "schön", "Straße", "nicht", "Haus"],
    "fr": ["le", "été", "avec", "où", "eau", "pierre"],
}


def varied(r, lang, n):
    """``n`` words, half of them of any letters, so that a long text holds n-grams of all kinds."""
    strange = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyzäéßù", k=r.randint(2, 9)))
    return " ".join(r.choice(WORDS[lang]) if r.random() < 0.5 else strange() for _ in range(n))


def languages(spark, names):
    r = random.Random(7)
    made = [(i, varied(r, names[i % len(names)], r.randint(20, 300)), names[i % len(names)]) for i in range(150)]
    return r, language_id.fit(spark.createDataFrame(made, "doc_id long, text string, lang string"))


def test_language_of_varied_texts_of_megabytes(spark):
    r, model = languages(spark, list(WORDS))
    texts = [(f"{k} {n}", varied(r, k, n)) for k in WORDS for n in (100, 10_000, 400_000)]
    assert max(len(t) for _, t in texts) > 2_000_000
    got = {x["name"]: x for x in language_id.predict(spark.createDataFrame(texts, "name string, text string"), model).collect()}
    assert {n: x["lang_pred"] for n, x in got.items()} == {n: n[:2] for n, _ in texts}
    assert all(x["score"] > 0.9 for x in got.values())


def test_language_counts_a_long_text_to_its_end(spark):
    r, model = languages(spark, list(WORDS))
    text = varied(r, "en", 20_000) + " 12345" * 200_000 + varied(r, "de", 100_000)
    assert language_id.predict(spark.createDataFrame([(text,)], "text string"), model).first()["lang_pred"] == "de"


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return {r["doc_id"] for r in cp.identify_language(spark, docs, "").select("doc_id").collect()}


def test_pipeline_keeps_clean_texts_among_many_languages(spark):
    r = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:02}": ["".join(r.choices(letters[k:] + letters[:k], range(26, 0, -1), k=r.randint(2, 8))) for _ in range(40)] for k in range(16)}
    text = lambda k, n: " ".join(r.choice(words[k]) for _ in range(n))
    rows = [(i, text(k, r.randint(40, 200)), k) for i in range(480) for k in [f"l{i % 16:02}"]]
    rows += [(1000 + i, text(k, 3), None) for i, k in enumerate(words)]
    rows += [(2000 + i, text(k, 100_000), None) for i, k in enumerate(words) if i % 5 == 0]
    assert kept(spark, rows) == {i for i, _, _ in rows}


def test_pipeline_drops_texts_between_two_languages(spark):
    r = random.Random(9)
    ids = [i for i in range(150) if zlib.crc32(str(i).encode()) % 5]  # learned from, so that both names have the same texts
    texts = [" ".join(r.choice(WORDS["en"]) for _ in range(60)) for _ in range(len(ids) // 2)]
    assert not kept(spark, [(i, texts[a // 2], ("en", "xx")[a % 2]) for a, i in enumerate(ids[: 2 * len(texts)])])
    assert len(kept(spark, [(i, varied(r, k, 60), k) for i in range(120) for k in [("en", "de")[i % 2]]])) == 120
