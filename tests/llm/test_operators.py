"""Corpus operators against brute force on small documents with nulls, ties, repeats and clashes."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlog.llm import binary_records, fingerprint, language_id, line_dedup, mixing, ngram_join, packing, suffix_dedup, topk, url_filter
from fleetlog.llm._tokens import encoder, slices
from fleetlog.llm.queries import URL_RULES, tokenizer_file

#: Columns of documents and names that the operators use themselves.
CLASH = ["h", "n", "rid", "rest", "lines", "pos", "kept", "words", "features", "k_id", "r_text", "u", "row", "bucket", "home", "found", "n_lines", "score", "rate", "host", "uid", "fixed"]
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(c, T.StringType()) for c in CLASH)])


def rows(seed=0):
    r = random.Random(seed)
    vocabulary = ["the", "of", "Anlage", "été", "niño", "über", "casa", "x1", "###", "river", "stone", "Σς", "…"] + [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared = "A line that very many documents hold, with Ümlaut"
    base = text(200)
    found = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, text(30)), (None, None), (4, "   \t\n \x0b"), (5, text(6000) + "\n" + text(20)), (6, "z" * 9000), (7, "0 1 2 !!"), (2**40, text(50))]
    for i in range(10, 40):
        lines = [text(r.randint(1, 25)) for _ in range(r.randint(1, 5))]
        if i % 3 == 0:
            lines.insert(r.randint(0, len(lines)), "  " + (shared.upper().replace("Ü", "ü") if i % 2 else shared) + "\t")
        found.append((i, "\n".join(lines)))
    for i in range(40, 60):
        w = base.split(" ")
        for _ in range(r.choice((0, 1, 2, 6, 12))):
            w[r.randrange(len(w))] = "edit"
        found.append((i, " ".join(w)))
    found += [(60, base), (61, base), (61, base)]
    r.shuffle(found)
    return found


def frame(spark, found):
    return spark.createDataFrame([(a, b, *["1"] * len(CLASH)) for a, b in found], DOCS).repartition(3)


def key(x):
    return (x is not None, x or 0)


def test_line_dedup(spark):
    found = rows()
    kept = line_dedup.dedup_lines(frame(spark, found))
    assert set(DOCS.names) <= set(kept.columns)
    strip = lambda x: re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", x)
    low = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x)
    holders = {}
    for i, t in found:
        for line in (t or "").split("\n"):
            k = low(strip(line))
            if len(k) >= 20 and i is not None:
                holders.setdefault(k, set()).add(i)
    last = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    want = []
    for i, t in found:
        lines = (t or "").split("\n")
        stay = [x for x in lines if (k := low(strip(x))) not in last or i == last[k]]
        want.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    order = lambda x: (key(x[0]), x[1])
    assert sorted(map(tuple, kept.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=order) == sorted(want, key=order)
    assert sum(x[3] for x in want) > 5


def check_packed(pieces, found, size=2048):
    encode = encoder(tokenizer_file("word_bpe_49k.json")).whole
    texts = {}
    for i, t in found:
        texts.setdefault(i, []).append(np.append(np.frombuffer(encode(t or ""), "<u4"), 1))
    sequences, by_doc = {}, {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        by_doc.setdefault(p["doc_id"], []).append(p)
    used = padded = 0
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at and n > 0
            at += n
        assert at <= size
        used, padded = used + at, padded + size
    for i, t in texts.items():
        assert sum(p["length"] for p in by_doc[i]) == sum(map(len, t))
        if len({x.tobytes() for x in t}) == 1:
            for p in by_doc[i]:
                part = t[0][p["start"] : p["start"] + p["length"]]
                assert p["doc_tokens"] == len(t[0]) and p["ids_crc32"] == zlib.crc32(part.astype("<u4").tobytes())
                assert p["ids"] is None or bytes(p["ids"]) == part.astype("<u4").tobytes()
    assert set(by_doc) == set(texts)
    return used / padded


@pytest.mark.parametrize("with_ids", [True, False])
def test_packing(spark, with_ids):
    found = rows() + [(1000 + i, t) for i, (_, t) in enumerate(rows(5) * 4)]
    pieces = packing.pack(frame(spark, found), tokenizer_file("word_bpe_49k.json"), open_windows=4, group=2, with_ids=with_ids).collect()
    assert check_packed(pieces, found) > 0.9


def test_windows_hold_few_and_waste_little():
    r, w, full = random.Random(3), packing.Windows(100, 5, 4), []
    for i in range(2000):
        full += list(w.place(i, b"abcd" * r.randint(1, 250)))
        assert len(w.held) <= 5 and sorted(n for _, n in w.order) == sorted(w.held)
    fill = [sum(len(p[3]) for p in x) // 4 for x in full]
    assert max(fill) <= 100 and sum(fill) > 0.97 * 100 * len(fill)


def test_binary_records_round_trip(spark, tmp_path):
    found = rows()
    folder = str(tmp_path / "records")
    manifest = binary_records.write_records(frame(spark, found), folder, tokenizer_file("byte_bpe_50k.json"), shard_bytes=4000)
    assert manifest.count() > 5 and manifest.filter("records > 1").count() > 1
    got = [(r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in binary_records.read_records(spark, folder).orderBy("start").collect()]
    encode = encoder(tokenizer_file("byte_bpe_50k.json")).whole
    assert [key(g[0]) for g in got] == sorted(key(i) for i, _ in found)
    assert sorted((key(g[0]), g[3]) for g in got) == sorted((key(i), (encode(t) if t else b"") + b"\0" * 4) for i, t in found)
    at = 0
    for _, start, n, ids in got:
        assert start == at and len(ids) == 4 * n
        at += n
    assert manifest.agg(F.sum("ids")).first()[0] == at
    shard = manifest.first()["shard"]
    data = bytearray((tmp_path / "records" / f"{shard}.rec").read_bytes())
    data[30] ^= 1
    (tmp_path / "records" / f"{shard}.rec").write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        binary_records.read_records(spark, folder).collect()


def test_suffix_dedup(spark):
    found = rows()
    got = suffix_dedup.remove_repeats(frame(spark, found), chunk_bytes=9000, range_bytes=20000).collect()
    first = {}
    for i, t in found:
        b = (t or "").encode()
        if i is not None:
            for a in range(len(b) - 49):
                first[b[a : a + 50]] = min(first.get(b[a : a + 50], i), i)
    want = []
    for i, t in found:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - 49):
            if i is not None and first[b[a : a + 50]] < i:
                gone[a : a + 50] = b"\1" * 50
        spans = len(re.findall(b"\1+", bytes(gone)))
        want.append((key(i), len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    assert sorted((key(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == sorted(want)
    assert sum(w[2] for w in want) > 10_000


def test_loser_tree_merges_and_knows_prefixes():
    r = random.Random(4)
    for k in (1, 2, 3, 5, 8):
        runs = [sorted({bytes(r.choice(b"ab") for _ in range(suffix_dedup.WIDTH)) for _ in range(r.randint(1, 40))} | {b"a" * suffix_dedup.WIDTH}) for _ in range(k)]
        coded = [suffix_dedup.front_coded(np.frombuffer(b"".join(x), np.uint8).reshape(-1, suffix_dedup.WIDTH)) for x in runs]
        got, before = list(suffix_dedup.merged([suffix_dedup.strings_of(*c) for c in coded])), b""
        assert [g[1] for g in got] == sorted(x for run in runs for x in run)
        for _, text, same in got:
            n = 0
            while n < len(before) and n < len(text) and before[n] == text[n]:
                n += 1
            assert same == n
            before = text


def test_topk(spark):
    r = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in r.normal(0, 0.2, 8)]) for i in range(300)]
    vectors += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, [0.5, 0.25]), (305, vectors[0][1]), (306, vectors[0][1]), (40, vectors[1][1]), (307, [])]
    df = spark.createDataFrame([(a, b, "x") for a, b in vectors], "vec_id long, embedding array<float>, rank string")
    got = topk.top_k(df.filter("vec_id % 20 = 0"), df, k=7, query_block=5, shard_rows=64)
    sound = [(i, np.floor(64 * np.pad(np.array(v, np.float32).astype(float), (0, 8 - len(v)))).astype(int)) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, q in sound:
        if i % 20 == 0:
            want += [(i, k + 1, j, s) for k, (s, j) in enumerate((-s, j) for s, j in sorted((-int(q @ v), j) for j, v in sound if j != i)[:7])]
    ties = {}
    for a, b, c, d in want:
        ties.setdefault(a, []).append((b, c, d))
    have = {}
    for x in got.collect():
        have.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    assert {k: sorted(v) for k, v in have.items() if k != 40} == {k: sorted(v) for k, v in ties.items() if k != 40}


def test_ngram_join(spark):
    found = rows()
    got = {(key(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_join(frame(spark, found), group_size=4, block=3).collect()}
    sets = []
    for i, t in found:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets.append((i, {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set()))
    top = {i: i for i, _ in sets if i is not None}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((root(i), root(j)))
                top[q] = p
    assert got == {(key(i), len(x), None if i is None else root(i)) for i, x in sets}
    assert len({g[2] for g in got}) < len(top) - 5


def test_language_id(spark):
    r = random.Random(6)
    words = {"en": ["the", "with", "thing", "house", "water"], "de": ["der", "und", "schön", "Straße", "nicht"], "fr": ["le", "été", "avec", "où", "eau"]}
    made = [(i, " ".join(r.choice(words[k]) for _ in range(r.randint(3, 40))), k) for i in range(300) for k in [("en", "de", "fr")[i % 3]]]
    df = spark.createDataFrame([*made, (900, None, "en"), (901, "12 !!", "en"), (902, "", None), (903, "water " * 100_000, None)], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = language_id.fit(df.filter(~language_id.held_out(F.col("doc_id"))))
    got = {r["doc_id"]: r for r in language_id.predict(df, model).collect()}
    held = [(i, k) for i, _, k in made if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["lang_pred"] == k for i, k in held) >= 0.97 * len(held)
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"]
    assert all(0 <= x["score"] <= 1 for x in got.values()) and got[900]["score"] == 0
    none = language_id.fit(df.filter("doc_id < 0"))
    assert language_id.predict(df, none).filter("lang_pred <> 'und'").count() == 0


def test_fixed_url_rules(spark):
    want = {
        "http://www.example.com/en/1": "www.example.com/en/", "HTTP://a.EXAMPLE.com/en/x?y": "example.com/en/", "https://example.com/en": "com/", "https://x.net/es/": "net/", "https://x.net/esx": None,
        "https://x.org/": None, "https://com/": "com/", "https://com": None, "no scheme": None, "": None, "a://b.net?x=/es/": None, "//x": None,
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*want, None])], "page_id long, url string").withColumns({"uid": F.lit("1"), "host": F.lit("2"), "row": F.lit("3")})
    got = {r["url"]: r for r in url_filter.filter_urls(df, URL_RULES).collect()}
    for u, rule in want.items():
        assert got[u]["rule"] == (None if rule is None else "net/es/" if rule == "net/" else rule), u
    assert (got[None]["host"], got[None]["path"], got[None]["verdict"]) == ("", "", "allow")
    assert (got["HTTP://a.EXAMPLE.com/en/x?y"]["host"], got["HTTP://a.EXAMPLE.com/en/x?y"]["path"]) == ("a.example.com", "/en/x")
    assert (got["a://b.net?x=/es/"]["host"], got["a://b.net?x=/es/"]["path"]) == ("b.net", "")


def test_association_rules_find_planted_hosts(spark):
    r = random.Random(7)
    pages = [(i, f"https://{'spam' if i % 4 == 0 else r.choice(['a', 'b', 'c'])}.site.org/{r.choice(['en', 'de'])}/{i}{'?utm=1' if i % 8 == 0 else ''}") for i in range(400)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 4 == 0) for i in range(0, 400, 2)] + [(1, None)], "page_id long, blocked boolean")
    got = url_filter.filter_urls(df, [], labels)
    assert {r["page_id"] for r in got.filter("verdict = 'block'").collect()} == {i for i, _ in pages if i % 4 == 0}
    nobody = url_filter.filter_urls(df, [], labels.filter("page_id < 0"))
    assert nobody.filter("verdict = 'block'").count() == 0


def test_fingerprints(spark):
    found = [x for x in rows() if x[0] != 61] + [(61, "repeat\nme"), (61, "repeat\nme")]
    got = fingerprint.fingerprints(frame(spark, found)).collect()
    docs = sorted(((i, t or "") for i, t in found if i is not None), key=lambda x: x[0])
    nulls = [x for x in found if x[0] is None]
    parts = lambda x: set(re.findall("[^\n]{1,128}", x))
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(found)
    for (i, t), (_, n) in zip(docs, docs[1:]):
        if i in (3, 61):  # repeated
            continue
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        r = by[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest()), i
        assert r["near_edited"] == pytest.approx(like(parts(t), parts(e))) and r["near_next"] == pytest.approx(like(parts(t), parts(n)))
    same = {}
    for i, t in docs:
        same.setdefault(t, set()).update(r["fingerprint"] for r in got if r["doc_id"] == i)
    assert all(len(x) == 1 for x in same.values()) and len(nulls) == sum(r["doc_id"] is None for r in got)


def test_mixing_meets_targets(spark):
    r = random.Random(8)
    kinds = [["fine", "river", "stone"], ["junk", "###", "buy"], ["scum", "trash", "moron"]]
    made = [(i, " ".join(r.choice(kinds[i % 3]) for _ in range(r.randint(5, 60)))) for i in range(300)] + [(0, "fine river"), (0, "fine river"), (400, None), (None, "fine")]
    docs = frame(spark, made)
    labels = spark.createDataFrame([(i, int(i % 3 != 1), int(i % 3 == 2)) for i in range(0, 300, 2)] + [(1, None, None)], "doc_id long, quality int, toxic int")
    for weights, feasible in (((0.6, 0.3, 0.25), True), ((0.5, 0.1, 0.01), False)):
        got = mixing.mix(docs, labels, dict(zip(mixing.DOMAINS, weights)))
        assert got.count() == len(made) and set(CLASH) - {"rate"} <= set(got.columns)
        pdf = got.select("n_tokens", "rate", "posterior", "copies").toPandas()
        p, t = np.array(pdf.posterior.tolist()), pdf.n_tokens.to_numpy()
        totals = (pdf.rate.to_numpy() * t) @ p / t.sum()
        assert pdf.rate.min() >= 0 and abs((pdf.copies * t).sum() - (pdf.rate * t).sum()) / t.sum() < 0.08
        # Brute force: many small projected steps on the same squares.
        rate, aim = np.ones(len(t)), np.array(weights) * t.sum()
        inverse = np.linalg.inv((p * t[:, None]).T @ p)
        for _ in range(5000):
            rate = np.maximum(0, rate + 0.3 * p @ inverse @ (aim - (rate * t) @ p))
        assert totals == pytest.approx((rate * t) @ p / t.sum(), abs=1e-3)
        if feasible:
            assert totals == pytest.approx(weights, abs=1e-4)
            assert np.abs(rate - pdf.rate.to_numpy())[t > 0].max() < 1e-2
    plain = mixing.mix(docs, labels.filter("doc_id < 0"), {"high": 1.0, "low": 0.0, "toxic": 0.0})
    assert plain.count() == len(made)


def test_empty_tables(spark):
    docs = frame(spark, [])
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string")
    assert line_dedup.dedup_lines(docs).count() == 0
    assert packing.pack(docs, tokenizer_file("word_bpe_49k.json")).count() == 0
    assert suffix_dedup.remove_repeats(docs).count() == 0
    assert topk.top_k(vectors, vectors).count() == 0
    assert ngram_join.jaccard_join(docs).count() == 0
    assert fingerprint.fingerprints(docs).count() == 0
    assert mixing.mix(docs, labels, {"high": 1.0, "low": 0.0}).count() == 0
    assert url_filter.filter_urls(pages, URL_RULES).count() == 0
    model = language_id.fit(docs.withColumn("lang", F.lit("en")))
    assert language_id.predict(docs, model).count() == 0


def test_empty_records(spark, tmp_path):
    folder = str(tmp_path / "none")
    binary_records.write_records(frame(spark, []), folder, tokenizer_file("byte_bpe_50k.json"))
    assert binary_records.read_records(spark, folder).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_memo_changes_no_ids(name):
    e, r = encoder(tokenizer_file(name)), random.Random(9)
    bits = list(" \n\t\x1c  ab'sStlE1.,!éÉΣς中😀|") + ["<|endoftext|>", "'s", "  ", "\n\n", "\r\n", "\u3000", "e\u0301", "word", "Été***"]
    texts = [None, "", " ", "\n", *("".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(4000))]
    for low, high in slices(pa.array(texts), 4000):
        ids, starts, ends = e.encode(pa.array(texts)[low:high])
        for text, a, b in zip(texts[low:high], starts, ends):
            assert ids[a:b].tobytes() == e.whole(text or ""), repr(text)
