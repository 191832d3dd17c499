"""Spelling variants, BPE and hard negatives against brute force and the tokenizers library."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetlog.llm import bpe, fingerprint, negatives, spelling, topk, url_filter
from fleetlog.llm.queries import tokenizer_file

BYTES = tokenizer_file("byte_bpe_50k.json")


def one_edit(a, b):
    """Whether exactly one inserted, deleted or replaced letter leads from a to b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(words, times=2):
    """(word, form, root, n, n_near, form_n) by comparing all words."""
    near = {w: [x for x in words if one_edit(w, x)] if len(w) >= 4 else [] for w in words}
    near = {w: [x for x in v if len(x) >= 4] for w, v in near.items()}
    form = {}
    for w, v in near.items():
        best = min(v, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    found = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        found.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return found


def made_words(seed, size, alphabet):
    r = random.Random(seed)
    words = {}
    for _ in range(size):
        w = "".join(r.choice(alphabet) for _ in range(r.choice((1, 3, 4, 4, 5, 6, 7, 9, 14))))
        for _ in range(r.randint(0, 4)):
            words.setdefault(w, r.choice((1, 2, 3, 4, 5, 9, 20, 41, 100)))
            i = r.randrange(len(w) + 1)
            w = r.choice((w[:i] + w[i + 1 :], w[:i] + r.choice(alphabet) + w[i:], w[: max(0, i - 1)] + r.choice(alphabet) + w[i:])) or "q"
    return words


@pytest.mark.parametrize("alphabet", ["ab", "abcdeé", "abcdefghijklmnopqrstuvwxyzàÿÐ", "añ日本語🙂ſ"])
def test_variants_equal_all_pairs(spark, alphabet):
    words = made_words(len(alphabet), 150, alphabet)
    df = spark.createDataFrame([(w, n, "x") for w, n in words.items()] + [(None, 5, "x")], "word string, n int, near string")
    got = spelling.group_variants(df.repartition(3))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = variants(words)
    assert set(map(tuple, got.collect())) == want and sum(x[1] is not None for x in want) > 10


def test_variants_with_hot_places(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HOT", 3)
    words = made_words(9, 200, "abc")
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert set(map(tuple, spelling.group_variants(df).collect())) == variants(words)


def test_variants_of_long_chains_and_words(spark):
    chain = {"b" * i + "a" * (40 - i): 3 * 2**i for i in range(20)}  # each is one letter from the next
    long = "".join(random.Random(4).choice("abcdefgh") for _ in range(30_000))
    words = chain | {long: 5, long[:9_999] + long[10_000:]: 20}
    got = {x["word"]: x for x in spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert {got[w]["root"] for w in chain} == {"b" * 19 + "a" * 21}
    assert got[long]["form_n"] == 20 and got[long]["root"] != long


def test_no_words(spark):
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_pivots_are_the_cheapest_disjoint_pair():
    r = random.Random(5)
    for _ in range(500):
        at = sorted(r.sample(range(12), r.randint(3, 8)))
        cost = [r.randint(1, 6) for _ in at]
        least = min(cost[i] + cost[j] for j in range(len(at)) for i in range(j) if at[j] - at[i] >= 2)
        p, q = spelling.disjoint_pair(at, cost)
        assert q - p >= 2 and cost[at.index(p)] + cost[at.index(q)] == least


def test_words_of_documents(spark):
    r = random.Random(6)
    vocabulary = ["House", "houSe", "MÜnchen", "naïve", "été", "x", "word×word", "a1b", "Straße", "…quoted…", "ŁódźX", "ÿÿÿÿÿ"]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60)))) for i in range(80)]
    docs += [(None, "House house"), (81, None), (82, ""), (83, "house " * 3000), (3, docs[3][1])]
    words = Counter()
    low = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x)
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = low(run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 7 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    df = spark.createDataFrame([(i, t, "c", "c") for i, t in docs], "doc_id long, text string, run string, h string").repartition(3)
    got = spelling.count_words(spelling.dropped_letters(spelling.runs(df), one_in=7))
    assert {tuple(x) for x in got.collect()} == set(words.items())


ODD = ["", " ", "  \n\t ", "a", "<|endoftext|>", "x<|endoftext|><|endof", "it's we'll I'd 'tis", "՘₏letters newer than some libraries", "\x1c\x85  　", "日本語テキスト", "🙂👩‍👩‍👧", "z" * 5000, "ab" * 3000, "=" * 999, "1234567890" * 50, "é" * 700, "é"]


def random_texts(seed, size):
    r = random.Random(seed)
    parts = ["a", "b", "the", " the", "ing", " ", "  ", "\n", "\t", "'s", "'", "é", "…", "中", "🙂", "1", "23", "!", "=", "--", "Ġ", "<|endoftext|>", "ſ", "\x1c", " "]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(size)]


def ids_of(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_bpe_equals_the_library():
    library, own = Tokenizer.from_file(BYTES), bpe.PrefixEncoder(BYTES)
    r = random.Random(8)
    letters = ["".join(r.choice(a) for _ in range(r.randint(1, 300))) for a in ("ab", "aeinrst", "abcdefghijklmnopqrstuvwxyz", "-=_*#") for _ in range(200)]
    texts = [*ODD, *random_texts(1, 2000), *letters]
    ids, starts, ends = own.encode(pa.array(texts))
    for t, a, b in zip(texts, starts, ends):
        assert ids[a:b].tobytes() == own.coder.encode(t) == ids_of(library, t), t
    runs = [ids_of(library, t) for t in texts]
    runs += [np.array([r.randrange(50257) for _ in range(r.randint(0, 12))], "<u4").tobytes() for _ in range(2000)]  # they cut characters
    runs.append(np.array([64, 999_999, 2**32 - 1, 65], "<u4").tobytes())
    assert own.coder.decode(runs) == [library.decode(np.frombuffer(x, "<u4").tolist(), skip_special_tokens=False) for x in runs]
    assert own.coder.decode([]) == [] and own.coder.decode([b""]) == [""]


def test_every_prefix_ends_in_the_last_token_of_its_encoding():
    library, own = Tokenizer.from_file(BYTES), bpe.PrefixCoder(BYTES)
    for word in ("unbelievableness", "aaaaaaaaaaa", "Donaudampfschifffahrt", "xyzzyxyzzy"):
        for _, last in own.last_tokens([word[:3].encode(), word.encode()]):
            pass
        for i in range(1, len(word) + 1):
            assert own.id_of[last[i]] == library.encode(word[:i], add_special_tokens=False).ids[-1]


def test_bpe_needs_a_plain_byte_level_file():
    with pytest.raises(ValueError):
        bpe.PrefixCoder(tokenizer_file("word_bpe_49k.json"))


def test_bpe_of_a_text_in_parts(monkeypatch):
    monkeypatch.setattr(bpe, "TOGETHER", 7)
    monkeypatch.setattr(bpe, "MEMO", 5)
    library, own = Tokenizer.from_file(BYTES), bpe.PrefixCoder(BYTES)
    for text in random_texts(3, 100):
        assert own.encode(text) == ids_of(library, text)


def test_bpe_of_documents(spark):
    library = Tokenizer.from_file(BYTES)
    texts = [None, *ODD, *random_texts(2, 60), "long text. " * 120_000]
    df = spark.createDataFrame([(i if i else None, t, "old", "old") for i, t in enumerate(texts)] * 2, "doc_id long, text string, ids string, decoded string").repartition(3)
    got = bpe.decode_ids(bpe.encode_texts(df, BYTES), BYTES).collect()
    assert len(got) == 2 * len(texts)
    for x in got:
        ids = library.encode(x["text"] or "", add_special_tokens=False).ids
        assert x["n_tokens"] == len(ids) and bytes(x["ids"]) == np.array(ids, "<u4").tobytes()
        assert x["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode_texts(df.limit(0), BYTES).count() == 0


def whole(v, scale):
    return None if v is None or any(x is None or not np.isfinite(x) for x in v) else [int(np.floor(scale * float(np.float32(x)))) for x in v]


def mined(rows, scale=256, k=5):
    """Hard negatives by scoring all pairs; rows are (vec_id, label, vector)."""
    rows = [(i, a, whole(v, scale)) for i, a, v in rows]
    rows = [x for x in rows if None not in x]
    found = []
    for n, (i, label, v) in enumerate(rows):
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for m, (j, other, w) in enumerate(rows) if m != n)
            for p, j, _ in [x for x in scored if x[2] == label][:k]:
                hard = [(s, m) for s, m, other in scored if other != label and 80 * -p <= 100 * -s <= 100 * -p][:k]
                found += [(i, j, rank + 1, m, -p, -s) for rank, (s, m) in enumerate(hard)]
    return sorted(found)


def vectors(seed, size, width=8, spread=0.3):
    r = np.random.default_rng(seed)
    rows = [(int(i), int(r.integers(0, 4)), [float(x) for x in r.normal(0.1, spread, width)]) for i in range(size)]
    rows += [(None, 1, rows[1][2]), (size, None, rows[1][2]), (size + 1, 1, None), (size + 2, 1, [float("nan")] * width), (size + 3, 2, [None] * width), (size + 4, 2, [float("inf")] + [0.0] * (width - 1))]
    rows += [rows[0], rows[5], (200, 3, rows[0][2]), (size + 5, 0, rows[0][2][:3]), (size + 6, 0, [0.0] * width), (size + 7, 1, [])]
    return rows


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(*x, 1, "a", 2) for x in rows], f"vec_id long, label int, embedding array<{kind}>, row int, anchor string, rank int").repartition(3)


@pytest.mark.parametrize("seed,spread,least", [(1, 0.3, 4096), (2, 0.02, 50), (3, 2.0, 100)])
def test_hard_negatives_equal_all_pairs(spark, monkeypatch, seed, spread, least):
    monkeypatch.setattr(negatives, "LEAST", least)
    rows = vectors(seed, 900, spread=spread)
    got = negatives.mine(frame(spark, rows), F.col("vec_id") % 100 == 0, anchor_block=4)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = mined(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20


def test_hard_negatives_of_one_hot_label(spark):
    rows = [(i, 0 if i % 3 else i % 5, v) for i, _, v in vectors(4, 700) if i is not None]
    assert sorted(map(tuple, negatives.mine(frame(spark, rows), F.col("vec_id") % 100 == 0, shard_rows=64).collect())) == mined(rows)
    alone = [(i, 0, v) for i, _, v in rows]
    assert negatives.mine(frame(spark, alone), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine(frame(spark, []), F.col("vec_id") % 100 == 0).count() == 0


def test_hard_negatives_of_large_numbers(spark):
    r = np.random.default_rng(5)
    for size in (1e3, 1e5):  # sums beyond floats, products beyond 32 bits
        rows = [(i, i % 3, [float(np.float32(x)) for x in r.normal(0, size, 6)]) for i in range(300)]
        assert sorted(map(tuple, negatives.mine(frame(spark, rows), F.col("vec_id") % 100 == 0).collect())) == mined(rows)
    rows = [(i, i % 3, [1e12 * (i + 1), 1.0]) for i in range(200)]
    with pytest.raises(Exception, match="too large for a long"):
        negatives.mine(frame(spark, rows), F.col("vec_id") % 100 == 0).collect()


def test_topk_of_repeated_queries_and_large_numbers(spark):
    r = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in r.normal(0, 0.5, 5)]) for i in range(80)]
    rows += [rows[20], (20, rows[3][1]), (40, rows[4][1]), (81, [3.0e6, -3.0e6, 1.5, 0.0, 1.0]), (100, [2.9e6, 2.8e6, -1.0, 0.0, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for x in topk.top_k(df.filter("vec_id % 20 = 0"), df, k=4).collect():
        got.setdefault((x["query_id"], x["rank"]), []).append((x["vec_id"], x["score"]))
    numbers = [(i, whole(v, 64)) for i, v in rows]
    want = {}
    for n, (i, q) in enumerate(numbers):
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(numbers) if m != n)[:4]
            for rank, (s, j) in enumerate(best):
                want.setdefault((i, rank + 1), []).append((j, -s))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    large = spark.createDataFrame([(20, [1e10, 1.0]), (21, [1e10, 2.0]), (22, [0.5, 0.5])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large for a long"):
        topk.top_k(large.filter("vec_id = 20"), large, k=4).collect()
    assert topk.top_k(large.filter("vec_id = 22"), large.filter("vec_id <> 21"), k=4, scale=2).first()["score"] == 20_000_000_002


def test_near_words_meet_in_an_entry():
    met = 0
    for seed in range(40):
        words = [w for w in made_words(seed, 60, random.Random(seed).choice(["a", "ab", "abc", "abcdefgh"])) if len(w) >= 4]
        counts = np.zeros(spelling.BUCKETS, np.int64)
        for w in words:
            np.add.at(counts, spelling.bigrams(spelling.letter_codes([w])[0]), 1)
        rank, cost = np.argsort(np.argsort(counts, kind="stable"), kind="stable").tolist(), counts.tolist()
        keys = {w: spelling.keys_of(w, rank, cost) for w in words}
        for a in words:
            for b in words:
                if (keys[a][0], a) < (keys[b][0], b) and one_edit(a, b):
                    met += 1
                    assert set(keys[a][2]) & set(keys[b][1]), (a, b)
    assert met > 500


def test_buckets_of_fingerprints_where_rows_repeat(spark, monkeypatch):
    """Nearly all rows are one: the others still have bounds."""
    seen = []
    monkeypatch.setattr(fingerprint, "bucket_of", lambda key, bounds, f=fingerprint.bucket_of: seen.append(bounds) or f(key, bounds))
    df = spark.createDataFrame([(5, "same")] * 5000 + [(i, f"text {i}") for i in range(10, 800)], "doc_id long, text string")
    got = {(x["doc_id"], x["text"], x["next_text"]) for x in fingerprint.with_next(df.repartition(3)).select("doc_id", "text", "next_text").collect()}
    assert len(seen[0]) > 10
    assert got == {(5, "same", "same"), (5, "same", "text 10"), (799, "text 799", "same")} | {(i, f"text {i}", f"text {i + 1}") for i in range(10, 799)}


def test_rules_of_as_many_tokens_as_asked_for(spark):
    names = [f"t{i}" for i in range(14)]
    rows = [(names, True)] * 30 + [(names[:k] + names[k + 1 :], False) for k in range(14) for _ in range(4)]
    df = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    assert url_filter.learn_rules(df, 0.01, 0.9).count() == 0  # it takes all fourteen
    assert any(len(x["rule_tokens"]) == 14 for x in url_filter.learn_rules(df, 0.01, 0.9, most_tokens=14).collect())
