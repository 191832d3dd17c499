"""Learnt operators as a whole against plain versions: dense kernel ridge regression, logistic regression, rule matching."""

import random
import re

import numpy as np

from fleetlog.llm import language_id, mixing, url_filter


def test_language_id_equals_dense_kernel_ridge_regression(spark):
    """With every text a landmark, Nyström features lose nothing."""
    r = random.Random(1)
    letters = {"aa": "abcdefgh ", "bb": "efghijkl ", "cc": "ijklmnab "}
    text = lambda k: "".join(r.choice(letters[k]) for _ in range(r.randint(20, 90))) + "x"
    known = [(k, text(k)) for k, n in (("aa", 14), ("bb", 10), ("cc", 18)) for _ in range(n)]
    asked = [text(k) for k in letters for _ in range(12)] + [text("aa")[:20] + text("bb")[:30] for _ in range(6)]
    model = language_id.fit(spark.createDataFrame(known, "lang string, text string").repartition(3), landmarks=3 * 20, buckets=1 << 15)
    got = [(x["lang_pred"], x["score"]) for x in language_id.predict(spark.createDataFrame([(t,) for t in asked], "text string").coalesce(1), model).collect()]

    def grams(t):
        data = t.lower().encode()
        return {data[i : i + n] for n in (1, 2, 3, 4) for i in range(len(data) - n + 1)}

    def alike(a, b):
        return len(a & b) / np.sqrt(len(a) * len(b))

    held, langs = [grams(t) for _, t in known], sorted(letters)
    k = np.array([[alike(a, b) for b in held] for a in held])
    y = np.array([[1.0 if lang == x else -1.0 for x in langs] for lang, _ in known])
    weight = np.array([1 / sum(x == lang for x, _ in known) for lang, _ in known])
    alpha = np.linalg.solve(k + 1e-2 / len(known) * np.diag(1 / weight), y)
    for t, (lang, score) in zip(asked, got):
        margin = np.array([alike(grams(t), b) for b in held]) @ alpha
        p = np.exp(4.0 * (margin - margin.max()))
        p /= p.sum()
        assert abs(p[langs.index(lang)] - score) < 0.02, (margin, lang, score)
        assert langs[int(margin.argmax())] == lang or np.sort(margin)[-1] - np.sort(margin)[-2] < 0.01


def test_mixing_posteriors_equal_plain_logistic_regression(spark):
    r = random.Random(2)
    vocabulary = {0: ["good", "fine", "river", "stone"], 1: ["spam", "cheap", "pills", "stone"], 2: ["hate", "spam", "river", "bad"]}
    text = lambda d: " ".join(r.choice(vocabulary[d] + ["the", "of"]) for _ in range(r.randint(1, 6)))
    labelled = list({(text(d), d) for d in vocabulary for _ in range(60)})
    asked = sorted({text(d) for d in vocabulary for _ in range(30)})
    model = mixing.fit_classifier(spark.createDataFrame(labelled, "text string, domain int"))
    made = mixing.posteriors(spark.createDataFrame([(t,) for t in asked], "text string"), model, ("high", "low", "toxic"))
    got = {x["text"]: x["posterior"] for x in made.collect()}

    words = sorted({w for t, _ in labelled for w in t.split()})

    def features(t):
        present = np.array([float(w in t.split()) for w in words])
        return present / np.linalg.norm(present)

    x, y = np.array([features(t) for t, _ in labelled]), np.eye(3)[[d for _, d in labelled]]
    spread = x.std(0, ddof=1)  # the penalty is on standardised features
    beta, free = np.zeros((len(words), 3)), np.zeros(3)
    z = x / spread
    for _ in range(6000):
        p = np.exp(z @ beta + free)
        p /= p.sum(1, keepdims=True)
        beta -= 0.3 * (z.T @ (p - y) / len(y) + 0.01 * beta)
        free -= 0.3 * (p - y).mean(0)
    for t in asked:
        p = np.exp(features(t) / spread @ beta + free)
        assert np.abs(p / p.sum() - got[t]).max() < 0.03, t


def test_mined_rules_match_as_plain_subsets_do(spark):
    r = random.Random(3)
    hosts, parts, keys = ["shop", "news", "blog", "www"], ["buy", "win", "cheap", "read", "p7"], ["id", "ref", "q"]

    def url():
        return f"https://{r.choice(hosts)}.{r.choice(['a', 'b'])}.org/{r.choice(parts)}/{r.choice(parts)}?{r.choice(keys)}=1&{r.choice(keys)}=2"

    pages = [(i, url()) for i in range(900)] + [(900, None), (901, "no url"), (902, "https://shop.a.org")]
    bad = lambda u: "win" in u and "shop" in u
    marks = [(i, bad(u) if r.random() < 0.9 else r.random() < 0.3) for i, u in pages[:500]]
    df, labels = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(marks, "page_id long, blocked boolean")
    got = {x["page_id"]: x["verdict"] for x in url_filter.filter_urls(df, [], labels).collect()}

    def tokens(u):
        m = re.match(r"(.*?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", u or "")
        if not m or not m[2]:
            return set()
        named = [f"s:{m[1].lower()}", *(f"h:{x}" for x in m[2].lower().split(".") if x), *("p:" + re.sub("[0-9]+", "#", x) for x in m[3].split("/") if x)]
        return {*named, *("q:" + x.split("=")[0] for x in (m[4] or "").split("&") if x)}

    labelled = spark.createDataFrame([(sorted(tokens(dict(pages)[i])), b) for i, b in marks], "tokens array<string>, blocked boolean")
    rules = [set(x["rule_tokens"]) for x in url_filter.learn_rules(labelled, 0.005, 0.6).collect()]
    assert rules and {"p:win", "h:shop"} in rules
    assert got == {i: "block" if any(rule <= tokens(u) for rule in rules) else "allow" for i, u in pages}
    assert sum(v == "block" for v in got.values()) > 20
