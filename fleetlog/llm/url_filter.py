"""URL filters: fixed host/path rules, then association rules mined from labelled URLs.

FP-growth finds combinations of URL tokens that go with the label ``block``. Rules of enough rows,
support and confidence, whose confidence is also clearly above the share of blocked rows (by its Wilson
lower bound), are matched through an inverted index on each rule's rarest token.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no fixed rule
and has no tokens, so it is allowed; without labelled rows no rules are learnt; repeated pages
get the same verdict each; other columns pass through (``host``, ``path``, ``rule`` and
``verdict`` are replaced); an empty table gives an empty result; all of a very long url counts.

The miner looks at all combinations of a row's frequent tokens. Tokens that the same labelled rows hold are one item to it, as
no rule can tell them apart there: a rule asks for one token of each of its items, which is what all rules of single
tokens would ask together. ``most_tokens`` can bound the model further, to the rarest items of a labelled row.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, hash_pair, stage

BLOCKED = "label=block"
MOST_TOKENS = 12  # items of a labelled row that ``learn_rules`` fits to, unless given
RULE = "rule_tokens array<string>, choices array<array<string>>, confidence double, support double"


def host_of(url: Column) -> Column:
    after = F.get(F.split(url, "://", 2), F.lit(1))
    return F.coalesce(F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    after = F.get(F.split(url, "://", 2), F.lit(1))
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest of ``rules`` (host, path, verdict) that fits, as struct(rule, verdict)."""
    if not rules:
        return F.lit(None).cast("struct<rule: string, verdict: string>")
    made = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    listed = F.array(
        *(F.struct(F.lit(h).alias("h"), F.lit(p).alias("p"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for h, p, v in made)
    )
    fits = lambda r: ((host == r["h"]) | host.endswith(F.concat(F.lit("."), r["h"]))) & path.startswith(r["p"])
    return F.get(F.filter(listed, fits), F.lit(0))


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host labels, path parts (digits as #), extension and query keys."""
    parts = lambda c, by: F.filter(F.split(c, by), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    tag = lambda name, c: F.transform(c, lambda x: F.concat(F.lit(name), x))
    return F.array_distinct(
        F.when(host == "", F.array().cast("array<string>")).otherwise(
            F.concat(
                tag("s:", F.array(F.lower(F.get(F.split(url, "://", 2), F.lit(0))))),
                tag("h:", parts(host, r"\.")),
                tag("p:", F.transform(parts(path, "/"), lambda x: F.regexp_replace(x, "[0-9]+", "#"))),
                tag("q:", F.transform(parts(query, "&"), lambda x: F.get(F.split(x, "="), F.lit(0)))),
            )
        )
    )


def wilson_low(share: Column, n: Column, z: float) -> Column:
    """Lower end of the Wilson interval of a share of ``n`` rows."""
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def token_items(rows: DataFrame, least: float) -> DataFrame:
    """(token, item, choices, count): tokens that ``least`` of the ``rows`` (row, tokens) hold. Those that the same rows
    hold (by 128 bits of hash) are one item, named by the first of them; ``choices`` are all of them."""
    a, b = hash_pair(F.col("row"))
    held = rows.select(F.explode(F.array_distinct("tokens")).alias("token"), a.alias("a"), b.alias("b")).filter("token IS NOT NULL")
    often = held.groupBy("token").agg(F.count("*").alias("count"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")).filter(F.col("count") >= least)
    # No more tokens come together here than one url holds.
    items = often.groupBy("count", "a", "b").agg(F.array_sort(F.collect_list("token")).alias("choices"))
    return items.select("count", "choices", F.get("choices", F.lit(0)).alias("item"), F.explode("choices").alias("token"))


def learn_rules(labelled: DataFrame, min_support: float, min_confidence: float, min_rows: int = 20, z: float = 2.33, most_tokens: int | None = MOST_TOKENS) -> DataFrame:
    """From ``labelled`` (tokens, blocked): rules (rule_tokens, choices, confidence, support); a row that has one token of
    each of the ``choices`` fits a rule, and ``rule_tokens`` are the first of each.

    A rule holds for ``min_rows`` blocked rows and ``min_support`` of all at least, and even the lower
    bound of its confidence (``z`` standard errors) is above the share of blocked rows.
    """
    spark = labelled.sparkSession
    rows = labelled.filter(F.size("tokens") > 0)
    n, bad = rows.agg(F.count("*"), F.count_if("blocked")).first()
    none = spark.createDataFrame([], RULE)
    if bad < min_rows:
        return none
    support = max(min_support, min_rows / n)
    # Rare tokens are in no rule; of the others, each row's rarest say most.
    rows = stage(rows.select(F.monotonically_increasing_id().alias("row"), "tokens", "blocked"), "url-rows")
    often = stage(token_items(rows, support * n), "url-tokens-often")
    listed = (
        rows.select("row", "blocked", F.explode("tokens").alias("token"))
        .join(often, "token")
        .groupBy("row", "blocked")
        .agg(F.array_sort(F.collect_set(F.struct("count", "item"))).alias("found"))
    )
    found = F.col("found") if most_tokens is None else F.slice("found", 1, most_tokens)
    listed = listed.select("blocked", found["item"].alias("tokens"))
    items = listed.select(F.when(F.col("blocked"), F.array_append("tokens", F.lit(BLOCKED))).otherwise(F.col("tokens")).alias("items"))
    # Rows without frequent tokens are left out of ``items``, so shares are counted from rows here.
    items = stage(items, "url-items")
    held = items.count()
    if not held:
        return none
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, support * n / held), minConfidence=min_confidence).fit(items)
    rules = model.associationRules.filter(F.array_contains("consequent", BLOCKED)).withColumn("seen", F.col("support") * held / F.col("confidence"))
    rules = rules.filter(wilson_low(F.col("confidence"), F.col("seen"), z) > bad / n)
    rules = stage(rules.select(F.array_sort("antecedent").alias("rule_tokens"), "confidence", (F.col("support") * held / n).alias("support")), "url-mined")
    asked = rules.select("rule_tokens", F.explode("rule_tokens").alias("item")).join(often.select("item", "choices").distinct(), "item")
    asked = asked.groupBy("rule_tokens").agg(F.array_sort(F.collect_list("choices")).alias("choices"))
    return stage(rules.join(asked, "rule_tokens").select("rule_tokens", "choices", "confidence", "support"), "url-rules")


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``u1``, ``u2`` of the ``pages`` (u1, u2, tokens) that hold one token of each of a rule's choices."""
    seen = pages.select(F.explode("tokens").alias("token")).groupBy("token").count()
    # A rule is posted at the choice that the fewest pages hold a token of.
    posted = (
        rules.select("choices", F.posexplode("choices").alias("at", "choice"))
        .select("choices", "at", F.explode("choice").alias("token"))
        .join(seen, "token")
        .groupBy("choices", "at")
        .agg(F.sum("count").alias("count"), F.collect_list("token").alias("posts"))
        .groupBy("choices")
        .agg(F.min_by("posts", F.struct("count", "at")).alias("posts"))
    )
    index = posted.select("choices", F.explode("posts").alias("token")).groupBy("token").agg(F.collect_list("choices").alias("posted"))
    return (
        pages.select("u1", "u2", "tokens", F.explode("tokens").alias("token"))
        .join(index, "token")
        .filter(F.exists("posted", lambda rule: F.forall(rule, lambda choice: F.arrays_overlap(choice, F.col("tokens")))))
        .select("u1", "u2")
        .distinct()
    )


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    labels: DataFrame | None = None,
    min_support: float = 0.005,
    min_confidence: float = 0.6,
    min_rows: int = 20,
    most_tokens: int | None = None,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``labels``: (page_id, blocked). ``min_support`` bounds the number of rules, and so does ``most_tokens``, if given.
    Urls are matched by 128 bits of hash. Pages that a fixed rule judges are learnt from as labelled, too;
    the rule's own verdict is not a label, as it would spread to all pages that look like those few.
    """
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", "url", F.struct(*own).alias("row"), host.alias("host"), path.alias("path")).withColumn(
        "fixed", fixed_rule(F.col("host"), F.col("path"), rules)
    )
    # Rows of one url share tokens and fate: the method runs on distinct urls.
    urls = judged.select("url", "host", "path", "fixed").distinct()
    uid = dict(zip(("u1", "u2"), hash_pair(F.col("url"))))
    urls = urls.select(*(h.alias(c) for c, h in uid.items()), url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    if labels is None:
        mined = judged.sparkSession.createDataFrame([], RULE)
    else:
        marks = labels.groupBy("page_id").agg(F.max("blocked").alias("blocked")).filter("blocked IS NOT NULL")
        labelled = judged.join(marks, "page_id").select(
            url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), "blocked"
        )
        mined = learn_rules(stage(labelled, "url-labelled"), min_support, min_confidence, min_rows, most_tokens=most_tokens)
    hits = match_rules(stage(urls, "url-tokens"), mined).withColumn("hit", F.lit(True))
    return (
        judged.withColumns(uid)
        .join(hits, list(uid), "left")
        .select(
            "row.*",
            "host",
            "path",
            F.col("fixed.rule").alias("rule"),
            F.coalesce(F.col("fixed.verdict"), F.when(F.col("hit"), F.lit("block")), F.lit("allow")).alias("verdict"),
        )
    )
