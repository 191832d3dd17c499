"""Spelling variants of words, found by pivotal grams.

Two words are near if one inserted, deleted or replaced code point leads from one to the other. A word's
bigrams are ranked by how rare they are; its *prefix* is its three rarest, and its
*pivots* are two bigrams of the prefix that share no letter, chosen by dynamic programming for the least frequency. One
edit spoils one of two disjoint bigrams at most, so of two near words, the one whose prefix ends at the rarer
bigram has a pivot in the other's prefix. Its position there is limited: an edit behind the first pivot leaves all up to it as
it was, any other edit leaves all from the second one on. Of what the edit is in, it leaves the first or
the second half. So a prefix bigram is indexed with the word's length and these parts, the pivots ask for the three lengths of
near words, and what meets is verified.

A bigram as rare as the prefix's last may occur many times. An edit brings two more of them before a pivot at most, so
if pivots are among the first three of that rank, index entries of the first five hold them.

Bigrams fall into 65,536 buckets (exact for Latin-1), so their frequencies are a small table whatever the
words. Index entries that very many words share are dealt over parts, each asked by all pivots.

Defined cases: null texts have no words; runs of a null doc_id keep all letters; null words are left out; words of fewer than four code points
have no near words; words are given once each with their count (``count_words`` adds repeated ones up); ties go to the word first in
code-point order; texts and words count whole, of any length; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, stage

#: Letters of a run, once A-Z are lower-cased; a fixed value.
RUN = "[a-zÀ-ÿ]+"
BUCKETS = 1 << 16
SHORTEST = 4  # code points of a word that has three bigrams
LEVEL = 3  # bigrams of the prefix's last rank among which pivots are chosen
HOT = 2048  # words of an index entry that are kept together
KEYS = pa.schema(
    [("word", pa.string()), ("n", pa.int64()), ("last", pa.int32()), ("letters", pa.int64()), ("prefix", pa.list_(pa.int64())), ("pivots", pa.list_(pa.int64()))]
)


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, run): every run of letters of every text, A-Z lower-cased."""
    found = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(RUN), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run"))


def dropped_letters(found: DataFrame, one_in: int) -> DataFrame:
    """The word of each run: where a checksum of doc_id and run is a multiple of ``one_in``, it lacks one letter, which the checksum chooses."""
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    lacking = F.concat(F.left("run", at), F.substring(F.col("run"), at + 2, F.length("run")))
    return found.select("run", h.alias("h")).select(F.when(F.col("h") % one_in == 0, lacking).otherwise(F.col("run")).alias("word"))


def count_words(words: DataFrame) -> DataFrame:
    return words.filter("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n"))


def letter_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, and where each word ends."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64), np.cumsum([len(w) for w in words], dtype=np.int64)


def bigrams(codes: np.ndarray) -> np.ndarray:
    return (codes[:-1] * 256 + codes[1:]) % BUCKETS


def bigram_counts(words: DataFrame) -> np.ndarray:
    """How many times the words hold the bigrams of each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            codes, ends = letter_codes(b.column(0).to_pylist())
            inside = np.ones(max(0, len(codes) - 1), bool)
            inside[ends[:-1] - 1] = False  # no bigram spans two words
            total += np.bincount(bigrams(codes)[inside], minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": seen, "n": total[seen]})

    made = words.select("word").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(BUCKETS, np.int64)
    for bucket, n in made.collect():  # 65,536 rows at most
        total[bucket] = n
    return total


def disjoint_pair(at: list[int], cost: list[int]) -> tuple[int, int]:
    """The two of the bigrams at ``at`` (ascending) that share no letter and cost least together.

    For each bigram as the second, the cheapest first one that ends before it is known from the bigrams passed.
    """
    best, cheapest, passed = None, None, 0
    for j in range(len(at)):
        while at[passed] <= at[j] - 2:
            if cheapest is None or cost[passed] < cost[cheapest]:
                cheapest = passed
            passed += 1
        if cheapest is not None and (best is None or cost[cheapest] + cost[j] < best[0]):
            best = cost[cheapest] + cost[j], at[cheapest], at[j]
    return best[1:]


def entry(side: str, length: int, *parts: str) -> int:
    """An index entry: a word of this length has these parts."""
    return xxhash.xxh3_64_intdigest(f"{side}{length} {' '.join(parts)}") - (1 << 63)


def up_to(word: str, p: int, length: int) -> list[int]:
    """Entries of a word of ``length`` that is ``word`` up to the bigram at p, and has one half of what ``word`` has behind it."""
    left = length - p - 2
    half = (left + 1) // 2
    if left < 0 or p + 2 + half > len(word):
        return []
    return [entry("<", length, word[: p + 2 + half]), entry("<>", length, word[: p + 2], word[len(word) - left + half :])]


def down_to(word: str, p: int, length: int) -> list[int]:
    """Entries of a word of ``length`` that is ``word`` from the bigram at p on, and has one half of what is before it."""
    left = length - (len(word) - p)
    half = (left + 1) // 2
    if left < 0 or half > p:
        return []
    return [entry(">", length, word[p - half :]), entry("><", length, word[: left - half], word[p:])]


def keys_of(word: str, rank: list[int], cost: list[int]) -> tuple[int, list[int], list[int]]:
    """The rank at which a word's prefix ends, its index entries, and the entries that its pivots ask for."""
    own, size = [(ord(a) * 256 + ord(b)) % BUCKETS for a, b in zip(word, word[1:])], len(word)
    ranks = [rank[g] for g in own]
    last = heapq.nsmallest(3, ranks)[2]
    rarer = [p for p, r in enumerate(ranks) if r < last]
    level = list(itertools.islice((p for p, r in enumerate(ranks) if r == last), LEVEL + 2))
    entries = {x for p in rarer + level for x in (*up_to(word, p, size), *down_to(word, p, size))}
    prefix = sorted(rarer + level[:LEVEL])
    first, second = disjoint_pair(prefix, [cost[own[p]] for p in prefix])
    asked = {x for n in (size - 1, size, size + 1) for x in (*up_to(word, first, n), *down_to(word, second, n))}
    return last, list(entries), list(asked)


def with_keys(words: DataFrame, counts: np.ndarray) -> DataFrame:
    """Each word with the end of its prefix, a mask of its letters, its index entries and what its pivots ask for."""
    rank, cost = np.argsort(np.argsort(counts, kind="stable"), kind="stable").tolist(), counts.tolist()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            made = [keys_of(w, rank, cost) for w in names]
            masks = [functools.reduce(operator.or_, (1 << (ord(c) % 63) for c in set(w))) for w in names]
            last, prefix, pivots = ([x[i] for x in made] for i in range(3))
            columns = [b.column(0).cast(pa.string()), b.column(1), *(pa.array(c, k.type) for c, k in zip((last, masks, prefix, pivots), list(KEYS)[2:]))]
            yield pa.RecordBatch.from_arrays(columns, schema=KEYS)

    return words.select("word", F.col("n").cast("long").alias("n")).mapInArrow(make, "word string, n long, last int, letters long, prefix array<long>, pivots array<long>")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b) for all near words of ``words`` (word, n), each pair once; both have four code points at least."""
    words = words.filter(F.length("word") >= SHORTEST)
    keyed = stage(with_keys(words, bigram_counts(words)), "spelling-keys")
    own = ["word", "n", "last", "letters"]
    entries = keyed.select(*own, F.explode("prefix").alias("place"))
    asked = keyed.select(*own, F.explode("pivots").alias("place"))
    hot = entries.groupBy("place").agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts")).filter("parts > 1")
    hot = stage(hot, "spelling-hot")  # its size is known before it is joined
    parts = F.coalesce("parts", F.lit(1))
    entries = entries.join(hot, "place", "left").withColumn("part", F.pmod(F.xxhash64("word"), parts).cast("int"))
    asked = asked.join(hot, "place", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    e, a = entries.drop("parts").alias("e"), asked.drop("parts").alias("a")
    ends_first = (F.col("a.last") < F.col("e.last")) | ((F.col("a.last") == F.col("e.last")) & (F.col("a.word") < F.col("e.word")))
    alike = F.bit_count(F.col("a.letters").bitwiseXOR(F.col("e.letters"))) <= 2
    met = a.join(e, (F.col("a.place") == F.col("e.place")) & (F.col("a.part") == F.col("e.part")) & ends_first & alike)
    near = met.filter(F.levenshtein("a.word", "e.word", 1) == 1)
    return near.select(F.col("a.word").alias("a"), F.col("a.n").alias("n_a"), F.col("e.word").alias("b"), F.col("e.n").alias("n_b")).distinct()


def roots(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """(word, root) for ``forms`` (word, form): the last word that is reached. A round doubles the steps taken."""
    at = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(rounds):
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = stage(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if at.filter("moved").isEmpty():
            return at.drop("moved")
        at = at.drop("moved")
    raise ValueError("forms go round in a circle")


def group_variants(words: DataFrame, times: int = 2) -> DataFrame:
    """Each of ``words`` (word, n) with its form, the near word of largest n if that is at least ``times`` its own
    n, and its root, which following forms leads to: word, form, root, n, n_near, form_n."""
    words = stage(words.filter("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")).union(pairs.select("b", "a", "n_a"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    form_n = -F.col("best.m")
    formed = F.coalesce(form_n >= times * F.col("n"), F.lit(False))
    made = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, form_n).alias("form_n")
    )
    made = stage(made, "spelling-forms")
    found = roots(made.filter("form IS NOT NULL"))
    return made.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
