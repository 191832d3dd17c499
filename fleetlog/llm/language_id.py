"""Language ID by string kernels.

The kernel of two texts is the share of character n-grams (a blended spectrum of lengths) that both
hold, counted by presence: k(x, y) = |x ∩ y| / sqrt(|x| |y|). A bounded sample of labelled texts
gives Nyström landmarks; kernel ridge regression on their features is fitted one language against
the rest. Scoring is a product of a batch's presence bits, the landmarks' bits and the weights.

Presence bits of a long text would fill up and tell nothing, so a text is cut into equal pieces of at
most ``PIECE`` bytes, and its kernel is the mean of all its pieces', by their numbers of letters.

Defined cases: a null text or one without a letter is ``und`` with score 0; without labelled rows
every text is ``und``; with one language a text's lead is its margin itself; ties go to the first language in name order; repeated rows get the same
prediction; other columns pass through (``lang_pred``, ``score`` and ``lead`` are replaced). Whole
texts count, of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UND = "und"
PIECE, BLOCK = 2048, 128  # bytes of a piece; pieces scored together


@dataclass
class Model:
    """``bits``: presence of n-gram buckets in each landmark, a piece of a text; ``weights``: landmarks
    by languages; ``usual``: mean kernel of the learned texts and the landmarks."""

    langs: list[str]
    lengths: tuple[int, ...]
    bits: np.ndarray
    weights: np.ndarray
    sharpness: float
    usual: float


def pieces(text: str, lengths: tuple[int, ...], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Which buckets the n-grams of the lower-cased text's pieces fall into, and the pieces' letters (as
    bytes); at most ``BLOCK`` pieces at a time. An n-gram belongs to the piece that it starts in."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    step = max(1, -(-len(data) // max(1, -(-len(data) // PIECE))))
    shift = np.uint32(32 - (buckets - 1).bit_length())
    for low in range(0, max(1, len(data)), BLOCK * step):
        own = data[low : low + BLOCK * step]
        found = np.zeros((max(1, -(-len(own) // step)), buckets), bool)
        at = np.arange(len(own)) // step
        for n in lengths:
            part = data[low : low + len(own) + n - 1].astype(np.uint32)
            h = np.full(max(0, len(part) - n + 1), n, np.uint32)
            for j in range(n):
                h = (h ^ part[j : j + len(h)]) * np.uint32(0x9E3779B1)
            found[at[: len(h)], h >> shift] = True
        yield found, np.bincount(at, ((own >= 97) & (own <= 122)) | (own >= 128), minlength=len(found))


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of presence bits (float32): shared buckets over the root of both counts."""
    size = lambda x: np.sqrt(np.maximum(x.sum(1), 1))
    return (a @ b.T) / size(a)[:, None] / size(b)[None, :]


def likeness(texts: list[str], marks: np.ndarray, lengths: tuple[int, ...]) -> np.ndarray:
    """Kernels of texts and landmarks (float32 bits): the mean of each text's pieces by their letters."""
    total, letters = np.zeros((len(texts), len(marks))), np.zeros(len(texts))
    held, owner, size = [], [], 0

    def add() -> None:
        found, weight = (np.concatenate(x) for x in zip(*held))
        to, first = np.unique(np.repeat(owner, [len(x) for x, _ in held]), return_index=True)
        total[to] += np.add.reduceat(kernel(found.astype(np.float32), marks) * weight[:, None], first)
        letters[to] += np.add.reduceat(weight, first)

    for i, text in enumerate(texts):
        for part in pieces(text, lengths, marks.shape[1]):
            held.append(part)
            owner.append(i)
            size += len(part[1])
            if size >= BLOCK:
                add()
                held, owner, size = [], [], 0
    if held:
        add()
    return total / np.maximum(letters, 1)[:, None]


def fit(
    labelled: DataFrame,
    per_language: int = 400,
    landmarks: int = 128,
    lengths: tuple[int, ...] = (1, 2, 3, 4),
    buckets: int = 8192,
    ridge: float = 1e-2,
    sharpness: float = 8.0,
) -> Model:
    """From (text, lang). At most ``per_language`` texts of each language are learnt from, those
    with the smallest text hashes, so the sample has a documented bound at any size; all pieces of those
    texts count. The driver gets ``buckets`` bits of a piece of each and its kernels, not the texts."""
    usable = labelled.select("text", "lang").filter("lang IS NOT NULL AND text RLIKE '\\\\p{L}'")
    ranked = usable.withColumn("h", F.xxhash64("text"))
    counts = {r["lang"]: r["count"] for r in ranked.groupBy("lang").count().collect()}
    if not counts:
        return Model([], lengths, np.zeros((0, buckets), bool), np.zeros((0, 0)), sharpness, 1.0)
    # A hash threshold first, so that only about twice the sample is ranked.
    share = F.create_map(*(F.lit(x) for k, v in counts.items() for x in (k, min(1.0, 2 * per_language / v))))
    near = ranked.filter((F.pmod("h", F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000) | (share[F.col("lang")] >= 1.0))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = []
            for text, h in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                left = h % max(1, -(-len(text.encode("utf-8", "replace")) // PIECE))
                for found, _ in pieces(text, lengths, buckets):
                    piece = found[min(left, len(found) - 1)]
                    if left < len(found):
                        break
                    left -= len(found)
                packed.append(np.packbits(piece).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(packed, pa.binary())], ["lang", "h", "bits"])

    near = near.select("text", "lang", "h")
    rows = near.mapInArrow(bits, "lang string, h long, bits binary").distinct().collect()
    langs = sorted({r["lang"] for r in rows})
    chosen = {k: sorted((r["h"], bytes(r["bits"])) for r in rows if r["lang"] == k)[:per_language] for k in langs}
    each = max(1, landmarks // len(langs))
    held = np.array([np.unpackbits(np.frombuffer(b, np.uint8)) for k in langs for _, b in chosen[k][:each]], np.float32)
    wanted = {(k, h) for k in langs for h, _ in chosen[k]}

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, lang, h in zip(*(c.to_pylist() for c in b.columns)):
                if (lang, h) in wanted:
                    made = likeness([text], held, lengths).tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([h]), pa.array(made, pa.list_(pa.float64()))], ["lang", "h", "k"])

    rows = near.mapInArrow(kernels, "lang string, h long, k array<double>").dropDuplicates(["lang", "h"]).collect()
    rows.sort(key=lambda r: (r["lang"], r["h"]))
    y = np.array([langs.index(r["lang"]) for r in rows])
    inner, outer = kernel(held, held).astype(float), np.array([r["k"] for r in rows])
    values, vectors = np.linalg.eigh(inner)
    root = vectors / np.sqrt(np.maximum(values, 1e-6))  # Nyström: features are outer @ root
    z = outer @ root
    target = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    balance = (1 / np.bincount(y, minlength=len(langs)))[y][:, None]
    beta = np.linalg.solve((z * balance).T @ z + ridge / len(y) * np.eye(z.shape[1]), (z * balance).T @ target)
    return Model(langs, lengths, held.astype(bool), root @ beta, sharpness, float(outer.mean()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (softmax of the languages' margins) and ``lead``, the best
    margin less the second. Kernels of short texts are small, so the lead is taken at ``usual`` ones; it is
    about 2 for a text of one language and 0 for one between two, whatever the number of languages."""
    own = [c for c in docs.columns if c not in ("lang_pred", "score", "lead")]
    made = docs.select(*own)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lead", T.DoubleType())]
    schema = T.StructType([*made.schema.fields, *added])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}")
        marks = model.bits.astype(np.float32)
        for b in batches:
            texts, langs, scores, leads = b.column(own.index("text")).to_pylist(), [], [], []
            for at in range(0, len(texts), 128):
                part = texts[at : at + 128]
                known = [i for i, t in enumerate(part) if t and model.langs and letter.search(t)]
                lang, score, lead = [UND] * len(part), [0.0] * len(part), [0.0] * len(part)
                if known:
                    near = likeness([part[i] for i in known], marks, model.lengths)
                    margin = near @ model.weights
                    ahead = np.sort(np.c_[margin, np.zeros(len(known))] if len(model.langs) == 1 else margin, axis=1)
                    ahead = (ahead[:, -1] - ahead[:, -2]) * model.usual / np.maximum(near.mean(1), 1e-9)
                    p = np.exp(model.sharpness / 2 * (margin - margin.max(1, keepdims=True)))
                    p /= p.sum(1, keepdims=True)
                    for i, best, row, by in zip(known, margin.argmax(1), p, ahead):
                        lang[i], score[i], lead[i] = model.langs[best], float(row[best]), float(by)
                langs += lang
                scores += score
                leads += lead
            arrays = [b.column(i) for i in range(len(own))] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(leads, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in schema])

    return made.mapInArrow(scored, schema)


def held_out(doc_id: Column) -> Column:
    """True for documents never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))
