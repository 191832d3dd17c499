"""A corpus pipeline: language ID, line dedup, near-duplicate removal, mixing and packing.

Each stage takes (spark, docs, sf_dir) and gives the documents it keeps, with their columns; the last
gives packed pieces.

Defined cases: texts that are null or have no letter go in the first stage; rows with a null doc_id stay,
as they are no one's copy; repeated rows go on as they are; other columns go along, whatever their names;
very long texts count whole; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlog.llm import language_id, line_dedup, mixing, ngram_join, packing
from fleetlog.llm._common import stage, table
from fleetlog.llm.queries import MIX_WEIGHTS, tokenizer_file
from fleetlog.storage import STAGED, remove_staged

#: Texts whose best language is less ahead of the second than this (of about 2) have no clear language.
MIN_LANGUAGE_LEAD = 0.0625


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or without a clear language."""
    model = language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id"))))
    seen = language_id.predict(docs, model)
    clear = (F.col("lang_pred") != language_id.UND) & (F.col("lead") >= MIN_LANGUAGE_LEAD)
    return seen.filter(clear).select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(docs, min_docs=3, min_chars=20)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies."""
    found = ngram_join.jaccard_join(docs.select("doc_id", "text"), percent=75)
    return docs.join(found.filter("component_id < doc_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents by their fitted rates."""
    mixed = mixing.mix(docs, table(spark, sf_dir, "labels"), MIX_WEIGHTS)
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), end_id=1, size=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_shared_lines),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_domains),
    ("packing", pack_windows),
]

#: Classifiers and tokenizers can't be stated in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, first = table(spark, sf_dir, "documents"), len(STAGED)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        remove_staged(spark, first, keep=(STAGED[-1],))  # what led to it isn't read any more
    return STAGES[-1][1](spark, docs, sf_dir)
