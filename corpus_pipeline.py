"""From raw documents to token ids: five stages, each written before the next one reads it.

Every stage works on all rows that the one before kept, and all but the last return the
columns of `documents`. Extra input columns are carried along, except by the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexspan.llm import bag_minhash, language_id, mixing, pieces, pii
from lexspan.llm.common import landed, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; `lang` becomes the predicted language."""
    return language_id.keep_known(docs, language_id.learn(docs.select("doc_id", "text", "lang")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return bag_minhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data masked; `n_chars` follows the text."""
    masked = pii.redact(docs, pii.learn(docs.select("doc_id", "text")))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often and as long as it takes them."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids of every use of a document."""
    encoded = pieces.encode(docs.select("doc_id", "lang", "source", "text"), pieces.load())
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language), ("near_dedup", near_dedup), ("pii", personal_data), ("mixing", mixed_sources), ("pieces", token_ids),
]

# Language profiles, boosted trees and keyed merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
