"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexspan.session import ensure_checkpoint_dir

# What separates words in every contract of this subpackage.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its DuckDB text."""
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared checkpoint folder and read them back.

    Later steps then start from files that every executor can read, not from a lineage
    that a lost executor would make Spark run again.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def learn_fold(doc_id: Column) -> Column:
    """True for rows that a model may learn from: crc32 of the id as text, mod 3, is not 1.

    A null id hashes as the empty text.
    """
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 != 1


def sample_rows(df: DataFrame, key: Column, limit: int) -> DataFrame:
    """At most `limit` rows, those with the smallest hash of `key`. Keep the rows narrow."""
    return df.withColumn("_h", F.xxhash64(key)).orderBy("_h", *df.columns).limit(limit).drop("_h")


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """doc_id, label, text of at most `max_rows` labelled documents outside the held-out fold."""
    wanted = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & learn_fold(F.col("doc_id")))
    wanted = sample_rows(wanted.select("doc_id", F.col("quality").cast("int").alias("label")).distinct(), F.col("doc_id"), max_rows)
    # At most `max_rows` pairs of numbers: a proven bound for the broadcast.
    return docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
