"""Zipf frequencies of lemmas."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexspan.functions import bands as B


def zipf_table(counts: DataFrame) -> DataFrame:
    """Zipf of each counted word. A word listed twice keeps its larger count for the scale."""
    total = counts.agg(F.sum("n")).scalar()
    words = counts.groupBy("word").agg(F.max("n").alias("n"))
    return words.select("word", B.zipf_of(F.col("n"), total).alias("zipf"))


def lemma_zipf(lemmas: DataFrame, table: DataFrame) -> DataFrame:
    """Smallest Zipf of a lemma's tokens, null when any token is unknown. `lemmas`: word."""
    tokens = F.filter(F.split(F.lower("word"), "[ _-]+"), lambda t: t != "")
    parts = lemmas.select("word", F.explode_outer(tokens).alias("token"))
    joined = parts.join(table.select(F.col("word").alias("token"), "zipf"), "token", "left")
    known = F.count("zipf") == F.count("*")
    return joined.groupBy("word").agg(F.when(known, F.min("zipf")).alias("zipf"))


def band_distribution(lemmas: DataFrame) -> DataFrame:
    """Words per band; a missing Zipf counts as rare. `lemmas`: word, zipf."""
    rows = lemmas.groupBy(B.band(F.col("zipf")).alias("band")).agg(F.count("*").alias("n"))
    return rows.select("band", "n", (F.col("n") / lemmas.agg(F.count("*")).scalar()).alias("share"))


def override_zipf(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Replace each row's Zipf by the table's value for its target, keeping the old one when absent."""
    new = table.select(F.col("word").alias("_w"), F.col("zipf").alias("_z"))
    joined = rows.join(new, F.lower(rows["target"]) == F.col("_w"), "left")
    return joined.withColumn("zipf", F.coalesce("_z", "zipf")).drop("_w", "_z")
