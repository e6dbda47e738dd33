"""Candidate pools: eligible words, targets, distractors, layout and gloss rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexspan.functions import text as X
from lexspan.operators.scale import number_by_hash


def senses_by_lemma(synsets: DataFrame) -> DataFrame:
    """Lower-case lemma -> each sense naming it. Senses without a gloss are left out.

    `synsets`: pos, offset, words (array), gloss, examples (array).
    """
    named = synsets.filter(F.coalesce("gloss", F.lit("")) != "")
    return named.select(
        F.posexplode("words").alias("position", "lemma"),
        F.concat_ws(":", "pos", "offset").alias("sense_key"), "pos", "gloss", "examples",
    ).withColumn("lemma_lower", F.lower("lemma"))


def eligible_words(vocab: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Vocabulary words with at least one sense."""
    with_sense = lemmas.select(F.col("lemma_lower").alias("_l"))
    return vocab.join(with_sense, F.lower(vocab["word"]) == F.col("_l"), "left_semi")


def resolve_targets(wanted: DataFrame, eligible: DataFrame) -> DataFrame:
    """Pool spelling of each wanted target, null when it cannot be pooled.

    Several spellings of one lower case resolve to the first in string order.
    """
    spelling = eligible.groupBy(F.lower("word").alias("_l")).agg(F.min("word").alias("word"))
    names = wanted.select("target").distinct()
    return names.join(spelling, F.lower("target") == F.col("_l"), "left").select("target", "word")


def distractors(eligible: DataFrame, targets: DataFrame, seed: str, n: int | None = None) -> DataFrame:
    """Eligible words that are no targets: all, or the first n in seeded hash order."""
    rest = eligible.select("word").join(targets.select("word"), "word", "left_anti")
    return rest if n is None else rest.orderBy(X.hash_order(seed, F.col("word")), "word").limit(n)


def lay_out(targets: DataFrame, others: DataFrame, seed: str) -> DataFrame:
    """Pool words with a `row` in seeded hash order, so a row number says nothing about targets."""
    words = targets.select("word", F.lit(True).alias("is_target")).unionByName(
        others.select("word", F.lit(False).alias("is_target"))
    )
    return number_by_hash(words, X.hash_order(seed, F.col("word")), ["word"])


def layout_check(pool: DataFrame) -> DataFrame:
    """First and mean target row against the mean of an even spread."""
    row = F.when(F.col("is_target"), F.col("row"))
    return pool.agg(
        F.min(row).alias("first_target_row"), F.avg(row).alias("mean_target_row"),
        ((F.count("*") - 1) / 2).alias("even_row"), F.count("*").alias("pool_words"),
    )


def gloss_rows(pool: DataFrame, lemmas: DataFrame) -> DataFrame:
    """One row per pooled word and sense."""
    right = lemmas.select("lemma_lower", "sense_key", "gloss", "examples")
    return pool.join(right, F.lower(pool["word"]) == right["lemma_lower"]).drop("lemma_lower")


def sense_stats(pool: DataFrame, glosses: DataFrame) -> DataFrame:
    """Mean and largest number of senses per word, and the share of rows with examples."""
    per_word = glosses.groupBy("word").agg(
        F.count("*").alias("n"), F.count_if(F.size("examples") > 0).alias("shown")
    )
    totals = per_word.agg(
        F.sum("n").alias("gloss_rows"), F.max("n").alias("max_senses"), F.sum("shown").alias("with_examples"),
        F.min_by("word", F.struct(-F.col("n"), F.col("word"))).alias("max_senses_word"),
    )
    return totals.withColumn("pool_words", pool.agg(F.count("*")).scalar()).select(
        "pool_words", "gloss_rows", (F.col("gloss_rows") / F.col("pool_words")).alias("mean_senses"),
        "max_senses", "max_senses_word", "with_examples",
        (F.col("with_examples") / F.col("gloss_rows")).alias("example_share"),
    )


# Text variants of a cell.
VARIANTS = ["lemma", "gloss", "gloss_examples", "lemma_gloss"]


def cell_text(variant: Column, word: Column, gloss: Column, examples: Column) -> Column:
    """Text to index for one row of a cell."""
    return (
        F.when(variant == "lemma", word)
        .when((variant == "gloss_examples") & (F.size(examples) > 0),
              F.concat_ws("; ", gloss, F.array_join(examples, "; ")))
        .when(variant == "lemma_gloss", F.concat(word, F.lit(": "), gloss))
        .otherwise(gloss)
    )
