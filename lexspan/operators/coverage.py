"""Lexicon coverage of a vocabulary by part of speech."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lexspan.functions import text as X
from lexspan.functions.decisions import pos_skew_verdict

HAS_DIGIT = "[0-9]"


def mark_present(lemmas: DataFrame, vocab: DataFrame) -> DataFrame:
    """`lemmas` (pos, lemma) with `present`: in the vocabulary in any case."""
    known = vocab.select(F.lower("word").alias("_l")).distinct().withColumn("_in", F.lit(True))
    joined = lemmas.join(known, F.lower(lemmas["lemma"]) == F.col("_l"), "left")
    return joined.withColumn("present", F.coalesce("_in", F.lit(False))).drop("_l", "_in")


def _rates(marked: DataFrame) -> list:
    return [
        F.count("*").alias("lemmas"), F.count_if("present").alias("present"),
        F.count_if(~F.col("present")).alias("missing"),
        (F.count_if("present") / F.count("*")).alias("rate"),
    ]


def presence_by_pos(lemmas: DataFrame, vocab: DataFrame) -> DataFrame:
    """Presence per part of speech and, as `ALL`, over the distinct lemmas."""
    marked = mark_present(lemmas, vocab)
    union = marked.select("lemma", "present").distinct()
    by_pos = marked.groupBy("pos").agg(*_rates(marked))
    return by_pos.unionByName(union.agg(*_rates(union)).withColumn("pos", F.lit("ALL")))


def unlisted_words(lemmas: DataFrame, vocab: DataFrame) -> DataFrame:
    """Lower-case vocabulary words that no index lists."""
    listed = lemmas.select(F.lower("lemma").alias("word"))
    return vocab.select(F.lower("word").alias("word")).distinct().join(listed, "word", "left_anti")


def presence_without_digits(lemmas: DataFrame, vocab: DataFrame) -> DataFrame:
    marked = mark_present(lemmas.filter(~F.col("lemma").rlike(HAS_DIGIT)), vocab)
    return marked.groupBy("pos").agg(*_rates(marked))


def missing_samples(lemmas: DataFrame, vocab: DataFrame, n: int = 30) -> DataFrame:
    """First n missing single words per part of speech, in string order."""
    missing = mark_present(lemmas, vocab).filter(~F.col("present") & ~F.contains("lemma", F.lit(" ")))
    place = F.row_number().over(W.partitionBy("pos").orderBy("lemma"))
    return missing.withColumn("place", place).filter(F.col("place") <= n).select("pos", "place", "lemma")


def derived_without_base(lemmas: DataFrame, vocab: DataFrame) -> DataFrame:
    """Indexed derived forms whose base verb is missing; the first matching rule names the base."""
    missing = mark_present(lemmas, vocab).filter(
        (F.col("pos") == "verb") & ~F.col("present") & ~F.contains("lemma", F.lit(" "))
    ).select(F.col("lemma").alias("base")).distinct()
    words = vocab.select(F.lower("word").alias("derived")).distinct().filter(~F.contains("derived", F.lit(" ")))
    tries = F.filter(
        F.array(*[
            F.when(
                F.endswith("derived", F.lit(suffix)) & (F.length("derived") > strip + 2),
                F.struct(
                    F.lit(order).alias("rule"),
                    F.concat(F.substring(F.col("derived"), F.lit(1), F.length("derived") - strip), F.lit(add)).alias("base"),
                ),
            )
            for order, (suffix, strip, add) in enumerate(X.DERIVATIONS)
        ]),
        lambda t: t.isNotNull(),
    )
    candidates = words.select("derived", F.explode(tries).alias("t")).select("derived", "t.rule", "t.base")
    return candidates.join(missing, "base").groupBy("derived").agg(F.min_by("base", "rule").alias("base"))


def orphans(lemmas: DataFrame, synset_words: DataFrame, vocab: DataFrame) -> DataFrame:
    """Missing lemmas without a digit, by part of speech: covered by a synset mate or orphaned.

    `synset_words`: pos, sense_key, lemma.
    """
    missing = mark_present(lemmas.filter(~F.col("lemma").rlike(HAS_DIGIT)), vocab).filter(~F.col("present"))
    missing = missing.select("pos", "lemma").distinct()
    marked = mark_present(synset_words, vocab)
    alive = marked.filter("present").select("sense_key").distinct()
    covered = synset_words.join(alive, "sense_key", "left_semi").select("pos", "lemma").distinct()
    joined = missing.join(covered.withColumn("_c", F.lit(True)), ["pos", "lemma"], "left")
    return joined.groupBy("pos").agg(
        F.count("*").alias("missing"), F.count("_c").alias("covered"),
        F.count_if(F.col("_c").isNull()).alias("orphaned"), (F.count("_c") / F.count("*")).alias("covered_share"),
    )


def skew(lemmas: DataFrame, vocab: DataFrame) -> DataFrame:
    """Noun and verb presence and the verdict on their difference."""
    rates = presence_by_pos(lemmas, vocab).agg(
        F.max(F.when(F.col("pos") == "noun", F.col("rate"))).alias("noun_rate"),
        F.max(F.when(F.col("pos") == "verb", F.col("rate"))).alias("verb_rate"),
    )
    return rates.withColumn("verdict", pos_skew_verdict(F.col("noun_rate"), F.col("verb_rate")))
