"""Saved words, collections and word profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexspan.functions import text as X


def saved_set(actions: DataFrame) -> DataFrame:
    """Words saved now: one row per user and word whose latest action is a save.

    `saved_at` is the first save since the word was last unsaved.
    """
    key = ["user_id", "word_id"]
    at = F.struct("ts", "id")
    gone = actions.filter("action = 'unsave'").groupBy(*key).agg(F.max(at).alias("gone"))
    kept = actions.filter("action = 'save'").join(gone, key, "left").filter(
        F.col("gone").isNull() | (at > F.col("gone")))
    return kept.groupBy(*key).agg(F.min("ts").alias("saved_at"))


def collection(saved: DataFrame, profiles: DataFrame, user_id: int | None = None) -> DataFrame:
    """Saved words with their profile, newest first."""
    mine = saved if user_id is None else saved.filter(F.col("user_id") == user_id)
    words = profiles.select(F.col("id").alias("word_id"), "word", "part_of_speech", "definition")
    return mine.join(words, "word_id").select(
        "user_id", "word_id", "word", "part_of_speech", "definition", "saved_at"
    ).orderBy(F.desc("saved_at"), "word_id")


def collection_sizes(saved: DataFrame) -> DataFrame:
    return saved.groupBy("user_id").agg(F.count("*").alias("saved"))


def is_saved(asked: DataFrame, saved: DataFrame) -> DataFrame:
    """`asked`: user_id, word_id."""
    have = saved.select("user_id", "word_id", F.lit(True).alias("_s"))
    return asked.join(have, ["user_id", "word_id"], "left").select(
        "user_id", "word_id", F.coalesce("_s", F.lit(False)).alias("saved"))


def resolve_profiles(slugs: DataFrame, profiles: DataFrame, vocab: DataFrame) -> DataFrame:
    """Stored profile, else an empty profile for a vocabulary word, else not found.

    `slugs`: slug as asked. Matching is on the normalised slug, exactly.
    """
    asked = slugs.select("slug", X.slug(F.col("slug")).alias("word"))
    stored = profiles.select("word", "part_of_speech", "definition", F.lit(True).alias("_stored"))
    known = vocab.select("word").distinct().withColumn("_known", F.lit(True))
    rows = asked.join(stored, "word", "left").join(known, "word", "left")
    outcome = F.when(F.col("_stored"), "stored").when(F.col("_known"), "created").otherwise("not found")
    found = outcome != "not found"

    def filled(name: str):
        return F.when(found, F.coalesce(name, F.lit(""))).alias(name)

    return rows.select("slug", "word", outcome.alias("outcome"), filled("part_of_speech"), filled("definition"))


def new_profiles(resolved: DataFrame) -> DataFrame:
    """Rows to append to the profiles: one per created word, defaults filled in."""
    empty = F.array().cast("array<string>")
    return resolved.filter("outcome = 'created'").select("word").distinct().select(
        "word", F.lit("").alias("part_of_speech"), F.lit("").alias("pronunciation"), F.lit("").alias("definition"),
        F.lit("").alias("etymology"), empty.alias("examples"), empty.alias("synonyms"), F.lit("").alias("domain"),
        F.lit(50).alias("obscurity_score"))


def sitemap(profiles: DataFrame, site_url: str) -> DataFrame:
    """Root entry, then one entry per word; order by `position`, newest word first on equal."""
    base = site_url.rstrip("/")
    spark = profiles.sparkSession
    root = spark.range(1).select(
        F.lit(base).alias("url"), F.current_timestamp().alias("last_modified"),
        F.lit("daily").alias("change_frequency"), F.lit(1.0).alias("priority"), F.lit(0).alias("position"))
    words = profiles.select(
        F.concat(F.lit(f"{base}/word/"), X.url_component(F.col("word"))).alias("url"),
        F.col("created_at").cast("timestamp").alias("last_modified"), F.lit("monthly").alias("change_frequency"),
        F.lit(0.8).alias("priority"), F.lit(1).alias("position"))
    return root.unionByName(words).orderBy("position", F.desc("last_modified"), "url")


def random_words(profiles: DataFrame, n: int, seed: str) -> DataFrame:
    """n distinct words in seeded hash order; all of them when there are fewer."""
    return profiles.select("id", "word").distinct().orderBy(X.hash_order(seed, F.col("id")), "id").limit(n)
