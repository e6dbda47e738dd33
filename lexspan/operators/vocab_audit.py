"""Audits of the vocabulary and of the rows behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lexspan.functions import text as X
from lexspan.operators.ranks import echo_rate
from lexspan.operators.scale import counts_in_span, micros

# Category pairs whose overlap is reported.
OVERLAPS = [
    ("multiword", "capitalised"), ("multiword", "digit"), ("capitalised", "digit"),
    ("multiword", "hyphen"), ("capitalised", "other_punct"),
]

# Candidate filters, from careful to aggressive.
FILTERS = ["A. proper nouns only", "B. proper nouns + digits + odd punctuation",
           "C. B + all multi-word", "D. keep only ^[a-z]+$"]

SAMPLES_PER_CATEGORY = 200
SAVE_SPAN_US = 5 * 60 * 1_000_000


def with_collision(vocab: DataFrame) -> DataFrame:
    """Vocabulary with `collides`: another row has the same lower case.

    Only colliding spellings travel to the join, not a count for each word.
    """
    twice = collisions(vocab).select(F.col("lower_word").alias("_l"), F.lit(True).alias("_c"))
    joined = vocab.join(twice, F.lower(vocab["word"]) == F.col("_l"), "left")
    return joined.withColumn("collides", F.coalesce("_c", F.lit(False))).drop("_l", "_c")


def collisions(vocab: DataFrame) -> DataFrame:
    return vocab.groupBy(F.lower("word").alias("lower_word")).agg(F.count("*").alias("n")).filter("n > 1")


def _unpivot(row: DataFrame, names: list[str], key: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias(key), F.col(f"`{n}`").alias("n")) for n in names]))
    return row.select("total", pairs.alias("p")).select(f"p.{key}", "p.n", "total")


def category_counts(vocab: DataFrame) -> DataFrame:
    """All category counts in one pass, as rows."""
    marked = with_collision(vocab)
    cats = X.categories(F.col("word"), F.col("collides"))
    row = marked.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in cats.items()])
    return _unpivot(row, list(cats), "category").withColumn("share", F.col("n") / F.col("total"))


def overlap_counts(vocab: DataFrame) -> DataFrame:
    cats = X.categories(F.col("word"), F.lit(False))
    names = [f"{a} & {b}" for a, b in OVERLAPS]
    row = vocab.agg(
        F.count("*").alias("total"),
        *[F.count_if(cats[a] & cats[b]).alias(n) for n, (a, b) in zip(names, OVERLAPS)],
    )
    return _unpivot(row, names, "pair")


def filter_costs(vocab: DataFrame) -> DataFrame:
    """Words removed and kept by each candidate filter."""
    word = F.col("word")
    cats = X.categories(word, F.lit(False))
    drops = [cats["capitalised"], X.junk(word), X.junk(word) | cats["multiword"], ~cats["clean_single"]]
    row = vocab.agg(F.count("*").alias("total"), *[F.count_if(d).alias(n) for n, d in zip(FILTERS, drops)])
    return _unpivot(row, FILTERS, "filter").select(
        "filter", F.col("n").alias("removed"), (F.col("total") - F.col("n")).alias("kept")
    )


def capital_costs(vocab: DataFrame) -> DataFrame:
    """Capitalised words with a lower-case twin, and without one by word count."""
    caps = vocab.filter(F.col("word").rlike("^[A-Z]")).select("word")
    twins = vocab.select(F.col("word").alias("_u")).distinct().withColumn("_t", F.lit(True))
    marked = caps.join(twins, F.lower("word") == F.col("_u"), "left")
    twin = F.coalesce("_t", F.lit(False)) & (F.coalesce("_u", F.lit("")) != F.col("word"))
    multi = F.col("word").rlike("[ _]")
    return marked.agg(
        F.count_if(twin).alias("with_twin"), F.count_if(~twin & ~multi).alias("single_no_twin"),
        F.count_if(~twin & multi).alias("multi_no_twin"),
    )


def category_samples(vocab: DataFrame, n: int = SAMPLES_PER_CATEGORY) -> DataFrame:
    """n words per category in md5 order."""
    marked = with_collision(vocab)
    cats = X.categories(F.col("word"), F.col("collides"))
    named = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in cats.items()]), lambda c: c.isNotNull())
    rows = marked.select("word", F.explode(named).alias("category"))
    place = F.row_number().over(W.partitionBy("category").orderBy(F.md5("word"), "word"))
    return rows.withColumn("place", place).filter(F.col("place") <= n)


def pollution(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Junk and echo among the first ten results, per query."""
    stems = queries.select("qid", X.query_stems(F.col("query")).alias("_s"))
    top = hits.filter("rank <= 10").join(stems, "qid")
    return top.groupBy("qid").agg(
        F.count("*").alias("results"), F.count_if(X.junk(F.col("word"))).alias("junk"),
        F.count_if(X.echoes_stems(F.col("word"), F.col("_s"))).alias("echo"),
    )


def reachability(hits: DataFrame, queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """Is the wanted answer missing from the vocabulary, missing from the top ten, or ranked?"""
    wanted = queries.select("qid", F.col("target").alias("answer"), F.lower("target").alias("_t"))
    found = hits.filter("rank <= 10").select("qid", F.lower("word").alias("_t"), "rank")
    ranked = wanted.join(found, ["qid", "_t"], "left").groupBy("qid", "answer", "_t").agg(F.min("rank").alias("rank"))
    known = vocab.select(F.lower("word").alias("_t")).distinct().withColumn("_in", F.lit(1))
    joined = ranked.join(known, "_t", "left")
    status = (
        F.when(F.col("_in").isNull(), "not in vocab").when(F.col("rank").isNull(), "not in top-10")
        .otherwise("retrieved")
    )
    return joined.select("qid", "answer", "rank", status.alias("status"))


def saves_after_lookup(saves: DataFrame, lookups: DataFrame, span_us: int = SAVE_SPAN_US) -> DataFrame:
    """For each save, the lookups of the same user in (t - span, t]; no pair is built."""
    events = lookups.select("user_id", micros(F.col("ts")).alias("at"))
    probes = saves.select("user_id", micros(F.col("ts")).alias("at"), F.col("id").alias("probe"))
    return counts_in_span(events, probes, ["user_id"], span_us, 3600 * 1_000_000, "lookups")


def joinable_pairs(saves: DataFrame, lookups: DataFrame, span_us: int = SAVE_SPAN_US) -> DataFrame:
    """Totals: lookups, saves, and save-lookup pairs within the span."""
    per_save = saves_after_lookup(saves, lookups, span_us).agg(
        F.count("*").alias("saves"), F.coalesce(F.sum("lookups"), F.lit(0)).cast("long").alias("pairs")
    )
    return per_save.withColumn("lookups", lookups.agg(F.count("*")).scalar())


def games_played(rounds: DataFrame) -> DataFrame:
    return rounds.groupBy("game").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "game")


def definition_yield(profiles: DataFrame, vocab: DataFrame) -> DataFrame:
    """How many profiles could serve as gloss queries, condition by condition, in one pass."""
    known = vocab.select(F.lower("word").alias("_v")).distinct().withColumn("_in", F.lit(True))
    rows = profiles.join(known, F.lower(profiles["word"]) == F.col("_v"), "left")
    has = F.col("definition") != ""
    long = has & (X.word_count(F.col("definition")) >= 3)
    inside = F.coalesce("_in", F.lit(False))
    usable = long & ~X.mentions_word(F.col("definition"), F.col("word")) & inside
    return rows.agg(
        F.count("*").alias("total"), F.count_if(has).alias("with_def"), F.count_if(long).alias("def_3plus_words"),
        F.count_if(inside).alias("in_vocab"), F.count_if(usable).alias("usable"),
    )


def membership(probes: DataFrame, vocab: DataFrame) -> DataFrame:
    """Exact-spelling membership of each probe word."""
    known = vocab.select("word").distinct().withColumn("_in", F.lit(True))
    return probes.join(known, "word", "left").select("word", F.coalesce("_in", F.lit(False)).alias("hit"))


def vocabulary_shape(vocab: DataFrame) -> DataFrame:
    shape = vocab.agg(
        F.count_if(F.contains("word", F.lit(" "))).alias("multiword"),
        F.count_if(F.col("word").rlike("^[A-Z]")).alias("capitalised"),
    )
    return shape.withColumn("lower_collisions", collisions(vocab).agg(F.count("*")).scalar())


def saved_words(saves: DataFrame, profiles: DataFrame) -> DataFrame:
    """Saved words with a flag for an empty definition. `saves`: word_id of a profile."""
    words = profiles.select(F.col("id").alias("word_id"), "word", (F.col("definition") == "").alias("definition_empty"))
    return saves.join(words, "word_id").select("word", "definition_empty")


def answerable(vocab: DataFrame, view: str | None = None) -> DataFrame:
    """Vocabulary without junk; also as a temporary view when a name is given."""
    kept = vocab.filter(~X.junk(F.col("word")))
    if view:
        kept.createOrReplaceTempView(view)
    return kept
