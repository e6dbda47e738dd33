"""Building, checking and sampling evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lexspan.functions import bands as B, text as X
from lexspan.operators.cells import refuse_if_any
from lexspan.operators.scale import number_by_order, order_statistics, part_pick

PER_CELL = 200
SAMPLE_SEED = "20260818"


def violations(draft: DataFrame) -> DataFrame:
    """Rule violations, one row each. `draft`: position, target, query, hint.

    Of several rows with one target, all but the first are duplicates.
    """
    first = draft.groupBy(F.lower("target").alias("_t")).agg(F.min("position").alias("_first"))
    rows = draft.join(first, F.lower(draft["target"]) == F.col("_t"))
    words, hints = X.word_count(F.col("query")), X.word_count(F.col("hint"))
    # The wording of the reasons.
    reasons = F.array(
        F.when(F.col("position") > F.col("_first"), F.lit("duplicate target")),
        F.when(words < 3, F.concat(F.lit("query is only "), words, F.lit(" words"))),
        F.when(X.contains_phrase(F.col("query"), F.col("target")), F.lit("query contains the target")),
        F.when(hints > 1, F.concat(F.lit("sense hint is "), hints, F.lit(" words, max 1"))),
    )
    return rows.select("position", "target", F.explode(F.filter(reasons, lambda r: r.isNotNull())).alias("reason"))


def check_draft(draft: DataFrame) -> DataFrame:
    refuse_if_any(violations(draft), "the draft breaks its rules")
    return draft


def annotate(draft: DataFrame, zipf: DataFrame, vocab: DataFrame) -> DataFrame:
    """Zipf, band, token class, reachability and lexical overlap of each draft row."""
    key = F.lower(draft["target"])
    z = zipf.select(F.col("word").alias("_z"), "zipf")
    known = vocab.select(F.lower("word").alias("_v")).distinct().withColumn("_in", F.lit(True))
    rows = draft.join(z, key == F.col("_z"), "left").join(known, key == F.col("_v"), "left")
    return rows.select(
        *draft.columns, "zipf", B.band(F.col("zipf")).alias("band"),
        X.token_class(F.col("target")).alias("tokens"), F.coalesce("_in", F.lit(False)).alias("reachable"),
        X.lexical_overlap(F.col("query"), F.col("target")).alias("overlap"),
    )


def draft_order(annotated: DataFrame) -> list[Column]:
    return [F.desc("reachable"), B.band_rank(F.col("band")).asc(), F.asc("style"), F.asc("target")]


def surprises(annotated: DataFrame) -> DataFrame:
    """Rows whose membership differs from what their author expected."""
    kind = F.when(~F.col("reachable") & ~F.col("expect_unreachable"), "missing").when(
        F.col("reachable") & F.col("expect_unreachable"), "present"
    )
    return annotated.withColumn("surprise", kind).filter("surprise is not null").select("target", "surprise")


def tallies(annotated: DataFrame) -> DataFrame:
    """Counts by band, style and token class over reachable rows, by overlap over all rows."""
    def entry(name: str, value: str, counted: Column) -> Column:
        return F.when(counted, F.struct(F.lit(name).alias("dimension"), F.col(value).alias("value")))

    entries = F.array(
        entry("band", "band", F.col("reachable")), entry("style", "style", F.col("reachable")),
        entry("tokens", "tokens", F.col("reachable")), entry("overlap", "overlap", F.lit(True)),
    )
    rows = annotated.select(F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e"))
    return rows.groupBy("e.dimension", "e.value").agg(F.count("*").alias("n"))


def query_lengths(annotated: DataFrame) -> DataFrame:
    """Shortest, middle and longest query of the reachable rows, in words."""
    lengths = annotated.filter("reachable").select(X.word_count(F.col("query")).alias("words"))
    middle = order_statistics(lengths, [], "words", {"p50": part_pick(1, 2)})
    ends = lengths.agg(F.min("words").alias("shortest"), F.max("words").alias("longest"))
    return ends.withColumn("p50", middle.select("p50").scalar())


def authored_rows(tsv: DataFrame, zipf: DataFrame) -> DataFrame:
    """Evaluation rows of a reviewed table; everything derivable is computed again.

    `tsv`: position (unique, file order) and the string columns of the draft.
    """
    usable = tsv.filter((F.coalesce("target", F.lit("")) != "") & (F.coalesce("query", F.lit("")) != ""))
    numbered = number_by_order(usable, ["position"], "_n")
    z = zipf.select(F.col("word").alias("_z"), F.col("zipf").alias("_table"))
    rows = numbered.join(z, F.lower(numbered["target"]) == F.col("_z"), "left")
    own = F.when(F.coalesce("zipf", F.lit("")) != "", F.expr("try_cast(zipf AS double)")).otherwise(F.col("_table"))

    def given(name: str) -> Column:
        return F.when(F.col(name) != "", F.col(name))

    return rows.select(
        X.row_id("authored", F.col("_n") + 1).alias("id"), "query", "target", F.lit("authored").alias("source"),
        given("sense_hint").alias("sense_hint"), own.alias("zipf"),
        X.token_class(F.col("target")).alias("token_count"), given("style").alias("style"),
        F.coalesce(given("lexical_overlap"), F.lit("none")).alias("lexical_overlap"),
        X.reachable_flag(F.col("reachable")).alias("reachable"),
        X.split_csv(F.col("acceptable")).alias("acceptable"), F.lit(None).cast("string").alias("leakage"),
    )


def tripwire_rows(profiles: DataFrame, vocab: DataFrame, zipf: DataFrame) -> DataFrame:
    """Evaluation rows from stored definitions, kept apart as a regression detector."""
    known = vocab.select(F.lower("word").alias("_v"))
    usable = profiles.filter(X.usable_definition(F.col("word"), F.col("definition")))
    inside = usable.join(known, F.lower(usable["word"]) == F.col("_v"), "left_semi").select("word", "definition")
    numbered = number_by_order(inside, ["word"], "_n")
    z = zipf.select(F.col("word").alias("_z"), "zipf")
    rows = numbered.join(z, F.lower(numbered["word"]) == F.col("_z"), "left")
    text = lambda: F.lit(None).cast("string")
    return rows.select(
        X.row_id("tripwire", F.col("_n") + 1).alias("id"), X.strip(F.col("definition")).alias("query"),
        F.col("word").alias("target"), F.lit("gloss_tripwire").alias("source"), text().alias("sense_hint"), "zipf",
        X.token_class(F.col("word")).alias("token_count"), text().alias("style"), text().alias("lexical_overlap"),
        F.lit(True).alias("reachable"), F.array().cast("array<string>").alias("acceptable"),
        F.lit("paraphrase").alias("leakage"),
    )


def assemble(authored: DataFrame | None, tripwire: DataFrame) -> DataFrame:
    """Both slices together; an authored slice that was asked for must not be empty."""
    if authored is None:
        return tripwire
    if not authored.limit(1).count():
        raise ValueError("the authored slice is empty")
    return authored.unionByName(tripwire)


def slice_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(
        F.count("*").alias("rows"), F.count_if("reachable").alias("reachable"),
        F.count_if(F.size("acceptable") > 0).alias("with_acceptable"),
    )


def stratified_targets(
    vocab: DataFrame, profiles: DataFrame, zipf: DataFrame, n: int = PER_CELL, seed: str = SAMPLE_SEED
) -> DataFrame:
    """n words per band and word-count cell, words with a definition left out."""
    defined = profiles.filter(F.col("definition") != "").select(F.lower("word").alias("_d"))
    words = vocab.filter(F.col("word").rlike("^[a-z]")).select("word")
    free = words.join(defined, F.lower(words["word"]) == F.col("_d"), "left_anti")
    z = zipf.select(F.col("word").alias("_z"), "zipf")
    rows = free.join(z, free["word"] == F.col("_z"), "left").select(
        "word", B.band(F.col("zipf")).alias("band"),
        F.when(F.col("word").rlike("[ _]"), "multi").otherwise("single").alias("tokens"),
    )
    cell = W.partitionBy("band", "tokens").orderBy(X.hash_order(seed, F.col("word")), "word")
    picked = rows.withColumn("place", F.row_number().over(cell)).filter(F.col("place") <= n)
    pool = rows.groupBy("band", "tokens").agg(F.count("*").alias("pool"))
    return picked.join(pool, ["band", "tokens"])
