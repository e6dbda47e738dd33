"""Frames that the registered queries share, built from the fixtures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from lexspan.functions import text as X
from lexspan.operators import cells as C, ranks as R, search as S
from lexspan.plans.fixtures import table
from lexspan.session import freeze

DEPTH = S.RANK_DEPTH


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vocab").select("word", F.col("id").alias("row"), F.col("embedding").alias("vec"), "label")


def sense_cell(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "senses").select(
        "word", "sense_key", "pos", "member_pos", F.col("row_id").alias("row"), F.col("embedding").alias("vec"))


def glosses(spark: SparkSession, d: str) -> DataFrame:
    examples = F.filter(F.array("ex1", "ex2"), lambda e: e.isNotNull())
    return table(spark, d, "senses").select(
        "word", "sense_key", "pos", "member_pos", "gloss", examples.alias("examples"), F.col("row_id").alias("row"))


def synsets(spark: SparkSession, d: str) -> DataFrame:
    """Lexicon synsets, words in member order; at most three words each."""
    ordered = F.array_sort(F.collect_list(F.struct("member_pos", "word")))
    words = table(spark, d, "senses").groupBy("sense_key").agg(F.transform(ordered, lambda e: e["word"]).alias("words"))
    examples = F.filter(F.array("ex1", "ex2"), lambda e: e.isNotNull())
    rows = table(spark, d, "synsets").select(
        F.concat_ws(":", "pos", "off").alias("sense_key"), "pos", F.col("off").alias("offset"), "gloss",
        examples.alias("examples"))
    return rows.join(words, "sense_key").drop("sense_key")


def lemmas(spark: SparkSession, d: str) -> DataFrame:
    """Lexicon index: the lemmas of each part of speech, with profile words the vocabulary lacks."""
    profiles = table(spark, d, "profiles").select(
        F.when(F.col("part_of_speech") == "noun", "noun").otherwise("verb").alias("pos"), F.lower("word").alias("lemma"))
    listed = table(spark, d, "senses").select("pos", F.lower("word").alias("lemma"))
    return listed.unionByName(profiles).distinct()


def queries(spark: SparkSession, d: str) -> DataFrame:
    """The whole evaluation set, a row per word; searches ask for all of them."""
    return table(spark, d, "eval_set").select(
        F.col("id").alias("qid"), "id", "source", "query", "target", "reachable", "style", "sense_hint", "zipf", "qvec",
        X.split_csv(F.col("acceptable_csv")).alias("acceptable"),
        X.token_class(F.col("target")).alias("token_count"),
        X.lexical_overlap(F.col("query"), F.col("target")).alias("lexical_overlap"))


def synset_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cell = sense_cell(spark, d)
    return C.collapse_synsets(cell, check=False), C.synset_members(cell)


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_core").select(F.col("id").alias("qid"), "qvec")


def run_hits(spark: SparkSession, d: str, tag: str, k: int = DEPTH, asked: DataFrame | None = None) -> DataFrame:
    q = query_vectors(spark, d) if asked is None else asked.select("qid", "qvec")
    if tag == "lemma":
        return S.exact_topk(q, vectors(spark, d), k)
    if tag == "filtered":
        return S.filtered_topk(q, vectors(spark, d), X.junk(F.col("word")), k)
    if tag == "sense":
        return S.best_sense_topk(q, sense_cell(spark, d), k)
    collapsed, members = synset_parts(spark, d)
    return S.synset_topk(q, collapsed, members, k)


TAGS = ["lemma", "filtered", "sense", "synset"]


def all_hits(spark: SparkSession, d: str, tags: list[str], k: int = DEPTH, asked: DataFrame | None = None) -> DataFrame:
    """tag, qid, rank, word, sim of several runs: one scan of the words, and one of the senses."""
    q = query_vectors(spark, d) if asked is None else asked.select("qid", "qvec")
    parts = []
    words = {"lemma": (F.lit(True), False), "filtered": (~X.junk(F.col("word")), False)}
    wanted = {t: how for t, how in words.items() if t in tags}
    if wanted:
        parts.append(S.runs_topk(q, vectors(spark, d), wanted, k).select("tag", "qid", "rank", "word", "sim"))
    senses = sense_cell(spark, d)
    # The first row of a synset stands for it.
    first = F.row_number().over(W.partitionBy("sense_key").orderBy("row")) == 1
    wanted = {t: how for t, how in {"sense": (F.lit(True), True), "synset": (F.col("first"), False)}.items() if t in tags}
    if wanted:
        found = freeze(S.runs_topk(q, senses.withColumn("first", first), wanted, k))
        parts += [found.filter(F.col("tag") == "sense").select("tag", "qid", "rank", "word", "sim")] if "sense" in wanted else []
        if "synset" in wanted:
            words_of = S.expanded(found.filter(F.col("tag") == "synset"), C.synset_members(senses), k)
            parts.append(words_of.withColumn("tag", F.lit("synset")).select("tag", "qid", "rank", "word", "sim"))
    return reduce(DataFrame.unionByName, parts)


def results(spark: SparkSession, d: str, tags: list[str] = TAGS) -> DataFrame:
    """Every run scored in one pass over the union of their hits."""
    wanted = freeze(queries(spark, d))
    hits = all_hits(spark, d, tags, asked=wanted)
    rows = wanted.drop("qvec").withColumn("tag", F.explode(F.array(*[F.lit(t) for t in tags])))
    return R.score_hits(hits, rows, ["tag", "qid"]).drop("qid")


def saved_results(spark: SparkSession, d: str) -> DataFrame:
    """Results written once, for queries that read them more than once."""
    return freeze(results(spark, d))


# Configuration of the registered runs: index, exact scan, scale, variant, member order, set hash.
_CONFIG = [
    ("lemma", "vocab", True, None, "lemma", None, "aa", "tuned (served)", "2024-01-02", "n1"),
    ("filtered", "vocab", True, None, "lemma", None, "aa", "tuned (served)", "2024-01-01", "n1"),
    ("sense", "file:lemma_full", False, "full", "gloss", None, "aa", "tuned", "2024-01-03", "n1"),
    ("synset", "file:synset_cell", False, "sampled", "gloss_synset", "wordnet", None, "tuned", "2024-01-04", "n2"),
]
_CONFIG_COLUMNS = ["tag", "index_name", "exact", "pool_scale", "cell_variant", "expansion_order", "set_sha256", "model",
                   "ran_at", "preregistered"]


def _sql(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'"


CONFIG_SQL = " UNION ALL ".join(
    "SELECT " + ", ".join(
        (f"CAST({_sql(v)} AS STRING)" if not isinstance(v, bool) else _sql(v)) + f" AS {c}" for c, v in zip(_CONFIG_COLUMNS, row))
    for row in _CONFIG
)


def runs(spark: SparkSession, d: str, scored: DataFrame | None = None) -> DataFrame:
    """One row per run: its configuration and the size of what it scored."""
    counts = (scored if scored is not None else results(spark, d)).groupBy("tag").agg(F.count("*").alias("rows"))
    fixed = spark.sql(CONFIG_SQL)
    return fixed.join(counts, "tag").select(
        "*", F.lit("set1").alias("set_name"), F.lit(10).alias("k"), F.lit(DEPTH).alias("rank_depth"), F.lit(10).alias("probes"),
        (F.col("tag") == "filtered").alias("filter_junk"), F.when(F.col("pool_scale").isNotNull(), F.lit("note")).alias("note"))
