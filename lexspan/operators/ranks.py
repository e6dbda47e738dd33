"""From hits to scored results: target rank, lenient rank, lexical echo."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexspan.functions import text as X


def score_hits(hits: DataFrame, queries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per query: rank, lenient_rank, echo and the first answer.

    `hits`: qid, rank, word, sim. `queries`: qid, query, target, acceptable (array). `by`
    names the columns of both that identify a row, such as run and query. The echo rate is over the words returned in the first ten places, 0 when there are none.
    """
    by = by or ["qid"]
    keys = queries.select(
        *by,
        X.norm(F.col("target")).alias("_t"),
        F.array_union(
            F.array(X.norm(F.col("target"))),
            F.transform(F.coalesce("acceptable", F.array().cast("array<string>")), X.norm),
        ).alias("_ok"),
        X.query_stems(F.col("query")).alias("_stems"),
    )
    joined = hits.join(keys, by).withColumn("_w", X.norm(F.col("word")))
    echo = X.echoes_stems(F.col("word"), F.col("_stems")).cast("double")
    scored = joined.groupBy(*by).agg(
        F.min(F.when(F.col("_w") == F.col("_t"), F.col("rank"))).alias("rank"),
        F.min(F.when(F.array_contains("_ok", F.col("_w")), F.col("rank"))).alias("lenient_rank"),
        F.avg(F.when(F.col("rank") <= 10, echo)).alias("echo"),
        F.max(F.when(F.col("rank") == 1, F.col("word"))).alias("top1"),
        F.max(F.when(F.col("rank") == 1, F.col("sim"))).alias("top1_sim"),
    )
    return queries.join(scored, by, "left").withColumn("echo", F.coalesce("echo", F.lit(0.0)))


def echo_rate(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Share of each query's first ten words that share a stem with the query."""
    stems = queries.select("qid", X.query_stems(F.col("query")).alias("_stems"))
    joined = stems.join(hits.filter("rank <= 10"), "qid", "left")
    shared = F.avg(X.echoes_stems(F.col("word"), F.col("_stems")).cast("double"))
    return joined.groupBy("qid").agg(F.coalesce(shared, F.lit(0.0)).alias("echo"))
