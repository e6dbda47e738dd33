"""Retrieval metrics over scored results.

Results have one row per run and query: tag, id, source, query, target, reachable,
acceptable, style, token_count, lexical_overlap, zipf, rank, lenient_rank, echo, top1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexspan.functions import bands as B, text as X
from lexspan.operators.scale import order_statistics, part_pick, percentile_pick


def _hit(rank: str, k: int) -> Column:
    return F.avg(F.when(F.col(rank) <= k, 1.0).otherwise(0.0))


def metrics() -> list[Column]:
    """Aggregates of one group. Averages over no rows are null."""
    return [
        F.count("*").alias("n"),
        _hit("rank", 1).alias("recall1"), _hit("rank", 3).alias("recall3"), _hit("rank", 10).alias("recall10"),
        F.avg(F.when(F.col("rank") <= 10, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr10"),
        _hit("lenient_rank", 1).alias("lenient_recall1"), _hit("lenient_rank", 3).alias("lenient_recall3"),
        _hit("lenient_rank", 10).alias("lenient_recall10"), F.avg("echo").alias("echo_rate"),
        F.avg(F.when(F.col("rank") > 10, 1.0).otherwise(0.0)).alias("beyond10"),
    ]


METRIC_NAMES = ["recall1", "recall3", "recall10", "mrr10", "lenient_recall1", "lenient_recall3",
                "lenient_recall10", "echo_rate", "beyond10"]


def score(results: DataFrame, by: list[str]) -> DataFrame:
    return results.groupBy(*by).agg(*metrics())


def is_headline() -> Column:
    return (F.col("source") == "authored") & F.coalesce("reachable", F.lit(True))


def routed(results: DataFrame) -> DataFrame:
    """Adds `in_scope`: the authored reachable rows, or every reachable row of a run without any."""
    flags = results.groupBy("tag").agg(F.max(is_headline()).alias("has_authored"))
    rows = results.join(flags, "tag")
    reachable = F.coalesce("reachable", F.lit(True))
    return rows.withColumn("in_scope", F.when(F.col("has_authored"), is_headline()).otherwise(reachable))


def headline(results: DataFrame) -> DataFrame:
    """Metrics per run for the authored, overlap-free, leaked and unreachable slices."""
    overlap = F.coalesce("lexical_overlap", F.lit("none"))
    head = is_headline()
    names = F.filter(F.array(
        F.when(head, F.lit("authored")),
        F.when(head & (overlap == "none"), F.lit("authored, overlap none")),
        F.when(head & (overlap != "none"), F.lit("authored, overlap")),
        F.when(F.col("source") == "gloss_tripwire", F.lit("tripwire")),
        F.when(~F.coalesce("reachable", F.lit(True)), F.lit("unreachable")),
    ), lambda s: s.isNotNull())
    return score(results.withColumn("slice", F.explode(names)), ["tag", "slice"])


def slice_keys() -> dict[str, Column]:
    """Slice dimensions; a null value keeps a row out of that dimension."""
    return {
        "style": F.col("style"), "length": X.length_bucket(F.col("query")), "tokens": F.col("token_count"),
        "overlap": F.coalesce("lexical_overlap", F.lit("none")), "band": B.band_label(F.col("zipf")),
    }


def slices(results: DataFrame) -> DataFrame:
    """Metrics per run, dimension and value. The source dimension covers all rows."""
    rows = routed(results)
    entries = [F.struct(F.lit("source").alias("dimension"), F.col("source").alias("value"))] + [
        F.when(F.col("in_scope") & key.isNotNull(), F.struct(F.lit(name).alias("dimension"), key.alias("value")))
        for name, key in slice_keys().items()
    ]
    exploded = rows.withColumn("e", F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())))
    return score(exploded.select("*", "e.dimension", "e.value"), ["tag", "dimension", "value"])


def terciles(results: DataFrame) -> DataFrame:
    """Zipf third of each in-scope row, with the cut points; `unknown` without enough values."""
    rows = routed(results).filter("in_scope")
    cuts = order_statistics(rows, ["tag"], "zipf", {"lo": part_pick(1, 3), "hi": part_pick(2, 3)})
    joined = rows.join(cuts.withColumnRenamed("n", "values"), "tag", "left")
    few = F.coalesce(F.col("values") < 3, F.lit(True))
    third = (
        F.when(few | F.col("zipf").isNull(), "unknown").when(F.col("zipf") < F.col("lo"), "low")
        .when(F.col("zipf") < F.col("hi"), "mid").otherwise("high")
    )
    return joined.withColumn("third", third)


def headroom(results: DataFrame, runs: DataFrame) -> DataFrame:
    """What a perfect reranker could add: within the first ten, and down to the run's depth."""
    scored = score(routed(results).filter("in_scope"), ["tag", "has_authored"])
    deep = F.col("rank_depth") > F.col("k")
    return scored.join(runs.select("tag", "k", "rank_depth"), "tag").select(
        "tag", F.when(F.col("has_authored"), "authored").otherwise("tripwire").alias("slice"), "n",
        "recall1", "recall10", (F.col("recall10") - F.col("recall1")).alias("gap"),
        F.when(deep, F.col("beyond10")).alias("beyond10"), F.when(deep, F.col("rank_depth")).alias("depth"),
    )


def coverage_slice(results: DataFrame) -> DataFrame:
    """Unreachable targets per run, and how many were returned all the same."""
    return results.groupBy("tag").agg(
        F.count_if(~F.col("reachable")).alias("unreachable"),
        F.count_if(~F.col("reachable") & F.col("rank").isNotNull()).alias("found"),
    )


def latency(timings: DataFrame) -> DataFrame:
    """p50 and p95 of total, encoding and search time per run; local runs report none.

    `timings`: tag, is_local, embed_ms, search_ms.
    """
    parts = F.explode(F.array(
        F.struct(F.lit("total").alias("part"), (F.col("embed_ms") + F.col("search_ms")).alias("ms")),
        F.struct(F.lit("embed").alias("part"), F.col("embed_ms").alias("ms")),
        F.struct(F.lit("search").alias("part"), F.col("search_ms").alias("ms")),
    ))
    rows = timings.filter(~F.col("is_local")).select("tag", parts.alias("p")).select("tag", "p.part", "p.ms")
    return order_statistics(rows, ["tag", "part"], "ms", {"p50": percentile_pick(50), "p95": percentile_pick(95)})
