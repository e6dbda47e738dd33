"""Guards and probes on scored runs: tie neutrality, margins, stored representation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lexspan.functions import decisions as D, text as X, vectors as V
from lexspan.operators.cells import refuse_if_any
from lexspan.operators.scale import order_statistics, part_pick


def tie_groups(hits: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Per query: the size of the tie at the top and how a blind tie order would do in it.

    Strict: one over the size when the target is in the tie. Lenient: the acceptable
    share of the tie. Both are the chance that the first place is a hit.
    """
    ok = F.array_union(F.array(X.norm(F.col("target"))), F.transform("acceptable", X.norm))
    keys = queries.select("qid", X.norm(F.col("target")).alias("_t"), ok.alias("_ok"))
    top = hits.filter(F.col("rank") <= k)
    # A partition holds the k hits of one query.
    marked = top.withColumn("best", F.max("sim").over(W.partitionBy("qid"))).join(keys, "qid")
    tied = F.col("sim") == F.col("best")
    word = X.norm(F.col("word"))
    agg = marked.groupBy("qid").agg(
        F.count("*").alias("returned"), F.count_if(tied).alias("g"),
        F.count_if(tied & (word == F.col("_t"))).alias("target_in"),
        F.count_if(tied & F.array_contains("_ok", word)).alias("acceptable_in"),
        F.max(((F.col("rank") == 1) & (word == F.col("_t"))).cast("int")).alias("strict"),
        F.max(((F.col("rank") == 1) & F.array_contains("_ok", word)).cast("int")).alias("lenient"),
    )
    return agg.select(
        "qid", "g", "strict", "lenient",
        F.when(F.col("target_in") > 0, 1.0 / F.col("g")).otherwise(0.0).alias("strict_neutral"),
        (F.col("acceptable_in") / F.col("g")).alias("lenient_neutral"),
        (F.col("g") > 1).alias("tied"), (F.col("g") == F.col("returned")).alias("saturated"),
    )


def tie_audit(groups: DataFrame, by: list[str]) -> DataFrame:
    """Per run: hits at rank 1 against the expectation of a blind tie order."""
    agg = groups.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("strict").alias("strict"), F.sum("strict_neutral").alias("strict_neutral"),
        F.sum("lenient").alias("lenient"), F.sum("lenient_neutral").alias("lenient_neutral"),
        F.count_if("tied").alias("tied"), F.count_if("saturated").alias("saturated"),
    )
    excess = lambda kind: (F.col(kind) - F.col(f"{kind}_neutral")) / F.col("n")
    return agg.withColumn("worst", F.greatest(excess("strict"), excess("lenient"))).withColumn(
        "fails", F.col("worst") > D.TIE_TOLERANCE)


def require_neutral(audit: DataFrame) -> DataFrame:
    refuse_if_any(audit.filter("fails"), "rank 1 is won by a tie order that sees the answers")
    return audit


def miss_classes(hits: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Why a target is not in the first ten.

    `targets`: qid, target, sim (null without a stored vector). An index miss outscores
    returned words and yet was not returned.
    """
    wanted = targets.select("qid", "target", F.col("sim").alias("target_sim"))
    top = hits.filter("rank <= 10").select("qid", "rank", "word", "sim")
    agg = wanted.join(top, "qid", "left").groupBy("qid", "target", "target_sim").agg(
        F.count_if(F.col("sim") > F.col("target_sim")).alias("beating"),
        F.max(F.coalesce(F.lower("word") == F.lower("target"), F.lit(False))).alias("returned"),
        F.max(F.when(F.col("rank") == 1, F.col("sim"))).alias("top1_sim"),
    )
    kind = (
        F.when(F.col("target_sim").isNull(), "unreachable").when(F.col("returned"), "returned")
        .when(F.col("beating") + 1 <= 10, "index miss").otherwise("ranking failure")
    )
    return agg.withColumn("kind", kind).withColumn("margin", F.col("top1_sim") - F.col("target_sim"))


def margins(hits: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Mean similarity of targets, echoes, other results and first results, and the gaps."""
    stems = queries.select("qid", X.query_stems(F.col("query")).alias("_s"))
    top = hits.filter("rank <= 10").join(stems, "qid")
    echo = X.echoes_stems(F.col("word"), F.col("_s"))
    of_hits = top.agg(
        F.avg(F.when(echo, F.col("sim"))).alias("echo_sim"), F.avg(F.when(~echo, F.col("sim"))).alias("other_sim"),
        F.avg(F.when(F.col("rank") == 1, F.col("sim"))).alias("top1_sim"),
    )
    of_targets = miss_classes(hits, queries, targets).agg(
        F.avg("target_sim").alias("target_sim"), F.avg("margin").alias("mean_margin"))
    both = of_hits.select(
        "*", of_targets.select("target_sim").scalar().alias("target_sim"), of_targets.select("mean_margin").scalar().alias("mean_margin"))
    return both.withColumn("echo_gap", F.col("echo_sim") - F.col("target_sim")).withColumn(
        "other_gap", F.col("other_sim") - F.col("target_sim")
    ).withColumn("verdict", D.margin_verdict(F.col("echo_gap")))


def representation(probe: DataFrame) -> DataFrame:
    """What do stored vectors encode? `probe`: word_vec, description_vec (or null), stored."""
    sims = probe.select(
        V.dot(F.col("word_vec"), F.col("stored")).alias("lemma"),
        V.dot(F.col("description_vec"), F.col("stored")).alias("description"),
    )
    middle = order_statistics(sims, [], "lemma", {"p50": part_pick(1, 2)}).select("p50")
    agg = sims.agg(
        F.min("lemma").alias("min"), F.avg("lemma").alias("mean"), F.max("lemma").alias("max"),
        F.avg("description").alias("description_mean"),
    )
    return agg.withColumn("p50", middle.scalar()).withColumn(
        "verdict", D.representation_verdict(F.col("mean"), F.col("description_mean")))
