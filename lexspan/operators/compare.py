"""Paired comparisons of runs and checks on whether a comparison means anything.

Runs have one row per tag: tag, set_name, set_sha256, ran_at, model, index_name, exact,
pool_scale, pool_words, cell_variant, expansion_order, k, rank_depth, note, preregistered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lexspan.functions import decisions as D
from lexspan.operators.metrics import is_headline, routed

LISTED = 25


def explicit_pairs(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Requested pairs whose tags both exist."""
    tags = runs.select("tag")
    known = pairs.join(tags.withColumnRenamed("tag", "a"), "a", "left_semi").join(
        tags.withColumnRenamed("tag", "b"), "b", "left_semi"
    )
    return known.select("a", "b", F.lit("requested").alias("why"))


def reference_pairs(runs: DataFrame, preferred: str | None = None) -> DataFrame:
    """The reference run of each set against its other runs.

    The reference is the preferred tag, else `baseline`, else the earliest run.
    """
    named = F.lit(preferred) if preferred else F.lit(None).cast("string")
    choice = F.when(F.col("tag") == named, 0).when(F.col("tag") == "baseline", 1).otherwise(2)
    keyed = runs.select("tag", F.coalesce("set_sha256", "set_name").alias("set_key"), "ran_at", choice.alias("choice"))
    best = F.min_by(F.struct("tag", "choice"), F.struct("choice", "ran_at", "tag")).alias("ref")
    refs = keyed.groupBy("set_key").agg(best).select("set_key", F.col("ref.tag").alias("a"), F.col("ref.choice").alias("choice"))
    why = F.when(F.col("choice") < 2, "the designated reference run").otherwise("the earliest run on this set")
    others = keyed.select("set_key", F.col("tag").alias("b"))
    return refs.join(others, "set_key").filter("a <> b").select("a", "b", why.alias("why"))


_SIDE = ["id", "source", "reachable", "query", "target", "rank", "lenient_rank", "echo", "top1"]


def paired(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """Queries present in both runs of each pair, columns suffixed _a and _b."""
    def side(letter: str) -> DataFrame:
        cols = [F.col(c).alias(c if c == "id" else f"{c}_{letter}") for c in _SIDE]
        return results.select(F.col("tag").alias(letter), *cols)

    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), ["b", "id"])


def _mean(hit: Column) -> Column:
    return F.avg(F.coalesce(hit, F.lit(False)).cast("double"))


def _count(hit: Column) -> Column:
    return F.count_if(F.coalesce(hit, F.lit(False)))


def _first(rank: str) -> Column:
    return F.coalesce(F.col(rank) == 1, F.lit(False))


def comparison(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per pair: lenient decision, strict figures and echo, on the shared queries.

    Only authored reachable queries count; a pair that shares none is scored on all
    shared queries and marked as leaked.
    """
    rows = paired(results, pairs)
    head = (F.col("source_a") == "authored") & F.coalesce("reachable_a", F.lit(True))
    scopes = F.filter(F.array(F.when(head, F.lit("authored")), F.lit("tripwire")), lambda s: s.isNotNull())
    rows = rows.withColumn("slice", F.explode(scopes))
    la, lb, sa, sb = _first("lenient_rank_a"), _first("lenient_rank_b"), _first("rank_a"), _first("rank_b")
    agg = rows.groupBy("a", "b", "slice").agg(
        F.count("*").alias("n"), _mean(la).alias("lenient_a"), _mean(lb).alias("lenient_b"),
        _count(~la & lb).alias("wins"), _count(la & ~lb).alias("regressions"),
        _mean(sa).alias("strict_a"), _mean(sb).alias("strict_b"),
        _count(~sa & sb).alias("strict_wins"), _count(sa & ~sb).alias("strict_regressions"),
        F.avg("echo_a").alias("echo_a"), F.avg("echo_b").alias("echo_b"),
    )
    # At most two rows per pair: the authored scope wins.
    first = F.row_number().over(W.partitionBy("a", "b").orderBy("slice"))
    one = agg.withColumn("_r", first).filter("_r = 1").drop("_r")
    p = D.mcnemar_p(F.col("regressions"), F.col("wins"))
    delta = F.col("lenient_b") - F.col("lenient_a")
    return one.withColumn("delta", delta).withColumn("p", p).withColumn(
        "strict_p", D.mcnemar_p(F.col("strict_regressions"), F.col("strict_wins"))
    ).withColumn("echo_delta", F.col("echo_b") - F.col("echo_a")).withColumn(
        "verdict", D.verdict(F.col("delta"), F.col("p"))
    )


def strict_comparison(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rank-1 comparison over every shared query, without a slice rule."""
    sa, sb = _first("rank_a"), _first("rank_b")
    agg = paired(results, pairs).groupBy("a", "b").agg(
        F.count("*").alias("n"), _mean(sa).alias("recall1_a"), _mean(sb).alias("recall1_b"),
        _mean(F.col("rank_a") <= 10).alias("recall10_a"), _mean(F.col("rank_b") <= 10).alias("recall10_b"),
        _count(~sa & sb).alias("wins"), _count(sa & ~sb).alias("regressions"),
        (F.avg("echo_b") - F.avg("echo_a")).alias("echo_delta"),
    )
    p = D.mcnemar_p(F.col("regressions"), F.col("wins"))
    return agg.withColumn("discordant", F.col("wins") + F.col("regressions")).withColumn("p", p).withColumn(
        "significant", F.col("p") < D.SIGNIFICANCE
    )


def changes(results: DataFrame, pairs: DataFrame, n: int = LISTED, lenient: bool = False) -> DataFrame:
    """First n wins and regressions of each pair by id, with both answers and the rest counted."""
    name = "lenient_rank" if lenient else "rank"
    first_a, first_b = _first(f"{name}_a"), _first(f"{name}_b")
    kind = F.when(~first_a & first_b, "win").when(first_a & ~first_b, "regression")
    rows = paired(results, pairs).withColumn("kind", kind).filter("kind is not null")
    totals = rows.groupBy("a", "b", "kind").agg(F.count("*").alias("total"))
    place = F.row_number().over(W.partitionBy("a", "b", "kind").orderBy("id"))
    top = rows.withColumn("place", place).filter(F.col("place") <= n)
    return top.join(totals, ["a", "b", "kind"]).select(
        "a", "b", "kind", "place", "id", F.col("target_a").alias("target"), "top1_a", "rank_a", "top1_b", "rank_b",
        F.greatest(F.col("total") - n, F.lit(0)).alias("more"),
    )


def comparability(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Is the pool scale the same, and are ties settled the same way?"""
    order = F.when(F.col("cell_variant") == "gloss_synset", F.coalesce("expansion_order", F.lit("unknown"))).otherwise(
        F.lit("alphabetical")
    )
    facts = runs.select("tag", "pool_scale", order.alias("tie_order"))

    def side(letter: str) -> DataFrame:
        return facts.select(F.col("tag").alias(letter), F.col("pool_scale").alias(f"scale_{letter}"),
                            F.col("tie_order").alias(f"tie_{letter}"))

    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    crossed = F.coalesce(F.col("scale_a") != F.col("scale_b"), F.lit(False))
    return rows.select("a", "b", crossed.alias("cross_scale"), (F.col("tie_a") != F.col("tie_b")).alias("tie_differs"))


def comparison_label(compared: DataFrame, flags: DataFrame) -> DataFrame:
    label = F.when(F.col("cross_scale"), "cross-scale").when(F.col("tie_differs"), "tie-break differs").otherwise(F.col("slice"))
    return compared.join(flags, ["a", "b"]).withColumn("label", label)


def cross_validation(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Exact database runs against full-scale lemma cells with the same model and set."""
    repo = F.substring_index("model", " ", 1)
    is_file = F.startswith("index_name", F.lit("file:"))
    exact = runs.filter(~is_file & F.col("exact")).select(
        F.col("tag").alias("a"), repo.alias("repo"), F.col("set_sha256").alias("set_a"))
    cells = runs.filter(is_file & (F.col("pool_scale") == "full") & F.contains("index_name", F.lit("lemma"))).select(
        F.col("tag").alias("b"), repo.alias("repo"), F.col("set_sha256").alias("set_b"))
    pairs = exact.join(cells, "repo").filter("set_a is null or set_b is null or set_a = set_b")
    scoped = routed(results).filter("in_scope")
    same = F.lower(F.coalesce("top1_a", F.lit(""))) == F.lower(F.coalesce("top1_b", F.lit("")))
    agg = paired(scoped, pairs).groupBy("a", "b").agg(
        F.count("*").alias("shared"), _mean(same).alias("agreement"),
        F.abs(_mean(_first("rank_b")) - _mean(_first("rank_a"))).alias("delta_r1"),
    )
    ok = (F.col("delta_r1") <= D.AGREE_RECALL) & (F.col("agreement") >= D.AGREE_TOP1)
    return agg.withColumn("consistent", ok)


def set_identity(runs: DataFrame, current: DataFrame) -> DataFrame:
    """Hashes recorded in runs against the current hash of each set. `current`: set_name, sha256."""
    grouped = runs.groupBy("set_name").agg(
        F.countDistinct("set_sha256").alias("hashes"), F.min("set_sha256").alias("recorded"), F.count("*").alias("runs")
    )
    status = (
        F.when(F.col("hashes") == 0, "not recorded").when(F.col("hashes") > 1, "several hashes")
        .when(F.col("sha256").isNull(), "cannot check")
        .when(F.col("recorded") == F.col("sha256"), "matches").otherwise("mismatch")
    )
    return grouped.join(current, "set_name", "left").select("set_name", "runs", "hashes", status.alias("status"))


def pair_counts(sets: DataFrame, results: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows per dimension and value of each set: from the set, else from its fullest run."""
    tags = results.groupBy("tag").agg(F.count("*").alias("scored"))
    full = runs.select("tag", "set_name").join(tags, "tag").groupBy("set_name").agg(
        F.max_by("tag", F.struct("scored", "tag")).alias("tag"))
    missing = full.join(sets.select("set_name").distinct(), "set_name", "left_anti")
    cols = ["source", "reachable", "lexical_overlap", "style", "token_count", "leakage"]
    rebuilt = results.join(missing, "tag").select("set_name", *cols, F.lit("run").alias("taken_from"))
    rows = sets.select("set_name", *cols, F.lit("set").alias("taken_from")).unionByName(rebuilt)
    values = {
        "source": F.col("source"), "reachable": F.when(~F.col("reachable"), "false").otherwise("true"),
        "lexical_overlap": F.coalesce("lexical_overlap", F.lit("none")), "style": F.coalesce("style", F.lit("(none)")),
        "token_count": F.coalesce("token_count", F.lit("(none)")), "leakage": F.coalesce("leakage", F.lit("none")),
    }
    entries = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in values.items()]))
    return rows.select("set_name", "taken_from", entries.alias("e")).groupBy(
        "set_name", "taken_from", "e.dimension", "e.value").agg(F.count("*").alias("n"))


def provenance(runs: DataFrame) -> DataFrame:
    """How each run searched."""
    search = F.when(F.col("exact"), "exact scan").when(F.startswith("index_name", F.lit("file:")), "exact (brute force)").otherwise(
        F.concat(F.lit("probes="), F.col("probes")))
    pool = F.when(F.col("filter_junk"), "junk filtered").otherwise("unfiltered")
    return runs.select("tag", "ran_at", "model", "index_name", search.alias("search"), pool.alias("pool"))


def provenance_warnings(runs: DataFrame) -> DataFrame:
    """More than one pool scale, or more than one pre-registered note?"""
    scale = F.when(F.col("note").isNotNull(), F.coalesce("pool_scale", F.lit("unrecorded")))
    return runs.agg(
        (F.countDistinct(scale) > 1).alias("mixed_scales"), (F.countDistinct("preregistered") > 1).alias("mixed_notes"))
