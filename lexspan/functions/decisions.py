"""Test statistics and verdict rules as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

DECISION_DELTA = 0.06
SIGNIFICANCE = 0.05
TIE_TOLERANCE = 0.05
MARGIN_STRUCTURAL = 0.12
MARGIN_MIXED = 0.03
AGREE_RECALL = 0.02
AGREE_TOP1 = 0.95
POS_SKEW = 0.1
BARE_LEMMA = 0.98
NOT_LEMMA = 0.7


def mcnemar_p(losses: Column, wins: Column) -> Column:
    """Exact two-sided paired test: twice the lower binomial tail at one half, at most 1."""
    n = (losses + wins).cast("double")
    low = F.least(losses, wins).cast("double")
    largest = log_gamma(n + 1) - log_gamma(low + 1) - log_gamma(n - low + 1) + n * math.log(0.5)
    # From the largest term down; below 12 square roots of n the rest is under e ** -288.
    reach = F.least(low, F.ceil(12 * F.sqrt(n)) + 40).cast("long")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        smaller = acc["term"] * (low - i) / (n - low + i + 1)
        return F.struct(smaller.alias("term"), (acc["total"] + acc["term"]).alias("total"))

    tail = F.exp(largest) * F.aggregate(F.sequence(F.lit(0).cast("long"), reach), start, step)["total"]
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), tail * 2))


# Lanczos' coefficients for g = 7.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
            12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x of 1 or more."""
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:]):
        series = series + c / (x + i)
    t = x + 6.5
    return 0.5 * math.log(2 * math.pi) + (x - 0.5) * F.log(t) - t + F.log(series)


def verdict(delta: Column, p: Column) -> Column:
    """The rule agreed beforehand: small gains are a null result even when significant."""
    # The verdicts and their thresholds.
    return (
        F.when((delta >= DECISION_DELTA) & (p < SIGNIFICANCE), "WIN")
        .when(delta >= DECISION_DELTA, "above threshold, not significant")
        .when(delta > 0, "null result")
        .when(p < SIGNIFICANCE, "significant regression")
        .otherwise("no difference")
    )


def margin_verdict(gap: Column) -> Column:
    return (
        F.when(gap > MARGIN_STRUCTURAL, "structural").when(gap > MARGIN_MIXED, "mixed")
        .otherwise("ordering")
    )


def representation_verdict(lemma_mean: Column, description_mean: Column) -> Column:
    return (
        F.when(lemma_mean > BARE_LEMMA, "bare lemma")
        .when(
            (lemma_mean < NOT_LEMMA)
            & F.coalesce(description_mean > lemma_mean, F.lit(False)),
            "not bare lemma",
        )
        .otherwise("ambiguous")
    )


def pos_skew_verdict(noun_rate: Column, verb_rate: Column) -> Column:
    return F.when(noun_rate - verb_rate > POS_SKEW, "verbs underrepresented").otherwise("no large skew")
