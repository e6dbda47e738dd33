"""Zipf frequency: scale and bands."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Band names, most frequent first.
BANDS = ["very_common", "common", "mid", "uncommon", "rare"]

# Labels used when a band is shown as a slice.
BAND_LABELS = ["very_common (>=5)", "common (4-5)", "mid (3-4)", "uncommon (2-3)", "rare (<2)"]


def zipf_of(count: Column, total: Column) -> Column:
    return F.log10(count.cast("double") / total.cast("double") * 1e9)


def _ladder(z: Column, names: list[str], missing: str) -> Column:
    return (
        F.when(z.isNull() | F.isnan(z), F.lit(missing))
        .when(z >= 5, names[0]).when(z >= 4, names[1])
        .when(z >= 3, names[2]).when(z >= 2, names[3])
        .otherwise(names[4])
    )


def band(z: Column) -> Column:
    return _ladder(z.cast("double"), BANDS, "rare")


def band_label(z: Column) -> Column:
    return _ladder(z.cast("double"), BAND_LABELS, "unknown")


def band_rank(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(b) for b in BANDS]), name) - 1
