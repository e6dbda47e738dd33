"""Vector expressions on array columns. Sums run left to right in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(vec: Column) -> Column:
    return F.sqrt(_sum(F.transform(as_double(vec), lambda x: x * x)))


def normalise(vec: Column) -> Column:
    """Unit vector; the zero vector stays as it is."""
    # The length is one argument, computed once; inside the lambda it would be computed again
    # for every component.
    same = F.array_repeat(norm(vec), F.size(vec))
    return F.zip_with(as_double(vec), same, lambda x, length: F.when(length > 0, x / length).otherwise(x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, null when either side has no direction."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths)


def truncate(vec: Column, dims: int) -> Column:
    """Leading `dims` components, brought back to unit length."""
    if not isinstance(dims, int) or dims < 1:
        raise ValueError("dims must be a positive integer")
    return normalise(F.slice(vec, 1, dims))


def round_half(vec: Column) -> Column:
    """Round every component to the nearest 16-bit float (ties to even), kept as a double."""

    def one(x: Column) -> Column:
        size = F.abs(x)
        exponent = F.greatest(F.floor(F.log2(size)).cast("double"), F.lit(-14.0))
        step = F.pow(F.lit(2.0), exponent - 10.0)
        return F.when(size > 0, F.rint(x / step) * step).otherwise(x)

    return F.transform(as_double(vec), one)


def prepare_query(vec: Column, dim: Column, precision: Column) -> Column:
    """Cut, round and renormalise a query the way a cell's own vectors were stored."""
    cut = F.slice(as_double(vec), F.lit(1), F.least(dim.cast("int"), F.size(vec)))
    return normalise(F.when(precision == "float16", round_half(cut)).otherwise(cut))


def max_abs_diff(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(as_double(a), as_double(b), lambda x, y: F.abs(x - y)))


def parse_literal(text: Column) -> Column:
    """`[0.1,0.2]` -> array of doubles."""
    return F.from_json(text, "array<double>")


def payload_mb(rows: Column, dim: int, bytes_per: int) -> Column:
    return rows.cast("double") * dim * bytes_per / 1e6
