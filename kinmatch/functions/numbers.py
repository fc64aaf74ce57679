"""Numeric helpers with the edge cases that the metrics rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(a: Column, b: Column) -> Column:
    """``a / b``, and 0 where ``b`` is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b == 0, F.lit(1)).otherwise(b))


def f1(precision: Column, recall: Column) -> Column:
    return safe_divide(2 * precision * recall, precision + recall)


def pairs_of(n: Column) -> Column:
    """Unordered pairs among ``n`` things."""
    return (n * (n - 1) / 2).cast("long")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product of two arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def unit_vector(a: Column | str) -> Column:
    """The vector at length one; null for empty, non-finite or zero vectors."""
    c = F.col(a) if isinstance(a, str) else a
    wide = F.transform(c, lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # bound to a lambda's variable, the length is made once for a vector and not once for each value
    scaled = F.transform(F.array(F.struct(wide.alias("v"), norm(wide).alias("l"))), lambda s: F.when(s["l"] > 0, F.transform(s["v"], lambda x: x / s["l"])))
    return F.when(finite & (F.size(c) > 0), F.element_at(scaled, 1))


def is_probability(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & c.between(0, 1)


def balanced_round(c: Column) -> Column:
    """Rounding to whole numbers, halves to the even one."""
    return F.bround(c.cast("decimal(38,10)"), 0).cast("long")


def band(c: Column, edges: list[tuple[int, str]], rest: str) -> Column:
    """First label whose upper edge is not passed."""
    out = None
    for upper, name in edges:
        out = F.when(c <= upper, name) if out is None else out.when(c <= upper, name)
    return out.otherwise(rest)


def group_size_band(c: Column) -> Column:
    """``2`` (also 1), ``3_to_5``, ``6_to_9``, ``10_plus``."""
    return band(c, [(2, "2"), (5, "3_to_5"), (9, "6_to_9")], "10_plus")


def strict_size_band(c: Column) -> Column:
    """As ``group_size_band``, but size 1 falls into ``3_to_5``."""
    return F.when(c == 2, "2").otherwise(band(c, [(5, "3_to_5"), (9, "6_to_9")], "10_plus"))


def title_length_band(c: Column) -> Column:
    """Bands of raw title lengths."""
    return band(c, [(40, "up_to_40"), (80, "41_to_80")], "over_80")


def normalized_length_band(c: Column) -> Column:
    """Bands of normalized title lengths."""
    return band(c, [(30, "up_to_30"), (60, "31_to_60"), (100, "61_to_100")], "over_100")
