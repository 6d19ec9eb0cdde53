"""Column functions on numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def part_of(n: Column, ratio: float) -> Column:
    """ratio * n to the nearest integer, halves to the even one."""
    return F.rint(n.cast("double") * F.lit(float(ratio))).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def valid_probability(p: Column) -> Column:
    """False for null, NaN and whatever lies outside 0 to 1."""
    return F.coalesce(p.between(0.0, 1.0) & ~F.isnan(p), F.lit(False))


def predicted(p: Column, threshold: float) -> Column:
    """1 at the threshold or above, 0 below, null without a valid probability."""
    return F.when(valid_probability(p), (p >= threshold).cast("int"))
