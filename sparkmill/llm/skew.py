"""Joins whose keys may each hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of more than one in so many rows is hot; so there are fewer hot keys than this.
MOST_HOT = 1024


def join_by_key(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """left joined with right, which has one row for each key and in n the rows of left that have it.

    Rows of hot keys meet a broadcast table of fewer than MOST_HOT rows and stay where they are;
    the others are shuffled.  total: the rows of left, which is read twice: give it materialised.
    """
    hot = right.where(F.col(n) * MOST_HOT > F.lit(total)).drop(n)
    one = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col(n) * MOST_HOT <= F.lit(total)).drop(n), key)
    return one.unionByName(rest)
