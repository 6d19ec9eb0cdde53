"""Connected components of a graph given as a table of links.

Alternating large-star and small-star steps on two long columns.  Every step is
a minimum for each node, combined before the shuffle, and a join back, in which
nodes with very many neighbours are broadcast, so that these do not meet in one
place; each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise
from .skew import join_by_key


def _large_star(links: DataFrame, total: int) -> DataFrame:
    """Links (u, v), each once: every node's larger neighbours go to its least."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return join_by_key(both.where("v > u"), least, "u", "n", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """Links run from larger to smaller: every node and its smaller neighbours go to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_by_key(links, least, "u", "n", total).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of a link (u, v); root is the component's least node.

    Links of a node with itself give that node alone.  Repeated links do no harm.
    """
    own = links.where("u = v").select("u", "v").distinct()
    now = materialise(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(now)
    while state[0]:
        large = materialise(_large_star(now, state[0]), "links")
        now = materialise(_small_star(large, large.count()), "links")
        state, before = _state(now), state
        if state == before:
            break
    roots = now.select(F.col("v").alias("u"), "v").distinct()
    found = now.select("u", "v").unionByName(roots)
    return found.unionByName(own).groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("root"))
