"""Near-duplicate vectors by collision-counting projections (operator 3).

Vectors of one label are unit vectors projected on many random lines.  On each
line the vectors are sorted; around a query's own place a window of fixed width
is open, and every vector in it collides with the query.  Pairs whose number of
collisions passes a threshold are verified by their cosine in double precision.
The projections are Gaussian, so a pair at the cosine limit collides on each
line with a known chance; the threshold is the highest that such a pair still
reaches with chance ``recall``, and closer pairs reach it more often.

Equal vectors of one label become one representative first, so a thousand
copies cost one vector.  A label's representatives are dealt by hash into blocks,
SIDE of them where that keeps a block between LEAST_BLOCK and MOST_BLOCK vectors; a
task compares two blocks and returns each vector's number of links and a spanning
forest of them, never the pairs.  Windows on lines are not selective in many
dimensions (one at the cosine limit holds about a fifth of all vectors), so work
grows with the square of a label's size; the README has the figures.

Vectors that are null, zero or hold null or non-finite components, and rows of
null label or null id, link with nothing.  Components of any finite size are
sound: vectors are scaled by their largest one first.  Vectors of different lengths do not
link.  Repeated rows are copies.  An empty table gives an empty result.  Extra
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .scratch import materialise, table
from .simhash import forest
from .skew import join_by_key

COSINE, LINES, WIDTH, RECALL, SEED = 0.93, 32, 1.0, 0.997, 7
SIDE, LEAST_BLOCK, MOST_BLOCK = 16, 4096, 32_768
#: Tasks that pairs of blocks are dealt to, at most.
MOST_TASKS = 65_536


def calibrated(cosine: float, lines: int, width: float, recall: float) -> tuple[float, int]:
    """The window's half width and the least number of collisions."""
    sigma = math.sqrt(2 * (1 - cosine))
    p = math.erf(width / math.sqrt(2))
    missed, least = 0.0, 0
    while least <= lines:
        missed += math.comb(lines, least) * p**least * (1 - p) ** (lines - least)
        if missed > 1 - recall:
            break
        least += 1
    return width * sigma, least


def linked(left: np.ndarray, right: np.ndarray | None, cosine: float, lines: int = LINES, width: float = WIDTH, recall: float = RECALL, seed: int = SEED):
    """Yields (query, array of linked places) between unit vectors of left and right, or within left."""
    half, least = calibrated(cosine, lines, width, recall)
    to = left if right is None else right
    along = np.random.default_rng(seed).standard_normal((left.shape[1], lines))
    mine, theirs = left @ along, to @ along
    order = [np.argsort(theirs[:, k], kind="stable") for k in range(lines)]
    sorted_ = [theirs[o, k] for k, o in enumerate(order)]
    low = np.stack([np.searchsorted(s, mine[:, k] - half, "left") for k, s in enumerate(sorted_)], 1).tolist()
    high = np.stack([np.searchsorted(s, mine[:, k] + half, "right") for k, s in enumerate(sorted_)], 1).tolist()
    for q in range(len(left)):
        windows = np.concatenate([o[a:b] for o, a, b in zip(order, low[q], high[q], strict=True)])
        found = np.flatnonzero(np.bincount(windows, minlength=len(to)) >= least)
        if right is None:
            found = found[found > q]
        if len(found):
            found = found[to[found] @ left[q] >= cosine]
            if len(found):
                yield q, found


def _links(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["embedding"]).astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)  # squares of any finite components are finite then
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        side, rep, copies = pdf["side"].to_numpy(), pdf["rep"].to_numpy(), pdf["copies"].to_numpy()
        n, pairs = np.zeros(len(rep), np.int64), []
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = pdf["a"].iloc[0] == pdf["b"].iloc[0]
        if same or (len(a) and len(b)):
            for q, found in linked(x[a], None if same else x[b], cosine):
                i, j = a[q], (a if same else b)[found]
                n[i] += copies[j].sum()
                n[j] += copies[i]
                pairs.append((np.full(len(j), i), j))
        place = np.argsort(rep)  # so that the least index is the least id
        rank = np.empty(len(rep), np.int64)
        rank[place] = np.arange(len(rep))
        root = rep[place][forest(len(rep), [(rank[i], rank[j]) for i, j in _joined(pairs)])][rank]
        some = n > 0
        return pd.DataFrame({"u": rep[some], "v": root[some], "n": n[some]})

    return run


def _joined(pairs: list) -> list:
    """Few long arrays of pairs instead of many short ones."""
    out, held, size = [], [], 0
    for p in pairs:
        held.append(p)
        size += len(p[0])
        if size >= 1 << 18:
            out.append(tuple(np.concatenate(x) for x in zip(*held, strict=True)))
            held, size = [], 0
    return out + ([tuple(np.concatenate(x) for x in zip(*held, strict=True))] if held else [])


def near_vectors(vectors: DataFrame, cosine: float = COSINE, block: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    x = F.col("embedding")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    inside = F.forall(x, lambda v: (v > float("-inf")) & (v < float("inf"))) & F.exists(x, lambda v: v != 0)
    sound = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & inside, F.lit(False))
    good, rest = rows.where(sound), rows.where(~sound)

    reps = materialise(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("embedding")), "representatives")
    size = F.lit(block) if block else F.least(F.greatest(F.ceil(F.col("n") / SIDE), F.lit(LEAST_BLOCK)), F.lit(MOST_BLOCK))
    sizes = reps.groupBy("label", "dim").agg(F.count("*").alias("n")).select("label", "dim", "n", F.ceil(F.col("n") / size).cast("int").alias("blocks"))
    # by what there is to compare, not by bytes, of which a pair of blocks has few
    n = F.col("n").cast("double")
    pairs, work = sizes.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1.0) / 2), F.sum(n * n / (2 * LEAST_BLOCK**2))).first()
    tasks = int(max(1, min(pairs or 1, math.ceil(work or 1), MOST_TASKS)))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = (reps.join(sizes.drop("n"), ["label", "dim"]).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("label", "dim", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "copies", "embedding"))
    found = materialise(dealt.repartition(tasks, "label", "dim", "a", "b").groupBy("label", "dim", "a", "b").applyInPandas(_links(cosine), "u long, v long, n long"), "vector-links")

    counts = found.groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    roots = components(found.where("u <> v").select("u", "v"))
    known = (reps.join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
             .select(F.struct("label", "embedding").alias("vector"), "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")))
    known = materialise(known, "known-vectors")
    own = good.select("vec_id", F.struct("label", "embedding").alias("vector"))
    linked_ = join_by_key(own, known, "vector", "copies", good.count()).select("vec_id", "n_links", "component_id")
    alone = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_vector_near_dedup": op3_vector_near_dedup}
SQL: dict[str, str] = {}
