"""Sharding by histogram sort (operator 9).

Rows are ordered by (hash of the text, id), so equal texts are neighbours.  The
splitters that cut this order into shards of near equal bytes are found by
counting: every round each partition adds up the exact bytes between candidate
keys, the sums meet in one small table, and the candidates move into the gap
that holds the wanted byte.  Once each splitter is within its tolerance, every
row is dealt to its place by one exchange.  Each shard is cut further, in the
same search, into ranges of bounded size, so that numbering the slots is a
window over ranges and never over a shard.  A range that is much larger because
one id and text is repeated is numbered in parts.

A shard border inside a group of equal texts moves to the group's nearer end if
that costs no more than ``group_tolerance`` of a shard; larger groups are split
by id, as the law asks for near equal bytes.  A null text has size 1 and is a
group of its own; empty texts are another.  Repeated rows with one id and text
stay in one shard.  An empty table gives an empty result.  Extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import materialise, table

SHARDS, TOLERANCE, GROUP_TOLERANCE, RANGE_ROWS, MOST_RANGES, PROBES = 16, 0.001, 0.02, 50_000, 1024, 32
_TOP = 1 << 63


class Keys:
    """(hash, id) as one integer: hash * span + place of the id, null ids first."""

    def __init__(self, low: int, high: int):
        self.low, self.span = low, high - low + 2

    def split(self, keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        # the key behind the last one has no 64-bit hash; nothing lies there
        keys = [min(k, (1 << 64) * self.span - 1) for k in keys]
        return np.array([k // self.span for k in keys], np.uint64), np.array([k % self.span for k in keys], np.uint64)

    def columns(self, batch) -> tuple[np.ndarray, np.ndarray]:
        h = batch.column("_h").to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(_TOP)
        ids = batch.column("_id")
        at = ids.fill_null(self.low).to_numpy(zero_copy_only=False).astype(np.int64)
        at = (at - self.low + 1).astype(np.uint64)
        at[ids.is_null().to_numpy(zero_copy_only=False)] = 0
        return h, at


def between(probes: tuple[np.ndarray, np.ndarray], h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the sorted probes lie at or below each row's key."""
    ph, pd = probes
    left, right = np.searchsorted(ph, h, "left"), np.searchsorted(ph, h, "right")
    out = left.copy()
    for k in np.unique(left[right > left]):
        own = (left == k) & (right > left)
        out[own] = k + np.searchsorted(pd[k : right[own][0]], at[own], "right")
    return out


def sums_between(slim: DataFrame, keys: Keys, probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows in each of the len(probes) + 1 gaps."""
    split, n = keys.split(probes), len(probes) + 1

    def run(batches):
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            gap = between(split, *keys.columns(batch))
            np.add.at(size, gap, batch.column("_size").to_numpy(zero_copy_only=False))
            rows += np.bincount(gap, minlength=n)
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(size[full]), pa.array(rows[full])], names=["gap", "size", "rows"])

    size, rows = [0] * n, [0] * n
    for r in slim.mapInArrow(run, "gap long, size long, rows long").groupBy("gap").agg(F.sum("size"), F.sum("rows")).collect():
        size[r[0]], rows[r[0]] = r[1], r[2]
    return np.array(size, object), np.array(rows, object)


def find_splitters(slim: DataFrame, keys: Keys, total: int, rows: int, targets: list[int], slack: list[int]) -> list[int]:
    """For each target a key with that many bytes below it, give or take its slack
    or, where one row is larger than that, half of that row."""
    found: list[int | None] = [None] * len(targets)
    gaps = [((0, 0, 0), ((1 << 64) * keys.span, total, rows))] * len(targets)  # key, bytes and rows below it
    while open_ := [i for i, x in enumerate(found) if x is None]:
        probes = set()
        for (low, *_), (high, *_) in {gaps[i] for i in open_}:
            step = max(1, (high - low) // PROBES)
            probes.update(range(low + step, high, step))
        probes = sorted(probes)
        sums = [np.cumsum(x) for x in sums_between(slim, keys, probes)] if probes else [[], []]
        for i in open_:
            low, high = gaps[i]
            known = [low, *(x for x in zip(probes, *sums, strict=False) if low[0] < x[0] < high[0]), high]
            best = min(known, key=lambda x: abs(x[1] - targets[i]))
            k = next(k for k in range(1, len(known)) if known[k][1] >= targets[i])
            gaps[i] = known[k - 1], known[k]
            alone = known[k][2] - known[k - 1][2] <= 1 or known[k][0] - known[k - 1][0] <= 1
            if alone or abs(best[1] - targets[i]) <= slack[i]:
                found[i] = best[0]
    return found


def whole_groups(slim: DataFrame, keys: Keys, splitters: list[int], targets: list[int], slack: int) -> list[int]:
    """Moves splitters inside a group of equal texts to an end of it that is near enough."""
    ends = sorted({e for s in splitters if s % keys.span for e in (s // keys.span * keys.span, (s // keys.span + 1) * keys.span)})
    if not ends:
        return splitters
    below = dict(zip(ends, np.cumsum(sums_between(slim, keys, ends)[0]), strict=False))
    out = []
    for s, target in zip(splitters, targets, strict=True):
        near = [e for e in (s // keys.span * keys.span, (s // keys.span + 1) * keys.span) if s % keys.span and abs(below[e] - target) <= slack]
        out.append(min(near, key=lambda e: abs(below[e] - target), default=s))
    return out


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, group_tolerance: float = GROUP_TOLERANCE,
          range_rows: int = RANGE_ROWS, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """doc_id, text (if kept), size, text_crc32, shard, slot of every row."""
    text = F.col(text_col)
    full = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_h"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("_size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("_crc"), *([text.alias("_text")] if keep_text else []))
    slim = materialise(full.drop("_text"), "keys")
    low, high, total, n = slim.agg(F.min("_id"), F.max("_id"), F.sum("_size"), F.count("*")).first()
    keys, total = Keys(low or 0, high or 0), total or 0
    parts = min(MOST_RANGES, -(-n // (range_rows * shards)) or 1)
    fair = total / shards
    inner = range(1, shards * parts if n else 1)
    targets = [round(fair * k / parts) for k in inner]
    border = [k % parts == 0 for k in inner]
    slack = [int(fair * tolerance / 2) if b else int(fair / parts / 4) for b in border]
    cuts = find_splitters(slim, keys, total, n, targets, slack) if n else []
    at = [i for i, b in enumerate(border) if b]
    if n:
        for i, s in zip(at, whole_groups(slim, keys, [cuts[i] for i in at], [targets[i] for i in at], int(fair * group_tolerance)), strict=True):
            cuts[i] = s
    # a moved border may have passed a range's end; equal cuts only make empty ranges
    borders = [0, *(cuts[i] for i in at), (1 << 64) * keys.span]
    cuts = sorted([*borders[1:-1], *(s for s, b in zip(cuts, border, strict=True) if not b)])
    shard_of = [max(k for k in range(len(borders) - 1) if borders[k] <= low_end) for low_end in [0, *cuts]]
    split = keys.split(cuts)
    rows = sums_between(slim, keys, cuts)[1] if n else [0] * len(shard_of)
    first, seen = [], [0] * (shards + 1)
    for s, r in zip(shard_of, rows, strict=True):
        first.append(seen[s])
        seen[s] += int(r)
    shard_np, first_np = np.array(shard_of, np.int32), np.array(first, np.int64)
    parts_np = np.array([-(-int(r) // range_rows) if r > 2 * range_rows else 1 for r in rows], np.int64)
    names = full.columns if keep_text else slim.columns

    def deal(batches):
        seen = 0
        for batch in batches:
            gap = between(split, *keys.columns(batch))
            own = np.arange(seen, seen := seen + len(gap)) % parts_np[gap]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(gap, pa.int32()), pa.array(own, pa.int32()), pa.array(shard_np[gap]), pa.array(first_np[gap])],
                names=[*names, "_range", "_part", "shard", "_first"])

    source = full if keep_text else slim
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields)
    dealt = source.mapInArrow(deal, f"{schema}, _range int, _part int, shard int, _first long")
    if (parts_np > 1).any():
        # parts go by the order of rows, which must be one and the same where they are counted and where they are numbered
        dealt = materialise(dealt, "dealt")
        sizes = dealt.where(F.col("_range").isin(np.flatnonzero(parts_np > 1).tolist())).groupBy("_range", "_part").agg(F.count("*").alias("_n"))
        before = sizes.select("_range", "_part", F.coalesce(F.sum("_n").over(Window.partitionBy("_range").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        # no more rows than there are ranges of range_rows rows
        dealt = dealt.join(F.broadcast(before), ["_range", "_part"], "left").withColumn("_first", F.col("_first") + F.coalesce("_before", F.lit(0)))
    place = Window.partitionBy("_range", "_part").orderBy("_h", "_id", "_crc")
    return (dealt.withColumn("slot", F.col("_first") + F.row_number().over(place) - 1)
            .select(F.col("_id").alias("doc_id"), *([F.col("_text").alias("text")] if keep_text else []),
                    F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard", "slot"))


def op9_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole texts, in 16 shards of near equal bytes; sizes and checksums are those of the texts that arrived."""
    text = F.coalesce("text", F.lit(""))
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op9_histogram_sharding": op9_histogram_sharding}
SQL: dict[str, str] = {}
