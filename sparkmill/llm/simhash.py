"""SimHash near-duplicates by a self-join of binary tries (operator 8).

Fingerprints within ``budget`` bits agree in at least k of budget + k blocks of
the 64 bits.  For each choice of k blocks the distinct fingerprints are turned so
that these lead, and the trie of the turned values is joined with itself below
the nodes of a short lead: of so many bits that about NODE fingerprints share
one, and never more than the k blocks have.  Pairs of trie nodes go down
together, differing bits add up, and a pair of nodes ends as soon as they exceed
the budget.  Only pairs of at most two by two fingerprints are compared as they
are.

A node that more than HOT fingerprints share is dealt on as pairs of the nodes
SPREAD bits below it, again within the budget, and those that are still too
large once more, until no group is.  k grows with the number of fingerprints, so
that the leads can stay about as long as its logarithm.

Tasks return a spanning forest of the links that they find, at most one link
for each fingerprint, never all pairs of a group of near copies.  Components
are then found by star contraction and carried back to the documents; what very
many documents or fingerprints share is broadcast, not shuffled.

Null, empty and blank texts have fingerprint zero and are linked like others.
Repeated rows share one fingerprint.  A null doc_id never names a component.
An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .scratch import materialise, table, unused
from .skew import join_by_key

BUDGET, WORDS, SEED = 4, 4, 42
#: Fingerprints below a lead, about; a group larger than HOT is dealt on by SPREAD more bits; pairs of nodes of LEAF or fewer pairs are compared at once.
NODE, HOT, SPREAD, LEAF, AT_ONCE = 64, 65_536, 4, 4, 1 << 21
#: Up to so many fingerprints one block leads, up to so many two, beyond them three.
MANY = (1 << 23, 1 << 31)

_SET = np.array([[v >> (7 - b) & 1 for b in range(8)] for v in range(256)], np.int64)


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Signed 64-bit SimHash over shingles of so many words, repeats included."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII spaces alone
    if not found:
        return 0
    ones, n = np.zeros((8, 8), np.int64), max(1, len(found) - words + 1)
    line, ends, at = b" ".join(found), [], -1
    for w in found:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    for k in range(0, n, 1 << 16):  # bounded memory for texts of any length
        hashes = [xxh64_intdigest(line[starts[i] : ends[min(i + words, len(found)) - 1]], seed) for i in range(k, min(n, k + (1 << 16)))]
        bytes_ = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
        for b in range(8):
            ones[b] += np.bincount(bytes_[:, b], minlength=256) @ _SET
    return int(np.packbits((2 * ones > n).astype(np.uint8).ravel()).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, text_key (a hash of the text) and fp (a signed long) of every row."""

    def run(batches):
        for batch in batches:
            got = [fingerprint(t.as_py(), **how) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.int64())], names=["doc_id", "text_key", "fp"])

    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text).mapInArrow(run, "doc_id long, text_key long, fp long")


def _children(low, high, ones):
    """The border between the 0 and the 1 half of sorted ranges of one trie level."""
    return high - (ones[high] - ones[low])


def trie_join(codes: np.ndarray, groups: np.ndarray, sides: np.ndarray | None, budget: int, depth: int, leaf: int = LEAF):
    """Yields (i, j) index arrays of pairs within budget; codes are sorted within each group.

    groups: the first index of each group and, last, len(codes).  Bits above
    depth are equal within a group.  sides: where given, a group is two nodes to
    be joined with each other, the second starting at sides.
    """
    low, high = groups[:-1].astype(np.int64), groups[1:].astype(np.int64)
    if sides is None:
        frontier = [low, high, low, high, np.ones(len(low), bool)]
    else:
        frontier = [low, sides, sides, high, np.zeros(len(low), bool)]
    above = ~((1 << depth) - 1) & (1 << 64) - 1
    for bit in range(depth - 1, -2, -1):
        a, b, c, d, same = frontier
        pairs = (b - a) * (d - c)
        small = (pairs <= leaf) | (bit < 0)
        yield from _compare(codes, *(x[small] for x in frontier), budget)
        a, b, c, d, same = (x[~small] for x in frontier)
        if not len(a):
            return
        ones = np.concatenate([[0], np.cumsum(codes >> np.uint64(bit) & np.uint64(1), dtype=np.int64)])
        m, n = _children(a, b, ones), _children(c, d, ones)
        t = ~same
        parts = [(a, m, c, n, same), (m, b, n, d, same), (a, m, n, d, np.zeros_like(same)), (m[t], b[t], c[t], n[t], same[t])]
        frontier = [np.concatenate(x) for x in zip(*parts, strict=True)]
        keep = (frontier[1] > frontier[0]) & (frontier[3] > frontier[2])
        frontier = [x[keep] for x in frontier]
        # the bits above this level, which all codes of a node share, differ in so many places
        above |= 1 << bit
        mask = np.uint64(above)
        far = np.bitwise_count((codes[frontier[0]] ^ codes[frontier[2]]) & mask) <= budget
        frontier = [x[far] for x in frontier]


def _compare(codes, a, b, c, d, same, budget):
    pairs = (b - a) * (d - c)
    ends = np.cumsum(pairs)
    start = 0
    while start < len(a):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
        own = np.repeat(np.arange(start, stop), pairs[start:stop])
        place = np.arange(len(own)) - np.repeat(ends[start:stop] - pairs[start:stop] - done, pairs[start:stop])
        wide = (d - c)[own]
        i, j = a[own] + place // wide, c[own] + place % wide
        near = (~same[own] | (i < j)) & (np.bitwise_count(codes[i] ^ codes[j]) <= budget)
        if near.any():
            yield i[near], j[near]
        start = stop


def forest(n: int, pairs) -> np.ndarray:
    """The least index that each of n nodes reaches."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            x, y = root[i], root[j]
            open_ = x != y
            if not open_.any():
                break
            i, j, x, y = i[open_], j[open_], x[open_], y[open_]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def _turns(budget: int, leading: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Orders of blocks (place from the top, width) and the width of their lead, for every choice of leading blocks."""
    n = budget + leading
    cuts = [64 * k // n for k in range(n + 1)]
    blocks = [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    out = []
    for chosen in combinations(range(n), leading):
        order = [blocks[k] for k in chosen] + [b for k, b in enumerate(blocks) if k not in chosen]
        out.append((order, sum(w for _, w in order[:leading])))
    return out


def _turned(fp, order: list[tuple[int, int]]):
    at, parts = 64, []
    for a, w in order:
        at -= w
        parts.append(F.shiftleft(F.shiftrightunsigned(fp, 64 - a - w).bitwiseAND(F.lit((1 << w) - 1).cast("long")), at))
    return reduce(lambda x, y: x.bitwiseOR(y), parts)


def _back(codes: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    at, out = 64, np.zeros_like(codes)
    for a, w in order:
        at -= w
        out |= (codes >> np.uint64(at) & np.uint64((1 << w) - 1)) << np.uint64(64 - a - w)
    return out


def links(fps: DataFrame, budget: int = BUDGET, hot: int = HOT, spread: int = SPREAD, leading: int | None = None, node: int = NODE) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints within budget bits of each other.

    fps: one column fp of distinct longs, materialised.
    """
    n = fps.count()
    if leading is None:
        leading = 1 + sum(n > most for most in MANY)
    turns = _turns(budget, leading)
    short = max(0, (n // node).bit_length())
    codes = fps.select(F.explode(F.array(*(F.struct(F.lit(k).alias("turn"), F.lit(min(lead, short)).alias("width"), _turned(F.col("fp"), order).alias("code")) for k, (order, lead) in enumerate(turns)))).alias("x")).select("x.*")
    # a group is a pair of trie nodes: their depth and values; the rows of the second have side 1
    key = ["turn", "width", "a", "b"]
    node_of = lambda width: F.when(width == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.col("code"), 64 - width))
    opened, groups = codes.select("turn", "width", node_of(F.col("width")).alias("a"), node_of(F.col("width")).alias("b"), F.lit(0).alias("side"), "code"), []
    while True:
        large = materialise(opened.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > hot).select(*key), "hot-nodes")
        if large.isEmpty():
            groups.append(opened)
            break
        # every large group has over hot rows, so there are few of them
        groups.append(opened.join(large, key, "left_anti"))
        own = opened.join(large, key, "left_semi").withColumn("more", F.least(F.lit(spread), 64 - F.col("width")))
        down = node_of(F.col("width") + F.col("more"))
        base = F.call_function("shiftleft", F.when(F.col("side") == 0, F.col("b")).otherwise(F.col("a")), F.col("more"))
        own = own.withColumn("down", down).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("more")) - 1)))
        own = own.withColumn("other", base.bitwiseOR(F.col("other"))).where(F.bit_count(F.col("down").bitwiseXOR(F.col("other"))) <= budget)
        opened = materialise(own.select("turn", (F.col("width") + F.col("more")).alias("width"), F.least("down", "other").alias("a"), F.greatest("down", "other").alias("b"), (F.col("down") > F.col("other")).cast("int").alias("side"), "code"), "dealt-nodes")
    dealt = reduce(DataFrame.unionByName, groups).repartition(*key).sortWithinPartitions(*key, "side")

    def run(batches):
        held: list = []
        for batch in batches:
            x = {c: batch.column(c).to_numpy() for c in (*key, "side", "code")}
            held.append(x)
            # no group is larger than hot, so what is carried on stays small
            if sum(len(h["code"]) for h in held) >= (1 << 20) + hot:
                joined = {c: np.concatenate([h[c] for h in held]) for c in x}
                last = _last_group(joined)
                if last:
                    yield from linked({c: v[:last] for c, v in joined.items()})
                held = [{c: v[last:] for c, v in joined.items()}]
        if held:
            yield from linked({c: np.concatenate([h[c] for h in held]) for c in held[0]})

    def _last_group(x):
        same = np.ones(len(x["code"]), bool)
        for c in key:
            same &= x[c] == x[c][-1]
        return int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0

    def linked(x):
        if not len(x["code"]):
            return
        new = np.zeros(len(x["code"]), bool)
        new[0] = True
        for c in key:
            new[1:] |= x[c][1:] != x[c][:-1]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(new))
        # signed order is not the order of the trie: sort each node's codes as unsigned
        codes = x["code"].view(np.uint64)
        place = np.lexsort((codes, x["side"], np.cumsum(new)))
        codes, lone, kinds = codes[place], x["a"][starts] == x["b"][starts], x["turn"][starts].astype(np.int64) << 8 | x["width"][starts] << 1
        kinds |= ~lone
        for kind in np.unique(kinds):
            own = kinds == kind
            turn, width, joined = int(kind) >> 8, int(kind) >> 1 & 127, bool(kind & 1)
            rows = np.concatenate([np.arange(s, e) for s, e in zip(starts[own], ends[own], strict=True)])
            borders = np.concatenate([[0], np.cumsum(ends[own] - starts[own])])
            sides = borders[1:] - np.add.reduceat(x["side"][rows], borders[:-1]) if joined else None
            root = forest(len(rows), trie_join(codes[rows], borders, sides, budget, 64 - width))
            far = root != np.arange(len(rows))
            order = turns[turn][0]
            u, v = _back(codes[rows][far], order), _back(codes[rows][root[far]], order)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def _classed(docs: DataFrame, budget: int, id_col: str, text_col: str, **how) -> tuple[DataFrame, int, DataFrame]:
    """The fingerprints of all rows, their number, and of each distinct one: n rows, root, and first, the component's
    least (no id, id, text_key)."""
    marked = materialise(fingerprints(docs, id_col, text_col, **how), "fingerprints")
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    fps = materialise(marked.groupBy("fp").agg(F.min(one).alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    found = materialise(components(links(fps.select("fp"), budget)), "components")
    of_root = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_root = materialise(of_root, "components")
    firsts = of_root.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("members"))
    classes = join_by_key(of_root.drop("first"), firsts, "root", "members", of_root.count())
    return marked, marked.count(), materialise(classes, "classes")


def near_duplicates(docs: DataFrame, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, text_key, fp, component_id (the least doc_id reachable) of every row."""
    marked, rows, classes = _classed(docs, budget, id_col, text_col, **how)
    named = classes.select("fp", "n", F.col("first.doc_id").alias("component_id"))
    return join_by_key(marked, named, "fp", "n", rows).select("doc_id", "text_key", "fp", "component_id")


def representatives(docs: DataFrame, budget: int = BUDGET, **how) -> DataFrame:
    """One row of docs, all columns, of each component: that of the least doc_id, and under one id of the
    least hash of the text.  Rows without id come last.  Of rows of one id and text any one stays.

    The decision is made on ids and hashes; rows move only where Spark finds the table of what goes
    too large to broadcast, and where an id and text that stays is repeated.
    """
    marked, rows, classes = _classed(docs, budget, "doc_id", "text", **how)
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    judged = join_by_key(marked, classes.select("fp", "n", "first"), "fp", "n", rows).select("doc_id", "text_key", own.eqNullSafe(F.col("first")).alias("stays"))
    counts = materialise(judged.groupBy("doc_id", "text_key", "stays").agg(F.count("*").alias("n")).where("not stays or n > 1"), "near-duplicates")
    key = lambda df: (F.col("doc_id").cast("long").eqNullSafe(df["_of_id"])) & (F.xxhash64("text") == df["_of_text"])
    named = counts.select(F.col("doc_id").alias("_of_id"), F.col("text_key").alias("_of_text"), "stays")
    gone, again = named.where("not stays").drop("stays"), named.where("stays").drop("stays")
    if again.isEmpty():
        return docs.join(gone, key(gone), "left_anti")
    once = docs.join(named.drop("stays"), key(named), "left_anti")
    whole = docs.join(again, key(again), "left_semi")
    name = unused(docs, "_row")
    firsts = whole.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(name)).groupBy(F.col(f"{name}.doc_id").alias("_of_id"), F.xxhash64(f"{name}.text").alias("_of_text")).agg(F.first(name).alias(name))
    return once.unionByName(firsts.select(f"{name}.*"))


def hexed(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", hexed("fp").alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash_near_dedup": op8_simhash_near_dedup}
SQL: dict[str, str] = {}
