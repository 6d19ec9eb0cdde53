"""Near-duplicates, vectors, shards and components against brute force."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkmill.llm import sharding, simhash, vectors
from sparkmill.llm.components import components
from sparkmill.llm.skew import join_by_key

from .conftest import odd_rows, prose, with_clashes


def roots(n: int, pairs) -> list[int]:
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def plain_fingerprint(text: str | None) -> int:
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    hashes = [xxhash.xxh64(" ".join(words[k : k + 4]).encode(), seed=42).intdigest() for k in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark, odd):
    rows = [(d, t) for d, t in odd_rows() if t is None or len(t) < 5000] + [(300, prose(9, 400)), (301, prose(9, 400) + " more"), (302, prose(9, 400).upper())]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hexed(F.col("fp")).alias("fp"), "component_id").collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    assert sorted((str(r["doc_id"]), r["fp"]) for r in got) == sorted((str(d), f"{p:016x}") for (d, _), p in zip(rows, prints, strict=True))
    root = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    least = {r: min((d for (d, _), q in zip(rows, root, strict=True) if q == r and d is not None), default=None) for r in root}
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == sorted((str(d), str(least[r])) for (d, _), r in zip(rows, root, strict=True))


@pytest.mark.parametrize(("hot", "seed", "leading"), [(1 << 16, 1, None), (20, 2, 1), (1 << 16, 3, 2), (8, 4, 2), (1 << 16, 5, 3)])
def test_trie_join_links_all(spark, hot, seed, leading):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(40)]
    codes = set()
    for b in base:
        for _ in range(25):
            x = b
            for bit in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << bit
            codes.add(x)
    # codes that share a block, so that a hot group is dealt on
    codes |= {(0xABC << 52) | rng.getrandbits(52) & ~(0xFFF << 30) for _ in range(200)}
    codes = sorted(codes)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    found = simhash.links(spark.createDataFrame([(c,) for c in signed], "fp long"), hot=hot, spread=3, leading=leading).collect()
    at = {c: k for k, c in enumerate(signed)}
    want = roots(len(codes), [(a, b) for a in range(len(codes)) for b in range(a) if (codes[a] ^ codes[b]).bit_count() <= 4])
    assert all((codes[at[r["u"]]] ^ codes[at[r["v"]]]) >= 0 for r in found)
    assert roots(len(codes), [(at[r["u"]], at[r["v"]]) for r in found]) == want
    assert len(found) <= {1: 5, 2: 15, 3: 35}[leading or 1] * len(codes) * (8 if hot < 100 else 1)


def test_components(spark):
    rng = random.Random(5)
    pairs = [(k, k + 1) for k in range(0, 40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(7, 7), (900, 900), (3, 2), (2, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = roots(1000, pairs)
    assert got == {n: want[n] for p in pairs for n in p}
    assert components(spark.createDataFrame([], "u long, v long")).isEmpty()


def test_representatives(spark, odd):
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len({d for d, _ in rows}) == len(rows)
    blank = [d for d, t in rows if t is None or not t.strip()]
    assert blank == [0]
    assert sum(t == prose(3, 150) for _, t in rows) <= 1


def test_representatives_are_whole_rows(spark):
    """One row of each component, with the values of columns that could clash."""
    rows = [(d, t, f"id {k % 3}", f"key {d}", f"of {d}", "row") for k, (d, t) in enumerate(odd_rows())]
    rows += [(400, prose(9, 400), "a", "b", "c", "d"), (400, prose(9, 400) + " more", "e", "f", "g", "h"), (None, prose(9, 400) + " less", "i", "j", "k", "l"), (500, "one more text", "x", "x", "x", "x"), (500, "one more text", "x", "x", "x", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _key string, _of_id string, _row string").repartition(3)
    prints = [simhash.fingerprint(r[1]) & (1 << 64) - 1 for r in rows]
    root = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    key = {r["text"]: r["k"] for r in docs.select("text", F.xxhash64("text").alias("k")).collect()}
    got = [tuple(r) for r in simhash.representatives(docs).collect()]
    want = defaultdict(list)
    for r, own in zip(rows, root, strict=True):
        want[own].append(r)
    first = {own: min((r[0] is None, r[0] or 0, key[r[1]]) for r in every) for own, every in want.items()}
    assert len(got) == len(want) and set(got) <= set(rows)
    assert sorted((r[0] is None, r[0] or 0, key[r[1]]) for r in got) == sorted(first.values())


def test_repeated_rows_leave_others_where_they_are(spark, tmp_path):
    """Without repeated rows texts are neither shuffled nor grouped."""
    spark.createDataFrame([(k, prose(k, 60)) for k in range(50)], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    kept = simhash.representatives(spark.read.parquet(str(tmp_path / "docs")))
    assert "Exchange hashpartitioning(doc_id" not in kept._jdf.queryExecution().toString() and kept.count() == 50


def test_nodes_go_down_together():
    """Pairs of nodes are pruned by differing bits, not compared."""
    rng = np.random.default_rng(3)
    codes = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    codes = np.unique(np.concatenate([codes, codes[:300] ^ np.uint64(1 << 40 | 1 << 7)]))
    compared, real = [], simhash._compare

    def counted(codes, a, b, c, d, same, budget):
        compared.append(int(((b - a) * (d - c)).sum()))
        return real(codes, a, b, c, d, same, budget)

    simhash._compare = counted
    try:
        pairs = {(int(i), int(j)) for x, y in simhash.trie_join(codes, np.array([0, len(codes)]), None, 4, 64) for i, j in zip(x, y, strict=True)}
    finally:
        simhash._compare = real
    want = {(i, j) for i in range(len(codes)) for j in np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= 4).tolist() if i < j}
    assert pairs == want and len(want) >= 300
    # a random pair stays within 4 bits through 11 levels in 27 of 100 cases
    assert sum(compared) < 0.25 * len(codes) ** 2 / 2 and len(compared) > 10


@pytest.mark.parametrize("total", [10, 100_000])
def test_join_by_key(spark, total):
    left = spark.range(5000).select(F.when(F.col("id") < 2000, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("m")).where("k <> 3000")
    got = sorted(map(tuple, join_by_key(left, right, "k", "n", total).collect()))
    assert got == sorted((1 if v < 2000 else v, v, 0 if v < 2000 else v) for v in range(5000) if v != 3000)


def test_empty_groups(spark, none):
    assert simhash.near_duplicates(none).isEmpty()
    assert simhash.representatives(none).isEmpty()
    assert sharding.shard(none).isEmpty()
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).isEmpty()


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 64))
    rows = []
    for k in range(300):
        v = base[k % 30] + rng.standard_normal(64) * rng.choice([0.1, 0.25, 0.3, 2.0])
        rows.append((k, [float(x) for x in np.float32(v)], k % 3))
    rows += [(1000 + k, rows[0][1], 0) for k in range(20)] + [(1100, rows[0][1], 1), (1101, rows[0][1], None), (1102, None, 0), (1103, [0.0] * 64, 0),
             (1104, [float("nan")] + [1.0] * 63, 0), (1105, [None] + [1.0] * 63, 0), (1106, [float("inf")] + [1.0] * 63, 0), (1107, [1.0, 2.0], 0), (1108, [2.0, 4.0], 0), (None, rows[0][1], 0), (1000, rows[0][1], 0)]
    df = with_clashes(spark.createDataFrame([(i, v, y) for i, v, y in rows], "vec_id long, embedding array<float>, y int")).withColumn("label", F.col("y")).repartition(4)
    got = defaultdict(list)
    for r in vectors.near_vectors(df, block=64).collect():
        got[r["vec_id"]].append((r["n_links"], r["component_id"], r["kept"]))
    good = [(i, np.array(v, float), y) for i, v, y in rows if i is not None and v is not None and y is not None and None not in v and np.isfinite(v).all() and any(v)]
    near = lambda a, b: len(a[1]) == len(b[1]) and a[2] == b[2] and a[1] @ b[1] / np.sqrt((a[1] @ a[1]) * (b[1] @ b[1])) >= 0.93
    pairs = [(a, b) for a in range(len(good)) for b in range(a) if near(good[a], good[b])]
    root, n = roots(len(good), pairs), [0] * len(good)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    least = {r: min(good[k][0] for k in range(len(good)) if root[k] == r) for r in root}
    want = defaultdict(list)
    for k, g in enumerate(good):
        want[g[0]].append((n[k], least[root[k]], g[0] == least[root[k]]))
    for i, v, y in rows:
        if not any(i == g[0] for g in good):
            want[i].append((0, i, True))
    missed = sum(sum(x[0] for x in want[i]) - sum(x[0] for x in got[i]) for i in want)
    assert missed <= 0.02 * 2 * len(pairs) and all(got[i][0][0] <= max(x[0] for x in want[i]) for i in want)
    assert sum(sorted(got[i], key=str) != sorted(want[i], key=str) for i in want) <= 0.05 * len(want)
    assert sum(map(len, got.values())) == len(rows)


def test_vectors_of_any_finite_size(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal(16)
    rows = [(k, [float(x) for x in (base + 0.01 * rng.standard_normal(16)) * scale], 0) for k, scale in enumerate([1e200, 1e-200, 1.0, 1e300, 5e-324 * 2**60])]
    rows.append((9, [float(x) for x in rng.standard_normal(16) * 1e250], 0))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: (4, 0), 1: (4, 0), 2: (4, 0), 3: (4, 0), 4: (4, 0), 9: (0, 9)}


def test_window_threshold_keeps_recall():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((4000, 64))
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.9301 * x + np.sqrt(1 - 0.9301**2) * side
    found = sum(k in set(j.tolist()) for a in range(0, 4000, 200) for k, j in vectors.linked(x[a : a + 200], y[a : a + 200], 0.93))
    assert found >= 0.97 * 4000


def test_sharding(spark, odd):
    rows = sharding.shard(odd, shards=4, range_rows=5).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in rows) == sorted(map(str, odd_rows()))
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode()) + 1
        by[r["shard"]].append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    assert set(by) <= set(range(4))


def test_shards_are_even_and_keep_groups(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "the same text every time").otherwise(F.repeat(F.sha2(F.col("id").cast("string"), 256), F.pmod(F.xxhash64("id"), F.lit(9)).cast("int") + 1)).alias("text"))
    got = sharding.shard(docs.repartition(5), range_rows=200).groupBy("shard").agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.max("slot").alias("last")).collect()
    sizes = [r["n"] for r in got]
    assert len(sizes) == 16 and max(sizes) < 1.03 * min(sizes)
    assert all(r["last"] == r["rows"] - 1 for r in got)
    few = docs.where("id >= 1990") if "id" in docs.columns else docs.where("doc_id >= 1990")
    split = sharding.shard(few, range_rows=200).where("text = 'the same text every time'").select("shard").distinct().count()
    assert split == 1


def test_one_row_many_times_is_numbered_in_parts(spark):
    docs = spark.range(9000).select(F.when(F.col("id") < 5000, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 5000, "again and again").otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("text")).repartition(4)
    got = sharding.shard(docs, shards=4, range_rows=300)
    plan = got._jdf.queryExecution().toString()
    assert "_part" in plan
    by = defaultdict(list)
    for r in got.collect():
        by[r["shard"]].append(r["slot"])
    assert all(sorted(own) == list(range(len(own))) for own in by.values()) and sum(map(len, by.values())) == 9000


def test_splitters_like_plain_counting(spark):
    """Each shard's bytes are those between its splitters, and no splitter could be a row nearer."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.pmod(F.xxhash64("id"), F.lit(90)).cast("int")).alias("text")).repartition(3)
    rows = sharding.shard(docs, shards=5, tolerance=1e-9, group_tolerance=0.0, range_rows=100).collect()
    order = {r["doc_id"]: (r["h"], r["doc_id"]) for r in docs.select("doc_id", (F.xxhash64("text")).alias("h")).collect()}
    rows.sort(key=lambda r: order[r["doc_id"]])
    assert [r["shard"] for r in rows] == sorted(r["shard"] for r in rows)
    assert [r["slot"] for r in rows] == [k for s in range(5) for k in range(sum(r["shard"] == s for r in rows))]
    total, at = sum(r["size"] for r in rows), 0
    for s in range(4):
        own = [r["size"] for r in rows if r["shard"] == s]
        at += sum(own)
        assert abs(at - total * (s + 1) / 5) <= max(r["size"] for r in rows) / 2 + 1
