"""Every registered query runs over whole tables and has its columns."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sparkmill.llm import packing, queries

from .test_groups import plain_fingerprint, roots

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op2_bpe_round_trip": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op3_vector_near_dedup": "vec_id n_links component_id kept",
    "op4_toxicity": "doc_id held_out score predicted",
    "op5_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op6_token_files": "doc_id start n_tokens ids_crc32",
    "op7_media_columns": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op8_simhash_near_dedup": "doc_id fingerprint component_id",
    "op9_histogram_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op10_language_id": "doc_id held_out lang_pred score",
}


def test_all_are_registered():
    assert set(queries.queries()) == set(COLUMNS)


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    df = queries.queries()[name](spark, SF)
    wanted = COLUMNS[name].split()
    assert df.columns[: len(wanted)] == wanted
    ids = [r[0] for r in df.select(wanted[0]).collect()]
    table, key = ("embeddings", "vec_id") if name.startswith("op3_") else ("documents", "doc_id")
    rows = [r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()]
    assert (set(ids) == set(rows)) if name.startswith("op1_") else (sorted(ids) == sorted(rows))


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name: str) -> list:
    return queries.queries()[name](spark, SF).collect()


def ids_of(file: str, text: str) -> list[int]:
    return Tokenizer.from_file(public_tokenizers.path(file)).encode(text, add_special_tokens=False).ids


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_by_value(spark, documents):
    got = {(r["doc_id"], r["piece"]): r for r in rows(spark, "op1_best_fit_packing")}
    want = {}
    for d, text in documents.items():
        ids = [*ids_of("byte_bpe_50k.json", text), 0]
        for k, (start, n) in enumerate(packing.cut(len(ids), 2048)):
            want[d, k] = (start, n, crc(ids[start : start + n]))
    assert {k: (r["start"], r["length"], r["ids_crc32"]) for k, r in got.items()} == want
    bins: dict = {}
    for r in got.values():
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(bins) <= 1 + 1.03 * sum(n for _, n, _ in want.values()) / 2048


def test_round_trip_by_value(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows(spark, "op2_bpe_round_trip"):
        ids = library.encode(documents[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_counts_by_value(spark, documents):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in rows(spark, "op5_token_counts"):
        n = len(model.encode(documents[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(documents[r["doc_id"]].encode()), n, n > 4096)


def test_token_files_by_value(spark, documents):
    got, at = {r["doc_id"]: r for r in rows(spark, "op6_token_files")}, 0
    for d in sorted(documents):
        ids = [*ids_of("byte_bpe_50k.json", documents[d]), 0]
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


def test_media_by_value(spark, documents):
    for r in rows(spark, "op7_media_columns"):
        raw = documents[r["doc_id"]].encode()
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))


def test_near_duplicates_by_value(spark, documents):
    keys = sorted(documents)
    prints = [plain_fingerprint(documents[d]) for d in keys]
    root = roots(len(keys), [(a, b) for a in range(len(keys)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    want = {d: (f"{p:016x}", keys[r]) for d, p, r in zip(keys, prints, root, strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(spark, "op8_simhash_near_dedup")} == want


def test_shards_by_value(spark, documents):
    by: dict = {}
    for r in rows(spark, "op9_histogram_sharding"):
        raw = documents[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        by.setdefault(r["shard"], []).append((r["slot"], r["size"]))
    assert set(by) <= set(range(16)) and all(sorted(s for s, _ in own) == list(range(len(own))) for own in by.values())
    sizes = [sum(n for _, n in own) for own in by.values()]
    assert max(sizes) - min(sizes) <= 2 * max(len(t.encode()) + 1 for t in documents.values())
