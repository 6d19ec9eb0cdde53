"""A table of distinct words, and the way of its answers back to the documents.

1. Documents are split into words once, in blocks of bounded size.  A block
   holds its distinct words once and its documents as numbers of those words.
   All blocks are one written table.
2. Words are dealt by hash into buckets of about BUCKET_WORDS distinct words of
   the corpus (an estimate from the blocks' least hashes sets their number, no
   matter how many partitions a shuffle has), and a block sends each bucket one
   packed record.  A bucket's records come one after another, so every distinct
   word of the whole corpus is looked up in one task, once, and a task holds the
   words of one bucket at a time.  A word that stands in every document comes
   once from each block: no word is hot.
3. The answers return to their block with the block's word numbers and meet the
   documents there; the table is bucketed by block, so documents stay in place.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bucketed

BLOCK_BYTES, BLOCK_WORDS, BUCKET_WORDS = 16 << 20, 500_000, 500_000
#: Words that a record should hold at least, where there are blocks enough for that; and one hash in so many is kept for the estimate.
RECORD_WORDS, KEPT_HASHES = 256, 512
#: Of the compression of words, which are what moves most.
LEVEL = 9


def pack(numbers: np.ndarray) -> bytes:
    """uint32 values as four byte planes, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def pack_words(words: list[str]) -> bytes:
    return pack_raw([w.encode() for w in words])


def pack_raw(raw: list[bytes]) -> bytes:
    import zstandard

    # a byte that UTF-8 never has stands between
    return zstandard.ZstdCompressor(level=LEVEL).compress(len(raw).to_bytes(4, "little") + b"\xff".join(raw))


def unpack_raw(data: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    return raw[4:].split(b"\xff") if raw[:4] != bytes(4) else []


def unpack_words(data: bytes) -> list[str]:
    return [w.decode() for w in unpack_raw(data)]


class Numbers(dict):
    """Words get numbers in the order in which they first occur."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def blocks(docs: DataFrame, split: Callable[[], Callable[[str], list[str]]], counted: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The block table.  split() gives, on a worker, the function from a text to its words.

    counted: a document is its distinct words and their counts, else its words in order.
    """
    def run(batches):
        from pyspark import TaskContext

        words_of, part, made = split(), TaskContext.get().partitionId(), 0
        ids, sizes, lengths, seqs, counts, held, known = [], [], [], [], [], 0, Numbers()

        def closed():
            words, joined = list(known), lambda x: np.concatenate(x) if x else np.empty(0, np.uint32)
            kept = [h for w in words if not (h := zlib.crc32(w.encode())) % KEPT_HASHES]
            return pa.RecordBatch.from_pydict({
                "block": [(part << 32) + made], "doc_id": pa.array([ids], pa.list_(pa.int64())), "n_bytes": pa.array([sizes], pa.list_(pa.int64())),
                "n_words": pa.array([lengths], pa.list_(pa.int64())), "seq": pa.array([pack(joined(seqs))], pa.binary()), "counts": pa.array([pack(joined(counts))], pa.binary()),
                "n_distinct": pa.array([len(words)], pa.int64()), "kept": pa.array([kept], pa.list_(pa.int64())), "words": pa.array([pack_words(words)], pa.binary())})

        for batch in batches:
            for doc, size, text in zip(batch.column(0).to_pylist(), pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py() or "")
                seq = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
                if counted:
                    seq, n = np.unique(seq, return_counts=True)
                    counts.append(n.astype(np.uint32))
                    # gaps are small numbers
                    seq = np.diff(seq, prepend=np.uint32(0))
                ids.append(doc)
                sizes.append(size)
                lengths.append(len(seq))
                seqs.append(seq)
                held += size
                if held >= BLOCK_BYTES or len(known) >= BLOCK_WORDS:
                    yield closed()
                    ids, sizes, lengths, seqs, counts, held, known, made = [], [], [], [], [], 0, Numbers(), made + 1
        if ids:
            yield closed()

    schema = "block long, doc_id array<long>, n_bytes array<long>, n_words array<long>, seq binary, counts binary, n_distinct long, kept array<long>, words binary"
    return bucketed(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema), "word-blocks", "block")


def buckets_of(table: DataFrame) -> int:
    """How many buckets the words of these blocks need."""
    blocks, words = table.agg(F.count("*"), F.sum("n_distinct")).first()
    distinct = KEPT_HASHES * table.select(F.explode("kept").alias("h")).agg(F.count_distinct("h")).first()[0]
    cores = 4 * table.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-distinct // BUCKET_WORDS), min(cores, (words or 0) // max(1, blocks) // RECORD_WORDS))


def asked(table: DataFrame, buckets: int) -> DataFrame:
    """bucket, block, numbers (of the words in their block), words; bucket by bucket in each task."""

    def run(batches):
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = unpack_words(data.as_py())
                of = np.fromiter((zlib.crc32(w.encode()) // KEPT_HASHES % buckets for w in words), np.int64, len(words))
                order = np.argsort(of, kind="stable")
                ends = np.cumsum(np.bincount(of, minlength=buckets))
                out = [(k, order[a:b]) for k, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)) if b > a]
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([k for k, _ in out], pa.int32()), "block": pa.array([block] * len(out), pa.int64()),
                    "numbers": pa.array([pack(np.diff(own, prepend=0)) for _, own in out], pa.binary()), "words": pa.array([pack_words([words[i] for i in own.tolist()]) for _, own in out], pa.binary())})

    dealt = table.select("block", "words").mapInArrow(run, "bucket int, block long, numbers binary, words binary")
    return dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket")


def answers(words: DataFrame, look_up: Callable[[], Callable[[list[str]], Iterable]], packed: Callable[[list], bytes]) -> DataFrame:
    """block, numbers and answers (packed) of each record of asked().

    look_up() gives, on a worker, the function from distinct words to their answers.
    """

    def run(batches):
        ask, known, bucket = look_up(), {}, None
        for batch in batches:
            out = []
            for own, data in zip(batch.column("bucket").to_pylist(), batch.column("words"), strict=True):
                if own != bucket:
                    bucket, known = own, {}
                found = unpack_words(data.as_py())
                new = [w for w in found if w not in known]
                known.update(zip(new, ask(new), strict=True))
                out.append(packed([known[w] for w in found]))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("numbers"), pa.array(out, pa.binary())], names=["block", "numbers", "answers"])

    return words.mapInArrow(run, "block long, numbers binary, answers binary")


def numbers_of(data: bytes) -> np.ndarray:
    """The word numbers of a record, which are packed as gaps."""
    return np.cumsum(unpack(data), dtype=np.int64)


def met(table: DataFrame, found: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """finish(block as a dict) -> record batch, for every block; its `found` holds the records that came back, without their block."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # one block at a time
                row = batch.slice(k, 1).to_pylist()[0]
                yield finish(row | {"found": row["found"] or []})

    back = found.groupBy("block").agg(F.collect_list(F.struct(*(c for c in found.columns if c != "block"))).alias("found"))
    return table.drop("words", "kept").join(back.hint("shuffle_hash"), "block", "left").mapInArrow(run, schema)


def sums(values: np.ndarray, lengths: list[int]) -> np.ndarray:
    """Sums of so many values each."""
    ends = np.cumsum(lengths)
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ends] - total[ends - lengths]
