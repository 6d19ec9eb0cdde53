"""BPE encoding and decoding by a distinct-word table (operator 2).

The normaliser of the file turns white space into single spaces, and no
pre-token holds one, so the words of a normalised text are what stands between
spaces.  Each distinct word of the corpus is encoded once and gets a number in its
bucket; the distinct words' ids are rows of a table that is joined with the table
of pieces, id by id, which decodes them.  Ids and pieces then come back to every
place where the word stands.  The library puts one space between all pieces of a
file without decoder, so a text is its words' pieces with a space between.

Null, empty and blank texts have no ids and decode to the empty text.  Repeated
rows and null ids are encoded like others.  An empty table gives an empty
result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import worddict
from .bytebpe import pack_ids, unpack_ids
from .scratch import bucketed, table

#: Letters on whose classes and cases all Unicode versions agree; no separators that only Python takes for space.
_PLAIN = re.compile(r"[\x00-\x1b\x20-ɏ]*\Z")
#: Rows of a piece each that are packed at a time.
CHUNK_ROWS = 200_000
#: In front of a word that is a special token's string; words hold no space.
_SPECIAL = " "


class WordBpe:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.found = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else re.compile("(?!)")

    def words(self, text: str) -> list[str]:
        """The words of a text, normalised; special strings stand alone."""
        if _PLAIN.match(text) and not self.found.search(text):
            return text.lower().split()
        out = []
        for k, part in enumerate(self.found.split(text)):
            if k % 2:
                out.append(_SPECIAL + part)
            elif part:
                out += [w for w in self.library.normalizer.normalize_str(part).split(" ") if w]
        return out

    def _odd(self, word: str) -> list[int]:
        """A word for which encode() would see a special string or normalise again."""
        if word[0] == _SPECIAL:
            return [self.special[word[1:]]]
        return [t.id for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(word) for t in self.library.model.tokenize(piece)]

    def encode(self, words: list[str]) -> list[list[int]]:
        odd = [w[0] == _SPECIAL or bool(self.found.search(w)) or not _PLAIN.match(w) for w in words]
        usual = iter(self.library.encode_batch([w for w, o in zip(words, odd, strict=True) if not o], add_special_tokens=False))
        return [self._odd(w) if o else next(usual).ids for w, o in zip(words, odd, strict=True)]

    def pieces(self) -> list[tuple[int, str]]:
        """The table id to piece."""
        return sorted((i, piece) for piece, i in self.library.get_vocab(with_added_tokens=True).items())


_files: dict = {}


def word_bpe(path: str) -> WordBpe:
    if path not in _files:
        _files[path] = WordBpe(path)
    return _files[path]


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(map(len, ids), np.uint32, len(ids)), np.fromiter(chain.from_iterable(ids), np.uint32)


def _packed(ids: list[list[int]]) -> bytes:
    return _packed_flat(*_flat(ids))


def _packed_flat(sizes: np.ndarray, flat: np.ndarray) -> bytes:
    head = worddict.pack(sizes)
    return len(head).to_bytes(4, "little") + head + pack_ids(flat, worddict.LEVEL)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    end = 4 + int.from_bytes(data[:4], "little")
    return worddict.unpack(data[4:end]), unpack_ids(data[end:])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row."""
    held = worddict.blocks(docs, lambda: word_bpe(path).words, False, id_col, text_col)
    found = worddict.answers(worddict.asked(held, worddict.buckets_of(held)), lambda: word_bpe(path).encode, _packed)

    def finish(row):
        by_word, seq = np.empty(row["n_distinct"], object), worddict.unpack(row["seq"])
        for record in row["found"]:
            sizes, flat = _unpacked(record["answers"])
            ends = np.cumsum(sizes, dtype=np.int64).tolist()
            for word, a, b in zip(worddict.numbers_of(record["numbers"]).tolist(), [0, *ends], ends, strict=False):
                by_word[word] = flat[a:b]
        ends = np.cumsum(row["n_words"]).tolist()
        ids = [np.concatenate(by_word[seq[a:b]]).astype(np.int32) if b > a else np.empty(0, np.int32) for a, b in zip([0, *ends], ends, strict=False)]
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(row["doc_id"], pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return worddict.met(held, found, finish, "doc_id long, ids array<int>")


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """id and piece, one row for each id of the vocabulary."""
    return spark.createDataFrame(word_bpe(path).pieces(), "id int, piece string").coalesce(1)


def with_pieces(coded: DataFrame, key: list[str], path: str) -> DataFrame:
    """key, at, id and piece of each place of column ids, by a join with the table of pieces; one row of nulls where there is no id.

    The table has a row for each id of the vocabulary, which bounds what is broadcast, so rows stay in place and in order.
    """
    return coded.select(*key, F.posexplode_outer("ids").alias("at", "id")).join(F.broadcast(piece_table(coded.sparkSession, path)), "id", "left").select(*key, "at", "id", "piece")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids."""
    rows = encoded.select("doc_id", "ids").withColumn("row", F.monotonically_increasing_id())
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), " ")
    return with_pieces(rows, ["row", "doc_id"], path).groupBy("row").agg(F.first("doc_id").alias("doc_id"), text.alias("text")).select("doc_id", "text")


def _distinct(words: DataFrame, buckets: int, path: str) -> DataFrame:
    """What asked() gives, as references to distinct words, and these words: bucket, block and numbers (null for
    distinct words), refs (numbers in the bucket), first (number of the first new word) and ids (of the new words)."""

    def run(batches):
        ask, known, bucket = word_bpe(path).encode, worddict.Numbers(), None
        for batch in batches:
            for own, block, numbers, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "numbers", "words")), strict=True):
                if own != bucket:
                    bucket, known = own, worddict.Numbers()
                first = len(known)
                refs = np.fromiter(map(known.__getitem__, found := worddict.unpack_words(data)), np.uint32)
                new = [w for w, r in zip(found, refs.tolist(), strict=True) if r >= first]
                sizes, flat = _flat(ask(new))
                ids = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), flat.astype(np.int32))
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([own, own], pa.int32()), "block": pa.array([block, None], pa.int64()), "numbers": pa.array([numbers, None], pa.binary()),
                    "refs": pa.array([worddict.pack(refs), None], pa.binary()), "first": pa.array([None, first], pa.int32()), "ids": pa.ListArray.from_arrays(pa.array([None, 0, len(ids)], pa.int32()), ids)})

    # a task has whole buckets, so it writes one file for each, and what follows finds them in place
    return bucketed(words.mapInArrow(run, "bucket int, block long, numbers binary, refs binary, first int, ids array<array<int>>"), "distinct-words", "bucket", buckets)


def _decoded(distinct: DataFrame, path: str) -> DataFrame:
    """bucket, refs, ids and pieces (packed, many words to a row) of all distinct words, which stay in their buckets."""
    words = distinct.where("block is null").select("bucket", "first", F.posexplode("ids").alias("k", "ids"))
    rows = with_pieces(words.select("bucket", (F.col("first") + F.col("k")).alias("n"), "ids"), ["bucket", "n"], path)

    def packed(batch):
        bucket, n, at = (batch.column(c).to_numpy() for c in ("bucket", "n", "at_"))
        starts = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1) | np.diff(n, prepend=n[0] - 1))
        if (at != np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))).any():
            raise RuntimeError("the pieces of a word are not in order")
        some = pc.is_valid(batch.column("id"))
        sizes = np.add.reduceat(some.to_numpy(zero_copy_only=False).astype(np.int64), starts)
        runs = np.flatnonzero(np.diff(bucket[starts], prepend=bucket[0] - 1))
        for a, b in zip(runs.tolist(), [*runs[1:].tolist(), len(starts)], strict=True):
            own = bucket[starts[a]]
            part = slice(int(starts[a]), int(starts[b]) if b < len(starts) else len(at))
            rows = batch.slice(part.start, part.stop - part.start).filter(some.slice(part.start, part.stop - part.start))
            ends = np.concatenate([[0], np.cumsum(sizes[a:b])]).astype(np.int32)
            text = pc.binary_join(pa.ListArray.from_arrays(ends, rows.column("piece")), " ").cast(pa.binary())
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([int(own)], pa.int32()), "refs": pa.array([worddict.pack(n[starts[a:b]])], pa.binary()),
                "ids": pa.array([_packed_flat(sizes[a:b].astype(np.uint32), rows.column("id").to_numpy().astype(np.uint32))], pa.binary()), "pieces": pa.array([worddict.pack_raw(text.to_pylist())], pa.binary())})

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= CHUNK_ROWS:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                bucket, n = whole.column("bucket").to_numpy(), whole.column("n").to_numpy()
                last = int(np.flatnonzero((bucket != bucket[-1]) | (n != n[-1]))[-1]) + 1 if bucket[0] != bucket[-1] or n[0] != n[-1] else 0
                if last:
                    yield from packed(whole.slice(0, last))
                held, size = [whole.slice(last)], len(bucket) - last
        if held:
            yield from packed(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return rows.select("bucket", "n", F.coalesce("at", F.lit(0)).alias("at_"), "id", "piece").mapInArrow(run, "bucket int, refs binary, ids binary, pieces binary")


class _Words:
    """The ids and pieces of one bucket's words, by number."""

    def __init__(self, chunks: list[tuple[bytes, bytes, bytes]]):
        refs, sizes, flat, text = [], [], [], []
        for r, i, p in chunks:
            refs.append(worddict.unpack(r))
            n, ids = _unpacked(i)
            sizes.append(n)
            flat.append(ids)
            text += worddict.unpack_raw(p)
        order = np.argsort(np.concatenate(refs), kind="stable")
        sizes, self.flat = np.concatenate(sizes).astype(np.int64), np.concatenate(flat)
        self.sizes, self.starts = sizes[order], (np.cumsum(sizes) - sizes)[order]
        self.text = [text[k] for k in order.tolist()]

    def of(self, refs: np.ndarray) -> tuple[bytes, bytes]:
        sizes = self.sizes[refs]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[refs] - (ends - sizes), sizes)
        return _packed_flat(sizes.astype(np.uint32), self.flat[at]), worddict.pack_raw([self.text[k] for k in refs.tolist()])


def _returned(distinct: DataFrame, buckets: int, path: str) -> DataFrame:
    """block, numbers, ids and pieces (packed) of each record of asked()."""
    none = {"block": "long", "numbers": "binary", "ids": "binary", "pieces": "binary"}
    words = _decoded(distinct, path).withColumns({c: F.lit(None).cast(none[c]) for c in ("block", "numbers")})
    refs = distinct.where("block is not null").select("bucket", "block", "numbers", "refs").withColumns({c: F.lit(None).cast(none[c]) for c in ("ids", "pieces")})
    # a bucket's words come before the references to them
    every = words.unionByName(refs).repartition(buckets, "bucket").sortWithinPartitions("bucket", F.col("block").asc_nulls_first())

    def run(batches):
        bucket, chunks, words = None, [], None
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for own, block, numbers, refs, ids, pieces in ([batch.column(c)[k].as_py() for c in ("bucket", "block", "numbers", "refs", "ids", "pieces")] for k in range(batch.num_rows)):
                if own != bucket:
                    bucket, chunks, words = own, [], None
                if block is None:
                    chunks.append((refs, ids, pieces))
                    continue
                words = words or _Words(chunks)
                for to, x in zip(out, (block, numbers, *words.of(worddict.unpack(refs))), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "numbers", "ids", "pieces"])

    return every.mapInArrow(run, "block long, numbers binary, ids binary, pieces binary")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of decimal ids and of the decoded text, each document put together from its
    words' ids and decoded pieces."""
    held = worddict.blocks(docs, lambda: word_bpe(path).words, False, id_col, text_col)
    buckets = worddict.buckets_of(held)
    found = _returned(_distinct(worddict.asked(held, buckets), buckets, path), buckets, path)

    def finish(row):
        n, seq = row["n_distinct"], worddict.unpack(row["seq"])
        lengths, numbers, decoded = np.zeros(n, np.int64), [b""] * n, [b""] * n
        while row["found"]:
            record = row["found"].pop()
            sizes, flat = _unpacked(record["ids"])
            ends, decimal = np.cumsum(sizes, dtype=np.int64).tolist(), [b"%d" % i for i in flat.tolist()]
            own = worddict.numbers_of(record["numbers"])
            lengths[own] = sizes
            for word, a, b, text in zip(own.tolist(), [0, *ends], ends, worddict.unpack_raw(record["pieces"]), strict=False):
                numbers[word], decoded[word] = b" ".join(decimal[a:b]), text
        some = lengths > 0  # a word without ids leaves no space
        ends, out = np.cumsum(row["n_words"]).tolist(), ([], [], [])
        for a, b in zip([0, *ends], ends, strict=False):
            own = seq[a:b]
            n = int(lengths[own].sum())
            own = (own if n and some[own].all() else own[some[own]]).tolist()
            out[0].append(n)
            for to, words in ((out[1], numbers), (out[2], decoded)):
                to.append(hashlib.sha256(b" ".join(map(words.__getitem__, own))).hexdigest())
        return pa.RecordBatch.from_arrays([pa.array(row["doc_id"], pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1]), pa.array(out[2])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return worddict.met(held, found, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document."""
    import public_tokenizers as p

    return digests(table(spark, sf_dir, "documents"), p.path("word_bpe_49k.json"))


QUERIES = {"op2_bpe_round_trip": op2_bpe_round_trip}
SQL: dict[str, str] = {}
