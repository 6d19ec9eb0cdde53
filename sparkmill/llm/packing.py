"""Best-fit packing of token sequences (operator 1).

Texts become ids, an end id is appended, and only documents longer than a
sequence are cut: the shorter rest comes first, so all later pieces are full
and need no search.  Pieces are dealt by a hash of their row number, which no key
can make hot, into groups of about ``group_size``.  Each group is packed by a
bounded-space online best-fit: pieces come in the order of their rows and are
placed at once.  Open bins hang in lists by free space, and a bitset of the
spaces that occur gives the tightest bin by one shift and one bit scan.  When
more than ``open_bins`` are open, the fullest closes.

Nulls and empty texts: the end id alone, one piece of length 1.  A null doc_id
is a document like any other.  Repeated rows are packed as often as they occur.
An empty table gives an empty result.  Extra columns of the input are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebpe import byte_bpe_50k, encoder, pack_ids, unpack_ids
from .scratch import materialise, slices, table, unused

CAPACITY, GROUP_SIZE, OPEN_BINS = 2048, 16_384, 512
#: Pieces whose ids a task holds at a time.
AT_ONCE = 1024


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: tuple, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = True,
           id_col: str = "doc_id", text_col: str = "text", compressed: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (of little-endian uint32 ids) and, if kept, ids (these, or as pack_ids() gives them)."""

    def run(batches):
        bpe = encoder(*tokenizer)
        for batch in slices(batches, 4 * AT_ONCE):
            out: list[list] = [[], [], [], [], [], []]
            held = 0
            for doc, ids in zip(batch.column(0).to_pylist(), bpe.encode_all(batch.column(1).to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    raw = ids[start : start + n].tobytes()
                    kept = None if not keep_ids else pack_ids(ids[start : start + n]) if compressed else raw
                    row = (doc, k, start, n, zlib.crc32(raw), kept)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    held += 64 + keep_ids * len(raw)
                if held > 16 << 20:
                    yield made(out)
                    out, held = [[], [], [], [], [], []], 0
            yield made(out)

    def made(out):
        types = (kind, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
        n = 6 if keep_ids else 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:n], types, strict=False)], names=list(names[:n]))

    kind = pa.int64()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)


class BestFit:
    """place(n) -> (bin, offset) for pieces of 1 to capacity units."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.bins: list[list[int]] = [[] for _ in range(capacity)]
        self.spaces = self.open = self.made = 0

    def _take(self, free: int) -> int:
        found = self.bins[free].pop()
        self.open -= 1
        if not self.bins[free]:
            self.spaces &= ~(1 << free)
        return found

    def place(self, n: int) -> tuple[int, int]:
        if not 0 < n <= self.capacity:
            raise ValueError(f"a piece of {n} units; the capacity is {self.capacity}")
        fits = self.spaces >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            free, at = self.capacity, self.made
            self.made += 1
        if free > n:
            self.bins[free - n].append(at)
            self.spaces |= 1 << (free - n)
            self.open += 1
            if self.open > self.most:
                self._take((self.spaces & -self.spaces).bit_length() - 1)  # the fullest closes
        return at, self.capacity - free


def best_fit(parts: DataFrame, capacity: int = CAPACITY, group_size: int = GROUP_SIZE, open_bins: int = OPEN_BINS, expand: str | None = None) -> DataFrame:
    """Adds sequence_id and offset to rows of doc_id, piece, length and whatever else they carry.  expand: a column of
    compressed ids, which come out as they are.

    parts is counted once to set the number of groups: give it materialised, so
    that a row has its number again if a task is repeated.
    """
    groups = max(1, math.ceil(parts.count() / group_size))
    row, own = unused(parts, "_row"), unused(parts, "_group")
    dealt = parts.withColumn(row, F.monotonically_increasing_id()).withColumn(own, F.pmod(F.xxhash64(row), F.lit(groups)).cast("int"))
    dealt = dealt.repartitionById(groups, own).sortWithinPartitions(row)
    names = parts.columns

    def run(batches):
        group, packer = None, None
        for batch in slices(batches, AT_ONCE):
            ids, offsets = [], []
            for g, n in zip(batch.column(own).to_pylist(), batch.column("length").to_pylist(), strict=True):
                if g != group:
                    group, packer = g, BestFit(capacity, open_bins)
                at, offset = packer.place(n)
                ids.append((g << 32) + at)
                offsets.append(offset)
            columns = [batch.column(c) for c in names]
            if expand:
                columns[names.index(expand)] = pa.array([unpack_ids(x.as_py()).astype("<u4").tobytes() for x in batch.column(expand)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())],
                names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return dealt.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: tuple, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = True, **columns) -> DataFrame:
    """Documents to packed pieces, with their ids if keep_ids."""
    parts = materialise(pieces(docs, tokenizer, end_id, capacity, keep_ids, compressed=True, **columns), "pieces")
    return best_fit(parts, capacity, expand="ids" if keep_ids else None)


def digests(packed: DataFrame) -> DataFrame:
    """Packed pieces with the length and checksum of the ids that they hold, instead of the ids."""
    return packed.select("doc_id", "piece", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    return digests(pack(table(spark, sf_dir, "documents"), byte_bpe_50k()))


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing}
SQL: dict[str, str] = {}
