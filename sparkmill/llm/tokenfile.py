"""Token ids as compressed binary files (operator 6).

Ids of all documents, each with an end id, lie in ascending doc_id order in
blocks of an asymmetric numeral system (see rans.py), all under one table of
frequencies.  Texts are sorted by ranges of (id, row), so that rows of one id are
dealt to many tasks, and tokenised once, into compressed blocks that go to the
shared folder; the counts of all blocks make the table of the corpus, under which
the blocks are encoded.

A file is a Parquet file whose rows are blocks, so that any store that Spark
writes to will do and its commit protocol keeps the blocks of lost tasks out.  A
block holds whole documents: part and block number, the ids before it in its
part, the documents' ids and lengths, and the bytes.

Null and empty texts are the end id alone.  A null doc_id comes first.  Repeated
rows are written as often as they occur.  An empty table gives no blocks.  Extra
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebpe import byte_bpe_50k, encoder, pack_ids, unpack_ids
from .rans import Block, Table, encode
from .scratch import materialise, new_path, table, unused

BLOCK_IDS = 1 << 20
_BLOCK = "part int, block long, before long, n_ids long, doc_id array<long>, length array<long>, data binary"


def _tokenised(docs: DataFrame, tokenizer: tuple, end_id: int, id_col: str, text_col: str, block_ids: int) -> DataFrame:
    """Blocks of sorted documents, their ids compressed, with the counts of each block's ids."""

    def run(batches):
        from pyspark import TaskContext

        bpe, part = encoder(*tokenizer), TaskContext.get().partitionId()
        docs_, lengths, ids, held, before, made = [], [], [], 0, 0, 0

        def closed():
            every = np.concatenate(ids)
            counts = np.bincount(every)
            kinds = np.flatnonzero(counts)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": pa.array([made], pa.int64()), "before": pa.array([before], pa.int64()), "n_ids": pa.array([held], pa.int64()),
                "doc_id": pa.array([docs_], pa.list_(pa.int64())), "length": pa.array([lengths], pa.list_(pa.int64())), "data": pa.array([pack_ids(every)], pa.binary()),
                "kinds": pa.array([kinds], pa.list_(pa.int64())), "counts": pa.array([counts[kinds]], pa.list_(pa.int64()))})

        for batch in batches:
            for doc, own in zip(batch.column(0).to_pylist(), bpe.encode_all(batch.column(1).to_pylist()), strict=True):
                own = np.append(own, np.uint32(end_id))
                docs_.append(doc)
                lengths.append(len(own))
                ids.append(own)
                held += len(own)
                if held >= block_ids:
                    yield closed()
                    before, made = before + held, made + 1
                    docs_, lengths, ids, held = [], [], [], 0
        if docs_:
            yield closed()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    row = unused(docs, "row")
    rows = rows.withColumn(row, F.monotonically_increasing_id())
    made = rows.repartitionByRange("doc_id", row).sortWithinPartitions("doc_id", row).mapInArrow(run, f"{_BLOCK}, kinds array<long>, counts array<long>")
    return materialise(made, "tokenised")


def _by_id(ids, counts, size: int = 0) -> np.ndarray:
    out = np.zeros(max(size, int(max(ids, default=-1)) + 1), np.int64)
    out[np.asarray(ids, np.int64)] = counts
    return out


def write(docs: DataFrame, path: str, tokenizer: tuple, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Writes path/table (id, frequency: one row for each id of the vocabulary that occurs) and path/blocks."""
    spark = docs.sparkSession
    made = _tokenised(docs, tokenizer, end_id, id_col, text_col, block_ids)
    each = made.select(F.inline(F.arrays_zip("kinds", "counts"))).groupBy("kinds").agg(F.sum("counts"))
    counts = dict(map(tuple, each.collect())) or {end_id: 1}  # no more rows than the vocabulary has
    freq = Table.of_counts(_by_id(list(counts), list(counts.values()))).freq.astype(np.int64)
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "id int, frequency long").coalesce(1).write.parquet(f"{path}/table")

    def run(batches):
        shared = Table(freq)
        for batch in batches:
            data = [encode(unpack_ids(d.as_py()), shared) for d in batch.column("data")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("part", "block", "before", "n_ids", "doc_id", "length")), pa.array(data, pa.binary())],
                                             names=["part", "block", "before", "n_ids", "doc_id", "length", "data"])

    made.drop("kinds", "counts").mapInArrow(run, _BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, start (ids before it), n_tokens, ids_crc32 and, if kept, ids (little-endian uint32) of every document."""
    freq = {r["id"]: r["frequency"] for r in spark.read.parquet(f"{path}/table").collect()}
    by_id = np.zeros(max(freq) + 1, np.int64)
    by_id[list(freq)] = list(freq.values())
    blocks = spark.read.parquet(f"{path}/blocks")
    # one row for each task that wrote
    parts = sorted((r[0], r[1]) for r in blocks.groupBy("part").agg(F.sum("n_ids")).collect())
    first, total = {}, 0
    for part, n in parts:
        first[part], total = total, total + n

    def run(batches):
        coder = Table(by_id)
        for batch in batches:
            for row in batch.to_pylist():
                raw = Block(row["data"]).all(coder).astype("<u4").tobytes()
                ends = np.cumsum(row["length"])
                starts = ends - row["length"]
                own = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = {"doc_id": pa.array(row["doc_id"], pa.int64()), "start": pa.array(starts + row["before"] + first[row["part"]], pa.int64()),
                           "n_tokens": pa.array(row["length"], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64())}
                if keep_ids:
                    columns["ids"] = pa.array(own, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    path = new_path(spark, "token-files")
    write(table(spark, sf_dir, "documents"), path, byte_bpe_50k())
    return read(spark, path, keep_ids=False)


QUERIES = {"op6_token_files": op6_token_files}
SQL: dict[str, str] = {}
