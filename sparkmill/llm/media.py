"""Media columns: archives of members behind a Spark data source (operator 7).

Every task writes one archive: members (here grey 8-bit PNG images, one for each
text), a directory of fixed-size entries, a sparse index and a footer.  Tasks
return the names and indexes of finished archives, and these are written as a
table, so what a lost or repeated task left behind is never read.

The data source gets the path of that table, opens no archive to plan, cuts every
archive along its index into byte ranges and makes each range a partition.  Ranges
are of RANGE_BYTES, or of more where there would be over MOST_RANGES of them.  A
partition streams its members in Arrow batches; members are read in runs, and a
member that comes back short or with a wrong checksum is read again by its own
offset, alone, before the task gives up.  An archive's own footer and index are
enough to read it without the table.

A text becomes its UTF-8 bytes, filled with bytes 255 to a positive multiple of
576, as rows of 576 samples.  Null and empty texts are one row of 255.  Repeated
rows are members of their own; a null doc_id is kept as null.  An empty table
gives no members.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .scratch import new_path, table

ROW, TILE, FILL = 576, 24, 255
#: doc_id, is it null, offset, length, checksum, bytes before filling
ENTRY = "<qBQQIQ"
#: place of the directory, members, place of the index, index entries, magic
FOOTER, MAGIC = "<QQQQ8s", b"MEMBARC1"
INDEX = "<QQ"
INDEX_BYTES, RANGE_BYTES, MOST_RANGES, BATCH_BYTES, ATTEMPTS = 1 << 20, 16 << 20, 100_000, 4 << 20, 4
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes([FILL]) * (max(1, -(-len(raw) // ROW)) * ROW - len(raw)), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """Rows of 576 grey samples, losslessly."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # each line's filter is 0
    lines[:, 1:] = rows
    data = zlib.compress(lines.tobytes(), 1)
    body = b"".join(_chunk(b"IDAT", data[k : k + (1 << 30)]) for k in range(0, len(data), 1 << 30))
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + body + _chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """The samples of an image that to_png() made, as rows."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG file")
    at, data, size = 8, [], None
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"the checksum of {kind!r} does not hold")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a grey 8-bit image")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Average hash of the mean of all 24 x 24 tiles, and the mean sample in thousandths."""
    tile = samples.reshape(-1, TILE, TILE).sum(0, dtype=np.int64)
    cells = tile.reshape(8, 3, 8, 3).sum((1, 3))
    total = int(cells.sum())
    bits = np.packbits((64 * cells > total).ravel()).tobytes().hex()
    return f"{bits}-{1000 * total // samples.size}"


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path there."""
    scheme, found, rest = uri.partition("://")
    # the scheme of S3 goes by three names in Hadoop and by one here; a path without scheme is local
    return fs.FileSystem.from_uri(f"s3://{rest}" if found and scheme in ("s3a", "s3n") else uri)


def write_archives(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table of finished archives: archive, members, bytes, marks (member and offset, from the index); written to path/archives."""

    def run(batches):
        store, root = store_of(path)
        store.create_dir(root, recursive=True)
        name, entries, index, at, marked = f"{uuid.uuid4().hex}.members", [], [], 0, -INDEX_BYTES
        with store.open_output_stream(f"{root}/{name}") as out:
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    payload, n = padded(text.as_py())
                    media = to_png(payload)
                    if at - marked >= INDEX_BYTES:
                        index.append(struct.pack(INDEX, len(entries), at))
                        marked = at
                    entries.append(struct.pack(ENTRY, doc or 0, doc is None, at, len(media), zlib.crc32(media), n))
                    out.write(media)
                    at += len(media)
            for x in entries:
                out.write(x)
            out.write(b"".join(index))
            out.write(struct.pack(FOOTER, at, len(entries), at + struct.calcsize(ENTRY) * len(entries), len(index), MAGIC))
        yield pa.RecordBatch.from_pydict({"archive": [f"{path}/{name}"], "members": [len(entries)], "bytes": [at], "marks": pa.array([b"".join(index)], pa.binary())})

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    rows.mapInArrow(run, "archive string, members long, bytes long, marks binary").write.parquet(f"{path}/archives")
    return docs.sparkSession.read.parquet(f"{path}/archives")


def _open(uri: str):
    store, path = store_of(uri)
    return store.open_input_file(path)


def index_of(archive: str) -> dict:
    """What the table of archives says of one, from its own footer and index."""
    with _open(archive) as f:
        f.seek(f.size() - struct.calcsize(FOOTER))
        entries_at, members, index_at, marks, magic = struct.unpack(FOOTER, f.read(struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError(f"{archive} is no archive of members")
        f.seek(index_at)
        return {"archive": archive, "members": members, "bytes": entries_at, "marks": f.read(struct.calcsize(INDEX) * marks)}


@dataclass
class Range(InputPartition):
    """Members first to last of an archive; their entries and bytes."""

    archive: str
    entries_at: int
    first: int
    last: int


def ranges(archive: dict, size: int) -> Iterator[Range]:
    """The byte ranges of an archive, of about this size."""
    start = None
    for member, place in [*struct.iter_unpack(INDEX, archive["marks"]), (archive["members"], archive["bytes"])]:
        if start is None:
            start = (member, place)
        elif place - start[1] >= size or member == archive["members"]:
            if member > start[0]:
                yield Range(archive["archive"], archive["bytes"], start[0], member)
            start = (member, place)


class MemberReader(DataSourceReader):
    def __init__(self, archives: list[dict], range_bytes: int):
        self.archives, self.range_bytes = archives, range_bytes

    def partitions(self) -> list[Range]:
        size = max(self.range_bytes, sum(a["bytes"] for a in self.archives) // MOST_RANGES)
        return [r for a in self.archives for r in ranges(a, size)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks once where there are no partitions
            return
        with _open(partition.archive) as f:
            f.seek(partition.entries_at + struct.calcsize(ENTRY) * partition.first)
            entries = list(struct.iter_unpack(ENTRY, f.read(struct.calcsize(ENTRY) * (partition.last - partition.first))))
            run: list[tuple] = []
            for k, e in enumerate(entries):
                run.append(e)
                if k + 1 == len(entries) or e[2] + e[3] - run[0][2] >= BATCH_BYTES:
                    yield self._batch(partition.archive, f, run)
                    run = []

    def _batch(self, archive: str, f, run: list[tuple]) -> pa.RecordBatch:
        start = run[0][2]
        try:
            f.seek(start)
            data = f.read(run[-1][2] + run[-1][3] - start)
        except OSError:
            data = b""
        media = []
        for _, _, offset, length, checksum, _ in run:
            got = data[offset - start : offset - start + length]
            media.append(got if len(got) == length and zlib.crc32(got) == checksum else again(archive, offset, length, checksum))
        return pa.RecordBatch.from_arrays([
            pa.array([None if e[1] else e[0] for e in run], pa.int64()), pa.array([e[5] for e in run], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def again(archive: str, offset: int, length: int, checksum: int, attempts: int = ATTEMPTS) -> bytes:
    """One member by its own offset, through a new handle each time."""
    why: Exception | str = ""
    for k in range(attempts):
        try:
            with _open(archive) as f:
                f.seek(offset)
                got = f.read(length)
            if len(got) == length and zlib.crc32(got) == checksum:
                return got
            why = "wrong bytes"
        except OSError as e:
            why = e
        time.sleep(0.1 * 2**k)
    raise OSError(f"member at {offset} of {archive}: {why}")


class MemberSource(DataSource):
    """spark.read.format("members").option("table", the path of a table of archives).load()"""

    @classmethod
    def name(cls) -> str:
        return "members"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary"

    def reader(self, schema) -> DataSourceReader:
        from pyarrow import parquet

        store, path = store_of(self.options["table"])
        archives = [r for r in parquet.read_table(path, filesystem=store, columns=["archive", "members", "bytes", "marks"]).to_pylist() if r["members"]]
        return MemberReader(archives, int(self.options.get("range_bytes", RANGE_BYTES)))


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_bytes, media of all members of the archives that write_archives() wrote to path."""
    spark.dataSource.register(MemberSource)
    return spark.read.format("members").option("table", f"{path}/archives").option("range_bytes", str(range_bytes)).load()


def described(members: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for media in batch.column("media"):
                media = media.as_py()
                samples = from_png(media)
                payload = np.ascontiguousarray(samples).tobytes()
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return members.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as images in archives, read back and described."""
    path = new_path(spark, "media")
    write_archives(table(spark, sf_dir, "documents"), path)
    return described(read_archives(spark, path))


QUERIES = {"op7_media_columns": op7_media_columns}
SQL: dict[str, str] = {}
