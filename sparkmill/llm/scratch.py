"""Intermediate tables in the folder that the driver and all executors share.

The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset
(a local session, as in tests) a folder of this process is used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and executors share")
    global _local
    if _local is None:
        _local = tempfile.mkdtemp(prefix="sparkmill-")
        atexit.register(shutil.rmtree, _local, ignore_errors=True)
    return f"file://{_local}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path that no other call gets: tables of one application lie side by side."""
    return f"{shared_root(spark)}/sparkmill-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it back, so nothing upstream runs twice and a lost
    executor costs no more than the tasks that it was running."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int | None = None) -> DataFrame:
    """Like materialise(), dealt into buckets of key, by default as many as a shuffle
    has partitions: a join on key then moves only its other side.

    Spark keeps buckets in a catalogue, so the table has a name there while it is
    written; the plan that is returned needs the files alone.
    """
    spark = df.sparkSession
    made = f"sparkmill_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").option("path", new_path(spark, name)).bucketBy(buckets, key).saveAsTable(made)
    try:
        return spark.table(made)
    finally:
        spark.sql(f"DROP TABLE {made}")  # its files lie at a path of their own and stay


def slices(batches: Iterable, rows: int = 1024) -> Iterator:
    """Arrow batches of at most so many rows: what comes out in small batches needs small buffers on both sides."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def unused(df: DataFrame, name: str) -> str:
    """The name, or the first like it, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}{k}" for k in range(len(taken) + 1))) if n.lower() not in taken)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
