"""Bounded samples of labelled rows: of each class the rows of least hash.

Every task keeps the least distinct rows of each class that it has seen, so a
class sends at most so many rows from each task, whatever its size.  What is left
is counted in 256 bins of the hash: bins below the one that holds a class's last
row are taken whole, and only that bin's rows are ranked.  No class is too large
to be sampled, and copies of one row count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise


class Least:
    """The most least distinct rows (hash, id, key) of one class."""

    def __init__(self, most: int):
        self.most, self.rows, self.limit = most, np.empty((0, 3), np.int64), None

    def add(self, rows: np.ndarray) -> None:
        if self.limit is not None:
            rows = rows[rows[:, 0] <= self.limit]
        if len(rows):
            self.rows = np.concatenate([self.rows, rows])
            if len(self.rows) > 4 * self.most:
                self.cut()

    def cut(self) -> np.ndarray:
        self.rows = np.unique(self.rows, axis=0)[: self.most]  # sorted by hash, id, key
        if len(self.rows) == self.most:
            self.limit = int(self.rows[-1, 0])
        return self.rows


def least_of_each(rows: DataFrame, label: Column, row_id: Column, key: Column, most: int) -> DataFrame:
    """label (string), id, key: the ``most`` distinct rows of least (hash, id, key) of each label.

    row_id and key are longs without nulls; rows of null label are left out.
    """

    def run(batches):
        held: dict[str, Least] = {}
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            of, own = names.indices.to_numpy(), np.stack([batch.column(k).to_numpy() for k in (1, 2, 3)], 1)
            for k, name in enumerate(names.dictionary.to_pylist()):
                held.setdefault(name, Least(most)).add(own[of == k])
        for name, least in held.items():
            found = least.cut()
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), *(pa.array(found[:, k]) for k in range(3))], names=["label", "hash", "id", "key"])

    slim = rows.select(label.cast("string").alias("label"), row_id.alias("id"), key.alias("key")).where("label is not null")
    found = slim.select("label", F.xxhash64("id", "key").alias("hash"), "id", "key").mapInArrow(run, "label string, hash long, id long, key long").distinct()
    found = materialise(found, "least-hashes").withColumn("bin", F.shiftright("hash", 56).cast("int"))
    below = Window.partitionBy("label").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = found.groupBy("label", "bin").agg(F.count("*").alias("n")).withColumn("need", F.lit(most) - F.coalesce(F.sum("n").over(below), F.lit(0))).where("need > 0")
    # 256 rows of a class at most
    near = found.join(F.broadcast(bins), ["label", "bin"])
    rank = F.row_number().over(Window.partitionBy("label", "bin").orderBy("hash", "id", "key"))
    last = near.where("n > need").withColumn("rank", rank).where("rank <= need").drop("rank")
    return near.where("n <= need").unionByName(last).select("label", "id", "key")
