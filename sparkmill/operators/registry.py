"""A registry of experiments: keyed replacement and the choice of the best valid run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import EXPERIMENT
from ..sources.files import store


def upsert(registry: DataFrame, records: DataFrame, key: str = "run_name") -> DataFrame:
    """registry without the keys of records, then records; columns meet by name, missing ones are null."""
    return registry.join(records.select(key).distinct(), key, "left_anti").unionByName(records, allowMissingColumns=True)


def best_valid(registry: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """The valid run of the highest figure; the first name among equals.  Runs not marked valid never win."""
    return registry.where((F.col("valid_for_selection") == "yes") & F.col(metric).isNotNull() & ~F.isnan(metric)).orderBy(F.desc(metric), "run_name").limit(1)


def save(registry: DataFrame, path: str) -> None:
    """Writes a new folder; an existing one is an error."""
    registry.select(EXPERIMENT.fieldNames()).coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def replace(registry: DataFrame, path: str) -> None:
    """Writes the registry beside path, then puts it in path's place: what is there may be what registry still reads."""
    spark, new = registry.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    save(registry, new)
    files, at = store(spark, path)
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{new}.old")
    if files.exists(at) and not files.rename(at, old):
        raise OSError(f"{path} cannot be moved")
    if not files.rename(spark._jvm.org.apache.hadoop.fs.Path(new), at):
        raise OSError(f"{new} cannot be put in place of {path}")
    files.delete(old, True)
