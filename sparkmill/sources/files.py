"""File collections, configurations and registries as DataFrames."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import AUDIT_SUFFIXES, has_suffix
from ..schema import CONFIG, EXPERIMENT

# The names that a split's folder may have, by kind of reader.
AUDIT_ALIASES = {"train": ("train",), "val": ("val", "valid", "validation"), "test": ("test",)}
POOL_ORDER = ("train", "val", "valid", "validation")
TRAINER_ALIASES = {"train": ("train",), "validation": ("val", "valid", "validation"), "test": ("test",)}
REQUIRED_KEYS = ("class_mapping", "input_image", "prediction_rule")


def store(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority, as Spark's readers return it."""
    files, at = store(spark, path)
    return files.makeQualified(at).toString().rstrip("/")


def first_there(spark: SparkSession, *paths: str) -> str:
    """The first path that exists, such as a local model before a remote one; FileNotFoundError if none does."""
    for path in paths:
        files, at = store(spark, path)
        if files.exists(at):
            return path
    raise FileNotFoundError(", ".join(paths))


def _folders(spark: SparkSession, path: str) -> list[str]:
    files, at = store(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(at) if s.isDirectory())


def class_folders(spark: SparkSession, root: str) -> DataFrame:
    """folder and label: one row for each class folder, empty ones too, and one with null for a folder without any.

    The driver lists folders, never files.
    """
    if not store(spark, root)[0].exists(store(spark, root)[1]):
        raise FileNotFoundError(root)
    rows = [(folder, label) for folder in _folders(spark, root) for label in _folders(spark, f"{root}/{folder}") or [None]]
    return spark.createDataFrame(rows, "folder string, label string")


def _segment(path: Column, base: str, at: int) -> Column:
    return F.get(F.split(F.substring(path, len(base) + 2, 1 << 30), "/"), F.lit(at))


def scan(spark: SparkSession, root: str, suffixes: tuple[str, ...] = AUDIT_SUFFIXES) -> DataFrame:
    """path, folder (first level below root), label (second level, '' in a flat folder), content.

    Where a folder has class folders, loose files beside them are left out.
    """
    base = qualified(spark, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    named = files.where(has_suffix(F.col("path"), suffixes)).select(
        "path", _segment(F.col("path"), base, 0).alias("folder"),
        F.when(_segment(F.col("path"), base, 2).isNotNull(), _segment(F.col("path"), base, 1)).otherwise("").alias("label"), "content")
    classed = [r["folder"] for r in class_folders(spark, root).where("label is not null").select("folder").distinct().collect()]
    return named.where((F.col("label") != "") | ~F.col("folder").isin(*classed)) if classed else named


def audit_split(folder: Column) -> Column:
    """train, val or test by the folder's name, any case; null for other folders."""
    low = F.lower(folder)
    return F.coalesce(*(F.when(low.isin(*names), F.lit(split)) for split, names in AUDIT_ALIASES.items()))


def require_one_folder_each(files: DataFrame) -> None:
    """Every split has exactly one folder."""
    found: dict = {s: set() for s in AUDIT_ALIASES}
    for r in files.select("folder").distinct().collect():
        for split, names in AUDIT_ALIASES.items():
            if r["folder"] and r["folder"].lower() in names:
                found[split].add(r["folder"])
    for split, folders in found.items():
        if len(folders) != 1:
            raise ValueError(f"{split}: one folder is needed, there are {sorted(folders) or 'none'}")


def pool_rank(folder: Column) -> Column:
    """The order in which a pool takes folders; null for those that it does not take."""
    return F.coalesce(*(F.when(folder == name, F.lit(k)) for k, name in enumerate(POOL_ORDER)))


def trainer_folders(folders: list[str]) -> dict[str, str]:
    """The first folder that is there for each split of a trainer, which needs all three."""
    out = {split: next((n for n in names if n in folders), None) for split, names in TRAINER_ALIASES.items()}
    if missing := [split for split, name in out.items() if name is None]:
        raise FileNotFoundError(f"no folder for {', '.join(missing)}")
    return out


def dataset(spark: SparkSession, root: str, folder: str, suffixes: tuple[str, ...] = AUDIT_SUFFIXES) -> tuple[DataFrame, list[str]]:
    """path, content and y (the place of the class among the sorted class folders) of one folder's images, and the classes."""
    classes = _folders(spark, f"{root}/{folder}")
    rows = scan(spark, root, suffixes).where((F.col("folder") == folder) & F.col("label").isin(*classes))
    return rows.select("path", "content", (F.array_position(F.array(*map(F.lit, classes)), F.col("label")) - 1).cast("int").alias("y")), classes


def load_config(spark: SparkSession, path: str) -> dict:
    """A configuration, checked: FileNotFoundError, or ValueError for bad JSON and missing keys."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(path, wholetext=True).select("value", F.from_json("value", CONFIG).alias("config")).collect()
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    try:
        config = json.loads(rows[0]["value"])
    except (IndexError, ValueError) as e:
        raise ValueError(f"not JSON: {path}") from e
    missing = sorted(set(REQUIRED_KEYS) - set(config if isinstance(config, dict) else ()))
    if missing:
        raise ValueError(f"missing keys: {missing}")
    return config


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry with its schema; empty where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.option("header", True).schema(EXPERIMENT).csv(path)
    except AnalysisException:
        return spark.createDataFrame([], EXPERIMENT)
