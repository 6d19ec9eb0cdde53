"""Whole runs over an image tree: the audit, the clean split, the evaluation of scores."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import digest, plain_path
from ..operators import issues, manifest, metrics, pixelhead, pixels, splitting, training
from ..sources import files
from ..sources.sinks import write_csv, write_json

LABELS = ("Normal", "Pothole")


def readable_files(spark: SparkSession, root: str) -> DataFrame:
    """Scanned files with readable: whether the JVM decodes them to at least a pixel or, of WebP files, the container is sound."""
    found = files.scan(spark, root).withColumn("_path", plain_path(F.col("path")))
    decoded = pixels.images(spark, root).where(pixels.readable(F.col("height"), F.col("width"))).select(plain_path(F.col("path")).alias("_path"))
    sound = decoded.unionByName(pixels.sound_webp(found.select(F.col("_path").alias("path"), "content")).withColumnRenamed("path", "_path"))
    return found.join(sound.distinct().withColumn("readable", F.lit(True)), "_path", "left").withColumn("readable", F.coalesce("readable", F.lit(False))).drop("_path")


@dataclass
class Audit:
    """Counts hold all files with a class, the manifest the readable ones, the report every split.

    files holds what the others are made of (path, split, label, readable, sha256): one scan, written or
    cached by whoever reads several of them.
    """

    files: DataFrame

    manifest: DataFrame
    counts: DataFrame
    unreadable: DataFrame
    duplicates: DataFrame
    warnings: DataFrame
    report: DataFrame


def audit(spark: SparkSession, root: str) -> Audit:
    """The audit of root/split/class/**/file."""
    folders = files.class_folders(spark, root).withColumn("split", files.audit_split(F.col("folder"))).where("split is not null")
    files.require_one_folder_each(folders)
    found = readable_files(spark, root).withColumn("split", files.audit_split(F.col("folder"))).where("split is not null")
    found = found.select("path", "split", "label", "readable", digest(F.col("content")).alias("sha256")).persist(StorageLevel.DISK_ONLY)
    rows = manifest.manifest(found.where("readable"), F.col("path"), F.col("split"), F.col("label"), sha256=F.col("sha256"))
    counts, lost = manifest.class_counts(found), manifest.unreadable(found, F.col("readable"), "split", "path")
    spread, every = manifest.spread_digests(rows), manifest.with_folders(manifest.split_counts(found), folders)
    paths = folders.select("split", F.concat(F.lit(files.qualified(spark, root) + "/"), "folder").alias("path")).distinct()
    return Audit(found, rows, counts, lost, manifest.spread_files(rows), manifest.warnings(every, spread), manifest.report(every, lost, paths))


def document(found: Audit, root: str) -> dict:
    """The whole audit as one document, for a tree whose findings fit the driver."""
    splits = {r["split"]: json.loads(r["report"]) for r in found.report.collect()}
    for r in splits.values():
        r |= {"unreadable_images": [], "split": None}
        del r["split"]
    for r in found.unreadable.orderBy("filepath").collect():
        splits[r["split"]]["unreadable_images"].append(r["filepath"])
    groups: dict = {}
    for r in found.duplicates.orderBy("sha256", "filepath").collect():
        groups.setdefault(r["sha256"], []).append(r["filepath"])
    return {"data_dir": root, "splits": splits, "duplicate_files_across_splits": list(groups.values()), "warnings": [r["warning"] for r in found.warnings.orderBy("warning").collect()]}


def write_audit(found: Audit, out: str) -> None:
    """Writes the report on every split to out, and duplicates, warnings and unreadable paths to out-tables beside it."""
    write_json(found.report, out)
    for name in ("report", "duplicates", "warnings", "unreadable"):
        write_json(getattr(found, name), f"{out.rstrip('/')}-tables/{name}")


def train(spark: SparkSession, root: str, out: str, settings: training.EpochSettings = training.EpochSettings(), size: tuple[int, int] = pixels.SIZE, seed: int = 42) -> list[dict]:
    """Trains a head on root's train folder, stops early by its validation folder, and writes model and history to out."""
    found, sides = files.trainer_folders([r["folder"] for r in files.class_folders(spark, root).select("folder").distinct().collect()]), []
    for split in ("train", "validation"):
        rows, classes = files.dataset(spark, root, found[split])
        if len(classes) != 2:
            raise ValueError(f"{found[split]}: two class folders are needed, there are {classes}")
        images = pixels.images(spark, f"{root}/{found[split]}").withColumn("_path", plain_path(F.col("path")))
        own = rows.select("y", plain_path(F.col("path")).alias("_path")).join(pixels.turns(rows).select(plain_path(F.col("path")).alias("_path"), "turn"), "_path", "left")
        named = own.join(images, "_path").select("path", "y", "height", "width", "nChannels", "data", "turn")
        tensors = pixels.tensors(named, size).join(named.select("path", "y"), "path").withColumn("split", F.lit(split))
        changed = pixels.augment(tensors, pixels.TRAINER, size, seed).join(named.select("path", "y"), "path")
        sides.append(pixelhead.pool(changed.select("path", "y", "pixels"), size).persist(StorageLevel.DISK_ONLY))
    head, records = training.fit_epochs(*sides, settings)
    head.save(spark, out, records)
    for side in sides:
        side.unpersist()
    return records


def pool(spark: SparkSession, root: str) -> DataFrame:
    """The first readable copy of each labelled content, from the folders that a pool takes; never from test."""
    found = readable_files(spark, root).withColumn("_rank", files.pool_rank(F.col("folder"))).where("readable and _rank is not null").where(F.col("label").isin(*LABELS))
    rows = found.select("path", "label", "content", "_rank", F.sha2("content", 256).alias("sha256"))
    # the winner is found without contents, which then join it
    first = splitting.first_wins(rows.drop("content"), [F.col("_rank"), F.col("label"), F.col("path")])
    if first.isEmpty():
        raise ValueError(f"no readable labelled images under {root}")
    return first.drop("_rank").join(rows.select("path", "content"), "path")


def clean_split(spark: SparkSession, root: str, out: str, seed: int = splitting.SEED) -> DataFrame:
    """Writes out/split, out/summary and out/issues; proves that no content is in two splits."""
    written = splitting.materialise_split(splitting.stratified_split(pool(spark, root), seed=seed), f"{out}/split", "path")
    write_csv(splitting.summary(written, *LABELS, seed=seed), f"{out}/summary", one_file=True)
    write_csv(issues.issue_log(audit_rows(spark, root), LABELS[1]), f"{out}/issues", one_file=True)
    return written


def audit_rows(spark: SparkSession, root: str) -> DataFrame:
    """Manifest rows of all folders, by their own names."""
    found = readable_files(spark, root).where("readable")
    return manifest.manifest(found, F.col("path"), F.col("folder"), F.col("label"), F.col("content"))


def evaluate(scores: DataFrame, out: str, actual: str = "y", p: str = "p", ids: tuple[str, ...] = (), threshold: float = metrics.THRESHOLD) -> DataFrame:
    """Writes out/metrics, out/confusion and out/predictions of scored rows; returns the metrics."""
    counts = metrics.confusion(scores, F.col(actual), metrics.predicted(F.col(p), threshold))
    auc = metrics.roc_auc(scores, F.col(actual), F.col(p)).select(F.lit("roc_auc").alias("metric"), F.lit("all").alias("class_name"), F.bround("auc", 6).alias("value"))
    limit = scores.sparkSession.createDataFrame([("threshold", "all", float(threshold))], "metric string, class_name string, value double")
    figures = metrics.figures(counts).unionByName(auc).unionByName(limit)
    write_json(figures, f"{out}/metrics")
    write_csv(metrics.confusion_matrix(counts), f"{out}/confusion", one_file=True)
    write_csv(metrics.predictions(scores, list(ids), F.col(actual), F.col(p), threshold), f"{out}/predictions")
    return figures
