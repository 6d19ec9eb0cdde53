"""Manifest rows and audits of split, labelled collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import digest

UNKNOWN = "unknown"


def manifest(files: DataFrame, path: Column, split: Column, label: Column, content: Column | None = None, sha256: Column | None = None) -> DataFrame:
    """filepath, split, label, label_source, group_id, sha256 of every file, from its content or a digest already made."""
    named = label.isNotNull() & (label != "")
    return files.select(
        path.alias("filepath"), split.alias("split"), F.when(named, label).otherwise(UNKNOWN).alias("label"),
        F.when(named, "class_folder").otherwise("unverified_filename_prefix").alias("label_source"), F.lit(UNKNOWN).alias("group_id"), (digest(content) if sha256 is None else sha256).alias("sha256"))


def class_counts(files: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """Files of each split and class, readable or not; files without class do not count."""
    return files.where(F.col(label).isNotNull() & ~F.col(label).isin("", UNKNOWN)).groupBy(F.col(split).alias("split"), F.col(label).alias("label")).agg(F.count("*").alias("n_files"))


def split_counts(files: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """class_counts() and, for each split that has files without class, a row without label that counts none."""
    named = F.when(~F.col(label).isin("", UNKNOWN), F.col(label))
    return files.groupBy(F.col(split).alias("split"), named.alias("label")).agg(F.count(named).alias("n_files"))


def with_folders(counts: DataFrame, folders: DataFrame) -> DataFrame:
    """split_counts() with the classes of folders (split, label) that hold no file, and the splits that hold none."""
    bare = folders.join(counts.select("split", "label"), (folders["split"].eqNullSafe(counts["split"])) & (folders["label"].eqNullSafe(counts["label"])), "left_anti")
    return counts.unionByName(bare.select("split", "label", F.lit(0).cast("long").alias("n_files")))


def unreadable(files: DataFrame, readable: Column, split: str, path: str) -> DataFrame:
    """split and path of every file that cannot be read: one row each, however many there are."""
    return files.where(~F.coalesce(readable, F.lit(False))).select(F.col(split).alias("split"), F.col(path).alias("filepath"))


def spread_digests(rows: DataFrame, split: str = "split", sha256: str = "sha256") -> DataFrame:
    """Digests that occur in more than one split, with their numbers of files and splits.

    Counted by (digest, split) first: one digest may fill a third of the table.
    """
    by_split = rows.groupBy(F.col(sha256).alias("sha256"), F.col(split).alias("split")).agg(F.count("*").alias("n"))
    return by_split.groupBy("sha256").agg(F.sum("n").alias("n_files"), F.count("split").alias("n_splits")).where("n_splits > 1")


def spread_files(rows: DataFrame, split: str = "split", sha256: str = "sha256") -> DataFrame:
    """The rows behind spread_digests(), each with its group's counts."""
    return rows.join(spread_digests(rows, split, sha256).withColumnRenamed("sha256", sha256), sha256)


def conflicting_digests(rows: DataFrame, label: str = "label", sha256: str = "sha256") -> DataFrame:
    """Digests that carry more than one label."""
    by_label = rows.groupBy(F.col(sha256).alias("sha256"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return (by_label.groupBy("sha256").agg(F.sum("n").alias("n_files"), F.count("label").alias("n_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))
            .where("n_labels > 1"))


def class_sets(counts: DataFrame) -> DataFrame:
    """The sorted classes of each split, from class_counts(); from split_counts() splits without classes have none."""
    return counts.groupBy("split").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("classes"), F.count("label").alias("n_classes"), F.sum("n_files").alias("n_files"))


def warnings(counts: DataFrame, spread: DataFrame) -> DataFrame:
    """One row for each warning of an audit; counts as in class_sets()."""
    sets = class_sets(counts)
    odd = sets.where("n_classes <> 2").select(F.concat("split", F.lit(": expected two classes but found ["), "classes", F.lit("]")).alias("warning"))
    kinds = sets.agg(F.count_distinct("classes").alias("n")).where("n > 1").select(F.lit("class folders differ between splits").alias("warning"))
    crossing = spread.agg(F.count("*").alias("n")).where("n > 0").select(F.concat(F.col("n").cast("string"), F.lit(" exact duplicate groups cross splits")).alias("warning"))
    return odd.unionByName(kinds).unionByName(crossing)


def report(counts: DataFrame, unread: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """split and report: each split's classes, counts and number of unreadable files as JSON; counts as in class_sets().

    paths (split, path): the folders of the splits, which then are in the report.
    """
    lost = unread.groupBy(F.col("split").alias("_split")).agg(F.count("*").alias("unreadable"))
    by_split = counts.groupBy("split").agg(F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "n_files")))).alias("c"))
    if paths is not None:
        by_split = by_split.join(F.broadcast(paths), "split", "left")
    body = F.struct(F.col("split"), *([F.col("path")] if paths is not None else []), F.col("c.label").alias("classes"), F.map_from_arrays("c.label", "c.n_files").alias("class_counts"), F.coalesce("unreadable", F.lit(0)).alias("unreadable_images"))
    return by_split.join(lost, F.col("split").eqNullSafe(F.col("_split")), "left").select("split", F.to_json(body).alias("report"))


def layout_errors(counts: DataFrame, splits: tuple[str, ...], classes: tuple[str, ...]) -> list[str]:
    """What breaks the contract that every split has exactly these classes."""
    found = {r["split"]: r["classes"] for r in class_sets(counts).where(F.col("split").isin(*splits)).collect()}
    return [f"{s}: missing" if s not in found else f"{s}: {found[s]}" for s in splits if found.get(s) != ",".join(sorted(classes))]
