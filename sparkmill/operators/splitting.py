"""First-wins deduplication and seeded, stratified splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import part_of
from ..functions.paths import destination_name
from .manifest import spread_digests

SEED, TRAIN, VALIDATION = 42, 0.70, 0.15
SPLITS = ("train", "validation", "test")
METHOD = "stratified exact-hash-deduplicated"
#: Leading hex digits of the shuffle key that name a bucket: 65,536 of them.
BUCKET_DIGITS = 4


def first_wins(rows: DataFrame, order: list[Column], sha256: str = "sha256") -> DataFrame:
    """The first row of each digest, over all labels; a minimum, so copies meet combined."""
    kept = F.min(F.struct(*(c.alias(f"_o{k}") for k, c in enumerate(order)), F.struct(*rows.columns).alias("row")))
    return rows.groupBy(F.col(sha256).alias("_key")).agg(kept.alias("first")).select("first.row.*")


def shuffle_key(sha256: Column, seed: int = SEED) -> Column:
    """A place in a random order that seed and digest decide alone."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), sha256), 256)


def positions(rows: DataFrame, label: str, key: Column) -> DataFrame:
    """_rank (from 1) within the label by key, and _size of the label.

    Ranks are counted in buckets of leading key digits and moved by the buckets'
    sums, so two labels do not make two tasks.
    """
    marked = rows.withColumn("_k", key).withColumn("_bucket", F.substring("_k", 1, BUCKET_DIGITS))
    sizes = marked.groupBy(label, "_bucket").agg(F.count("*").alias("_n"))
    by_label = Window.partitionBy(label)
    before = by_label.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    moved = sizes.select(label, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(by_label).alias("_size"))
    inside = F.row_number().over(Window.partitionBy(label, "_bucket").orderBy("_k"))
    return marked.withColumn("_in", inside).join(moved, [label, "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_in")).drop("_in", "_before", "_k", "_bucket")


def stratified_split(pool: DataFrame, label: str = "label", sha256: str = "sha256", seed: int = SEED, train: float = TRAIN, validation: float = VALIDATION) -> DataFrame:
    """pool with its column split: of each label the first part train, then validation, the rest test."""
    ranked = positions(pool.drop("split"), label, shuffle_key(F.col(sha256), seed))
    end = part_of(F.col("_size"), train)
    split = F.when(F.col("_rank") <= end, SPLITS[0]).when(F.col("_rank") <= end + part_of(F.col("_size"), validation), SPLITS[1]).otherwise(SPLITS[2])
    return ranked.withColumn("split", split).drop("_rank", "_size")


def summary(parts: DataFrame, normal: str, pothole: str, label: str = "label", seed: int = SEED, notes: str = "") -> DataFrame:
    """Rows and classes of each split; an empty split has rate 0."""
    count = lambda name: F.count_if(F.col(label) == name)
    rate = F.coalesce(F.try_divide(F.col("pothole_count").cast("double"), F.col("rows").cast("double")), F.lit(0.0))
    return (parts.groupBy("split").agg(F.count("*").alias("rows"), count(normal).alias("normal_count"), count(pothole).alias("pothole_count"))
            .select("split", "rows", "normal_count", "pothole_count", F.format_string("%.6f", rate).alias("pothole_rate"),
                    F.lit(METHOD).alias("split_method"), F.lit(seed).alias("seed"), F.lit(notes).alias("notes")))


def overlap(parts: DataFrame) -> DataFrame:
    """One row: the number of digests in more than one split."""
    return spread_digests(parts).agg(F.count("*").alias("overlap_groups"))


def require_no_overlap(parts: DataFrame) -> None:
    if n := overlap(parts).first()[0]:
        raise RuntimeError(f"{n} digests lie in more than one split")


def materialise_split(parts: DataFrame, path: str, file: str) -> DataFrame:
    """Writes the split as split=/label= folders with names of digest and file, and proves that no
    digest is in two; an existing folder is an error."""
    parts.withColumn("dest_name", destination_name(F.col("sha256"), F.col(file))).write.mode("errorifexists").partitionBy("split", "label").parquet(path)
    written = parts.sparkSession.read.parquet(path)
    require_no_overlap(written)
    return written


def selection_rows(parts: DataFrame) -> DataFrame:
    """What model selection may see: the protected test split stays out, at the scan."""
    return parts.where(F.col("split").isin(*SPLITS[:2]))
