"""Evaluation of binary scores: predictions, confusion, per-class figures, ROC-AUC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import predicted, ratio, valid_probability

THRESHOLD = 0.5
#: Scores are summed in so many equal ranges before they are ranked inside them.
SCORE_RANGES = 4096


def predictions(rows: DataFrame, ids: list[str], actual: Column, p: Column, threshold: float = THRESHOLD, names: tuple[str, str] = ("Normal", "Pothole")) -> DataFrame:
    """ids, actual, predicted, pothole_probability, is_error; without a valid score predicted is null and an error."""
    name = lambda c: F.when(c == 1, names[1]).when(c == 0, names[0])
    guess = predicted(p, threshold)
    return rows.select(*ids, name(actual).alias("actual"), name(guess).alias("predicted"), F.bround(p, 6).alias("pothole_probability"),
                       F.coalesce(actual != guess, F.lit(True)).alias("is_error"))


def confusion(rows: DataFrame, actual: Column, guess: Column) -> DataFrame:
    """One row: tp, fp, fn, tn of class 1."""
    at = lambda a, g: F.count_if((actual == a) & (guess == g))
    return rows.agg(at(1, 1).alias("tp"), at(0, 1).alias("fp"), at(1, 0).alias("fn"), at(0, 0).alias("tn"))


def confusion_matrix(counts: DataFrame, names: tuple[str, str] = ("Normal", "Pothole")) -> DataFrame:
    """Two rows, one for each actual class, with the counts of each predicted class."""
    cells = F.array(F.struct(F.lit(names[0]).alias("actual"), F.col("tn").alias("predicted_normal"), F.col("fp").alias("predicted_pothole")),
                    F.struct(F.lit(names[1]).alias("actual"), F.col("fn").alias("predicted_normal"), F.col("tp").alias("predicted_pothole")))
    return counts.select(F.inline(cells))


def figures(counts: DataFrame, names: tuple[str, str] = ("Normal", "Pothole")) -> DataFrame:
    """metric, class_name, value: per-class, macro and weighted precision, recall and F1, support, accuracy."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn

    def of(hit, wrong, missed):
        p, r = ratio(hit, hit + wrong), ratio(hit, hit + missed)
        return {"precision": p, "recall": r, "f1": ratio(2 * hit, 2 * hit + wrong + missed), "support": (hit + missed).cast("double")}

    normal, pothole = of(tn, fn, fp), of(tp, fp, fn)
    rows = [(m, c, v) for c, x in zip(names, (normal, pothole), strict=True) for m, v in x.items()]
    # a class that is neither true nor guessed of any row has no part in the mean
    there = [(c > 0).cast("double") for c in (tn + fn + fp, tp + fp + fn)]
    rows += [(m, "macro avg", ratio(normal[m] * there[0] + pothole[m] * there[1], there[0] + there[1])) for m in ("precision", "recall", "f1")]
    rows += [(m, "weighted avg", ratio(normal[m] * normal["support"] + pothole[m] * pothole["support"], n)) for m in ("precision", "recall", "f1")]
    rows.append(("accuracy", "all", ratio(tp + tn, n)))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(c).alias("class_name"), F.bround(v, 6).alias("value")) for m, c, v in rows))))


def roc_auc(rows: DataFrame, actual: Column, p: Column) -> DataFrame:
    """One row, auc: the chance that a row of class 1 scores above one of class 0, ties half.

    Rows meet as one row for each score; ranks are found inside ranges of the
    score and moved by the ranges' sums, so no window spans the table.  Without
    rows of both classes it is null.  Rows without a probability do not count,
    as in confusion().
    """
    score = rows.select(p.alias("p"), actual.alias("y")).where(valid_probability(F.col("p")) & F.col("y").isNotNull())
    by_score = score.groupBy("p").agg(F.sum("y").cast("double").alias("np"), F.sum(1 - F.col("y")).cast("double").alias("nn"))
    by_score = by_score.withColumn("range", F.floor(F.col("p") * SCORE_RANGES))
    sums = by_score.groupBy("range").agg(F.sum("nn").alias("range_nn"))
    before = sums.select("range", F.coalesce(F.sum("range_nn").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    inside = F.sum("nn").over(Window.partitionBy("range").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("nn")
    ranked = by_score.withColumn("inside", inside).join(before, "range")
    area = F.sum(F.col("np") * (F.col("before") + F.col("inside") + F.col("nn") / 2))
    return ranked.agg(F.try_divide(area, F.sum("np") * F.sum("nn")).alias("auc"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """label, n, weight = total / (classes * n) of each class."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))  # one row for each class
    total, classes = F.sum("n").over(every), F.count("*").over(every)
    return counts.select(label, "n", F.bround(total / (classes * F.col("n")).cast("double"), 6).alias("weight"))


def majority_class(rows: DataFrame, label: str) -> DataFrame:
    """One row: the most frequent class, the least of equals, with its rows and share."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    best = F.max(F.struct(F.col("n"), (-F.col(label)).alias("minus"), F.col(label).alias("label")))
    return counts.agg(best.alias("b"), F.sum("n").alias("total")).where("b is not null").select(
        F.col("b.label").alias("majority_class"), F.col("b.n").alias("n"), F.bround(F.col("b.n") / F.col("total").cast("double"), 6).alias("share"))
