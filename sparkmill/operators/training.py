"""A classifier head on frozen features: weighted logistic regression."""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import class_weights
from .pixelhead import PixelHead, sums

MEASURES = ("loss", "accuracy", "precision", "recall")


@dataclass(frozen=True)
class HeadSettings:
    """Rounds at most, the change that ends training, and the penalty."""

    rounds: int = 20
    tolerance: float = 1e-6
    penalty: float = 0.01


def features(rows: DataFrame, vector: str) -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


def fit_head(rows: DataFrame, vector: str, label: str, settings: HeadSettings = HeadSettings(), balanced: bool = True) -> LogisticRegressionModel:
    """rows of a vector and a 0/1 label; classes weigh the same if balanced."""
    ready = features(rows.where(F.col(vector).isNotNull() & F.col(label).isNotNull()), vector)
    weights = {r[0]: r["weight"] for r in class_weights(ready, label).collect()} if balanced else {}
    weight = F.coalesce(*(F.when(F.col(label) == k, F.lit(w)) for k, w in weights.items()), F.lit(1.0))
    head = LogisticRegression(featuresCol="features", labelCol=label, weightCol="_weight", maxIter=settings.rounds, tol=settings.tolerance, regParam=settings.penalty)
    return head.fit(ready.withColumn("_weight", weight))


def score(rows: DataFrame, model: LogisticRegressionModel, vector: str) -> DataFrame:
    """rows with p, the probability of class 1."""
    scored = model.transform(features(rows.where(F.col(vector).isNotNull()), vector))
    return scored.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


@dataclass(frozen=True)
class EpochSettings:
    """Epochs at most, those without a lower validation loss that end training, step, and penalty."""

    epochs: int = 12
    patience: int = 3
    rate: float = 0.05
    penalty: float = 1e-3


def fit_epochs(train: DataFrame, validation: DataFrame, settings: EpochSettings = EpochSettings(), balanced: bool = True) -> tuple[PixelHead, list[dict]]:
    """The weights of the epoch of least validation loss, and the history, from rows (features, y).

    An epoch is one pass over each side; only sums as long as the features come to the driver.
    Give the rows materialised or cached.
    """
    counts = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if set(counts) != {0, 1}:
        raise ValueError(f"two classes are needed, there are {sorted(counts)}")
    share = {y: sum(counts.values()) / (2 * n) if balanced else 1.0 for y, n in counts.items()}
    weighed = train.withColumn("weight", F.when(F.col("y") == 1, F.lit(share[1])).otherwise(F.lit(share[0])))
    plain = validation.withColumn("weight", F.lit(1.0))
    start = time.monotonic()
    n = len(train.first()["features"])
    head, best, least, waited, records = PixelHead(np.zeros(n), 0.0), None, np.inf, 0, []
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    for epoch in range(settings.epochs):
        got = sums(weighed, head)
        gradient = got["gradient"] + settings.penalty * np.append(head.weights, 0.0)
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        step = settings.rate * (first / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(second / (1 - 0.999 ** (epoch + 1))) + 1e-8)
        head = PixelHead(head.weights - step[:-1], float(head.bias - step[-1]))
        after = sums(plain, head)
        records.append({"epoch": epoch, "seconds": round(time.monotonic() - start, 3), **{m: got[m] for m in MEASURES}, **{f"val_{m}": after[m] for m in MEASURES}})
        if after["loss"] < least:
            best, least, waited = head, after["loss"], 0
        else:
            waited += 1
            if waited >= settings.patience:
                break
    return best or head, records


def history(model: LogisticRegressionModel) -> list[tuple[int, float]]:
    """Round and loss."""
    return list(enumerate(model.summary.objectiveHistory))
