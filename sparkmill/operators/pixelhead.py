"""A small image classifier that needs no deep-learning library: a logistic head on pooled pixels.

It stands where a pretrained network would: same tensors in, same probabilities
out, trained by gradient steps whose sums Spark makes, with early stopping.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pixels import SIZE, centred

CELLS = 8


def pooled(batch: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Means and spreads of cells x cells parts of images (n, height, width, 3), from -1 to 1."""
    x = centred(batch)
    rows, cols = (np.linspace(0, n, cells + 1).astype(int)[:-1] for n in x.shape[1:3])
    area = np.outer(np.diff(rows, append=x.shape[1]), np.diff(cols, append=x.shape[2]))[..., None]
    total = lambda v: np.add.reduceat(np.add.reduceat(v, rows, axis=1), cols, axis=2) / area
    mean = total(x)
    return np.concatenate([mean, np.sqrt(np.maximum(total(x * x) - mean**2, 0))], 3).reshape(len(x), -1)


def pool(tensors: DataFrame, size: tuple[int, int] = SIZE, cells: int = CELLS) -> DataFrame:
    """tensors with features in place of pixels."""
    kept = [f for f in tensors.schema.fields if f.name != "pixels"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 64):
                part = pdf.iloc[k : k + 64]
                x = np.stack([np.asarray(v, np.float32).reshape(*size, 3) for v in part["pixels"]])
                yield part.drop(columns="pixels").assign(features=list(pooled(x, cells)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return tensors.mapInPandas(run, f"{schema}, features array<double>")


@dataclass
class PixelHead:
    weights: np.ndarray
    bias: float
    cells: int = CELLS

    def predict(self, batch: np.ndarray, **_) -> np.ndarray:
        return self.of(pooled(np.asarray(batch, np.float32), self.cells))[:, None]

    def of(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights + self.bias, -30, 30)))

    def save(self, spark: SparkSession, path: str, history: list[dict] = ()) -> None:
        """path/model and path/history, a line for each epoch; an existing folder is an error."""
        text = json.dumps({"weights": self.weights.tolist(), "bias": self.bias, "cells": self.cells})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/model")
        if history:
            spark.createDataFrame([(json.dumps(h),) for h in history], "value string").coalesce(1).write.text(f"{path}/history")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PixelHead:
        """FileNotFoundError where there is no model."""
        from ..sources.files import first_there

        found = json.loads(spark.read.text(first_there(spark, f"{path}/model"), wholetext=True).first()[0])
        return cls(np.array(found["weights"]), found["bias"], found["cells"])


def sums(rows: DataFrame, head: PixelHead) -> dict:
    """Loss, gradient and confusion counts of rows (features, y, weight), added up by the tasks."""
    n = len(head.weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n + 7)
        for pdf in batches:
            if not len(pdf):
                continue
            x, y, w = np.stack(pdf["features"]), pdf["y"].to_numpy(float), pdf["weight"].to_numpy(float)
            p = head.of(x)
            guess = p >= 0.5
            loss = -(w * np.where(y == 1, np.log(np.maximum(p, 1e-12)), np.log(np.maximum(1 - p, 1e-12)))).sum()
            off = w * (p - y)
            total += np.concatenate([x.T @ off, [off.sum(), loss, w.sum(), (guess & (y == 1)).sum(), (guess & (y == 0)).sum(), (~guess & (y == 1)).sum(), (~guess & (y == 0)).sum()]])
        yield pd.DataFrame({"k": np.arange(n + 7), "v": total})

    got = np.zeros(n + 7)
    for k, v in rows.select("features", "y", "weight").mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v")).collect():
        got[k] = v
    tp, fp, fn, tn = got[n + 3 :]
    weight = max(got[n + 2], 1e-12)
    ratio = lambda a, b: float(a / b) if b else 0.0
    return {"gradient": got[: n + 1] / weight, "loss": float(got[n + 1] / weight), "accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)}
