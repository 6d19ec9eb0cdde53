"""From scores to decisions that a person reviews."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import PurePosixPath
from typing import BinaryIO, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import valid_probability
from ..functions.paths import UPLOAD_SUFFIXES
from ..sources.files import first_there, load_config
from . import pixels
from .pixelhead import PixelHead

REVIEW = {"Pothole": "priority human review required", "Normal": "routine human review required", "Invalid": "rejected score: human review required"}


class Scorer(Protocol):
    """Anything that gives a probability for each image of a batch (n, height, width, 3)."""

    def predict(self, batch: np.ndarray) -> np.ndarray: ...


def decide(rows: DataFrame, p: Column, threshold: float = 0.5) -> DataFrame:
    """rows with pothole_probability, valid, label, confidence, review_action."""
    valid = valid_probability(p)
    label = F.when(~valid, "Invalid").when(p >= threshold, "Pothole").otherwise("Normal")
    action = F.coalesce(*(F.when(F.col("label") == k, F.lit(v)) for k, v in REVIEW.items()))
    return (rows.withColumn("pothole_probability", F.bround(p, 6)).withColumn("valid", valid).withColumn("label", label)
            .withColumn("confidence", F.bround(F.when(F.col("label") == "Pothole", p).when(F.col("label") == "Normal", 1 - p), 6))
            .withColumn("review_action", action))


def score_images(tensors: DataFrame, load: Callable[[], Scorer], size: tuple[int, int] = (224, 224), batch: int = 32) -> DataFrame:
    """path and p of rows (path, pixels); load() runs once in each task, and may remember what it loads.

    One pass: p is made by the scan itself, so a filter on it scores nothing twice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for pdf in batches:
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch]
                x = np.stack([np.asarray(v, np.float32).reshape(*size, 3) for v in part["pixels"]])
                yield pd.DataFrame({"path": part["path"].to_numpy(), "p": np.ravel(scorer.predict(x)).astype(float)})

    return tensors.select("path", "pixels").mapInPandas(run, "path string, p double")


def prepare_image(spark: SparkSession, source: str | bytes | BinaryIO, size: tuple[int, int], name: str | None = None) -> np.ndarray:
    """float32 (height, width, 3) of one image: a path that Spark can read, bytes, or an open file.

    size: width and height.  ValueError for a name with another suffix than an upload may have, and
    for what is no readable image; a source without name or suffix is judged by its content alone.
    """
    name = name or (source if isinstance(source, str) else getattr(source, "name", ""))
    suffix = PurePosixPath(str(name)).suffix.lower()
    if suffix and suffix not in UPLOAD_SUFFIXES:
        raise ValueError(f"{suffix} files are not taken, only {', '.join(UPLOAD_SUFFIXES)}")
    if isinstance(source, str):
        rows = spark.read.format("binaryFile").load(source).select("content").take(1) if first_there(spark, source) else []
        if not rows:
            raise ValueError(f"not a file: {source}")
        content = bytes(rows[0][0])
    elif isinstance(source, bytes | bytearray):
        content = bytes(source)
    else:
        source.seek(0)
        content = source.read()
    return pixels.resized(pixels.decode(spark, content), (size[1], size[0]))


def predict_image(image: np.ndarray, scorer: Scorer, config: dict) -> dict:
    """The result of one prepared image; ValueError for a score outside 0 to 1."""
    threshold, size = config["prediction_rule"]["threshold"], list(config["input_image"]["image_size"])
    if list(image.shape[1::-1]) != size:
        raise ValueError(f"an image of {image.shape[1::-1]}; {size} is asked for")
    p = float(np.ravel(scorer.predict(image[None]))[0])
    if not 0.0 <= p <= 1.0:
        raise ValueError(f"invalid probability: {p}")
    mapping = {int(k): v for k, v in config["class_mapping"].items()}
    return {"label": mapping[int(p >= threshold)], "pothole_probability": p, "threshold": threshold, "image_size": size}


@lru_cache(maxsize=2)
def _artifacts(spark: SparkSession, model: str, config: str) -> tuple[PixelHead, dict]:
    return PixelHead.load(spark, model), load_config(spark, config)


def predict_from_artifacts(spark: SparkSession, source: str | bytes | BinaryIO, model: str, config: str) -> dict:
    """The result of one image by a saved model and its configuration, both read once."""
    scorer, settings = _artifacts(spark, model, config)
    width, height = settings["input_image"]["image_size"]
    return predict_image(prepare_image(spark, source, (int(width), int(height))), scorer, settings)


def predict_file(spark: SparkSession, path: str, model: str, threshold: float = 0.5, size: tuple[int, int] = (224, 224)) -> dict:
    """label and confidence of one file, whose name must have a suffix that uploads may have."""
    if PurePosixPath(path).suffix.lower() not in UPLOAD_SUFFIXES:
        raise ValueError(f"{path} has none of the suffixes {', '.join(UPLOAD_SUFFIXES)}")
    p = float(np.ravel(PixelHead.load(spark, model).predict(prepare_image(spark, path, size)[None]))[0])
    return {"label": "Pothole" if p >= threshold else "Normal", "pothole_probability": p, "confidence": p if p >= threshold else 1 - p}
