"""Reports, tables and models as files."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.training import history


def write_csv(rows: DataFrame, path: str, one_file: bool = False) -> None:
    """With a header; an existing folder is an error.  one_file: for tables of a few rows."""
    (rows.coalesce(1) if one_file else rows).write.mode("errorifexists").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line, nulls kept."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def save_head(model: LogisticRegressionModel, path: str) -> None:
    """The model and, where it was just trained, its losses round by round."""
    model.write().save(f"{path}/model")
    if model.hasSummary:
        SparkSession.active().createDataFrame(history(model), "epoch int, loss double").coalesce(1).write.json(f"{path}/history")


def load_head(path: str) -> LogisticRegressionModel:
    return LogisticRegressionModel.load(f"{path}/model")
