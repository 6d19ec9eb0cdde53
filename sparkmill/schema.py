"""Schemas of the records that the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


ISSUE_LOG = T.StructType(_strings("issue_id", "finding", "evidence_path", "risk", "decision", "action_or_limitation", "status", "owner"))

EXPERIMENT = T.StructType([
    *_strings("run_name", "hypothesis", "changed_factor", "class_weight"), T.StructField("training_seconds", T.DoubleType()), *_strings("valid_for_selection"),
    *(T.StructField(n, T.DoubleType()) for n in ("accuracy", "macro_f1", "pothole_precision", "pothole_recall", "normal_recall", "roc_auc"))])

CONFIG = T.StructType([
    T.StructField("class_mapping", T.MapType(T.StringType(), T.StringType())),
    T.StructField("input_image", T.StructType([T.StructField("image_size", T.ArrayType(T.IntegerType()))])),
    T.StructField("prediction_rule", T.StructType([T.StructField("threshold", T.DoubleType())]))])
