"""python -m sparkmill audit | split | train | predict | evaluate"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators import triage
from .operators.training import EpochSettings
from .plans import entries
from .sources.sinks import write_csv


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sparkmill")
    commands = parser.add_subparsers(dest="command", required=True)
    audit = commands.add_parser("audit", help="report on an image tree")
    audit.add_argument("--data-dir", required=True)
    audit.add_argument("--output", required=True)
    audit.add_argument("--manifest-output")
    split = commands.add_parser("split", help="write a clean split of an image tree")
    split.add_argument("--data-dir", required=True)
    split.add_argument("--output", required=True)
    split.add_argument("--seed", type=int, default=42)
    evaluate = commands.add_parser("evaluate", help="figures of a Parquet table with columns y and p")
    evaluate.add_argument("--scores", required=True)
    evaluate.add_argument("--output", required=True)
    evaluate.add_argument("--threshold", type=float, default=0.5)
    train = commands.add_parser("train", help="train a head on an image tree with train and validation folders")
    train.add_argument("--data-dir", required=True)
    train.add_argument("--output", required=True)
    train.add_argument("--epochs", type=int, default=12)
    predict = commands.add_parser("predict", help="the class of one image file")
    predict.add_argument("--model-path", required=True)
    predict.add_argument("--image", required=True)
    predict.add_argument("--threshold", type=float, default=0.5)
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("sparkmill").getOrCreate()
    if given.command == "audit":
        found = entries.audit(spark, given.data_dir)
        entries.write_audit(found, given.output)
        found.report.show(truncate=False)
        found.warnings.show(truncate=False)
        if given.manifest_output:
            write_csv(found.manifest, given.manifest_output)
    elif given.command == "split":
        entries.clean_split(spark, given.data_dir, given.output, given.seed).groupBy("split", "label").count().show()
    elif given.command == "train":
        for record in entries.train(spark, given.data_dir, given.output, EpochSettings(epochs=given.epochs)):
            print(json.dumps(record))
    elif given.command == "predict":
        found = triage.predict_file(spark, given.image, given.model_path, given.threshold)
        print(f"{found['label']}, confidence {found['confidence']:.1%}; a person has to confirm it")
    else:
        entries.evaluate(spark.read.parquet(given.scores), given.output, threshold=given.threshold).show(50)


if __name__ == "__main__":
    main()
