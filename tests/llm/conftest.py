from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

CLASHES = ("fp", "piece", "score", "label", "size", "ids", "text_key", "block", "start", "length", "shard", "toxic", "words", "_id", "_key")
WORDS = "the of and stone river house light under green water morning letter field window garden".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def odd_rows() -> list[tuple]:
    long = prose(1, 40_000)
    texts = [None, "", "   ", "\n", "a", long, long + " end", "It's <|endoftext|> and <s> <|startoftext|>x", "naïve ΣΑΣ İstanbul 漢字 🙂 ½", "  two  spaces \t tab ", "tail ", "NUL \x00 \x1c byte"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, prose(k, 30 + 40 * k)) for k in range(25)]
    rows += [(200, prose(3, 150)), (201, prose(3, 150)), (201, prose(3, 150)), (None, prose(3, 150)), (None, "x y z"), (102, prose(2, 110))]
    return rows


def with_clashes(df):
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="session")
def odd(spark):
    return with_clashes(spark.createDataFrame(odd_rows(), "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
