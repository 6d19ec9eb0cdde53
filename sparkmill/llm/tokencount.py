"""Token counts from a table of distinct pre-tokens (operator 5).

White space is the only border that pieces of these models never cross: every
piece has its word-start marks in front.  So a text is split where a space
follows another character, pieces are counted once for each distinct pre-token
of the corpus, and a document's count is the sum over its pre-tokens of
frequency times pieces.  No document's ids are ever made.

Null and empty texts have 0 bytes and 0 tokens.  Repeated rows and null ids are
counted like others.  An empty table gives an empty result.  Extra columns are
ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import worddict
from .scratch import table

LIMIT = 4096
_RUNS = re.compile(r" *[^ ]+| +\Z")
MARK = "▁"


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens without their first word-start mark: "a  b " gives "a", " b", ""."""
    if not text:
        return []
    text = text.replace(MARK, " ")  # the model's own sign for a space
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [x[1:] for x in _RUNS.findall(" " + text)]


def _whole_words(model) -> None:
    """The split above holds for models whose pieces have marks only in front."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    if bad := [p for p in pieces if MARK in p.lstrip(MARK)]:
        raise ValueError(f"pieces cross word borders: {bad[:3]}")


_models: dict = {}


def model(path: str):
    if path not in _models:
        import sentencepiece

        found = sentencepiece.SentencePieceProcessor(model_file=path)
        _whole_words(found)
        _models[path] = found
    return _models[path]


def counter(path: str):
    """The function from pre-tokens to their numbers of pieces."""
    encode = model(path).encode
    alone = len(encode("a ")) - len(encode("a"))

    def count(words: list[str]) -> list[int]:
        return [len(ids) if w else alone for w, ids in zip(words, encode(words, num_threads=1) if words else [], strict=True)]

    return count


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    held = worddict.blocks(docs, lambda: pre_tokens, True, id_col, text_col)
    found = worddict.answers(worddict.asked(held, worddict.buckets_of(held)), lambda: counter(path), lambda x: worddict.pack(np.array(x, np.uint32)))

    def finish(row):
        pieces = np.zeros(row["n_distinct"], np.int64)
        for record in row["found"]:
            pieces[worddict.numbers_of(record["numbers"])] = worddict.unpack(record["answers"])
        lengths = np.array(row["n_words"], np.int64)
        # each document's word numbers were written as gaps
        gaps, starts = worddict.unpack(row["seq"]).astype(np.int64), np.cumsum(lengths) - lengths
        run = np.concatenate([[0], np.cumsum(gaps)])
        seq = run[1:] - np.repeat(run[starts], lengths)
        n = worddict.sums(pieces[seq] * worddict.unpack(row["counts"]), lengths)
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(row["doc_id"], pa.int64()), "n_bytes": pa.array(row["n_bytes"], pa.int64()), "n_tokens": pa.array(n, pa.int64())})

    return worddict.met(held, found, finish, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    import public_tokenizers as p

    return token_counts(table(spark, sf_dir, "documents"), p.path("piece_bpe_32k.model"))


QUERIES = {"op5_token_counts": op5_token_counts}
SQL: dict[str, str] = {}
