"""Language identification by averaged subword embeddings (operator 10).

Subwords are the 2- to 4-byte runs of the lower-case text within words and their
borders, hashed into buckets.  A document is the mean of its subwords'
embeddings, and a linear softmax gives its language.  Embeddings and softmax are
trained by stochastic gradient descent in numpy on the driver, on a sample of at
most PER_LANGUAGE documents of each language and about ALTOGETHER in all (whole
texts, those of least hash of id and text; copies of a row count once).  A fifth
of the sample is kept out of the training and calibrates a temperature for the
scores and the limit of rejection: the share of subwords known from training that
QUANTILE of the kept-out documents stay below, less MARGIN.  A text is rejected if
its own share stays below that even with ERRORS standard errors added, so that a
short text is not rejected for one odd word, or if its score is hardly above
chance (CHANCE times that of the average language).

A trained model is linear in the subwords, so it is applied as one table for each
bucket: of scores for few languages, of embeddings for many, so that its size
does not grow with the languages.  Whole texts are scored in slices of bounded
memory.

A null text, or one without letters, is `und` with score 0 and rejected.  Rows
without language or id are not learned from.  Without any labelled row all is
`und`.  Repeated rows are scored alike.  An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sampling import least_of_each
from .scratch import materialise, slices, table

SIZES, BUCKETS, DIMENSIONS = (2, 3, 4), 1 << 17, 16
PER_LANGUAGE, ALTOGETHER, EPOCHS, RATE, SLICE, SEED = 400, 4000, 8, 0.5, 1 << 18, 11
QUANTILE, MARGIN, ERRORS, CHANCE = 0.01, 0.1, 3.0, 1.2
FOLDS, HELD = 4, 2
UNKNOWN = "und"

_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def prepared(text: str) -> bytes:
    return b" " + text.lower().encode() + b" "


def hashed(data: np.ndarray, size: int) -> np.ndarray:
    """The bucket of the run of so many bytes at each place; BUCKETS where none counts."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.full(n, size, np.uint32)
    for k in range(size):
        h *= np.uint32(0x01000193)
        h ^= data[k : k + n]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    border = data == 32
    none = border[:n] & border[size - 1 :]
    if size > 2:
        none &= border[1 : n + 1]
    for k in range(1, size - 1):
        none |= border[k : k + n]
    out = (h & np.uint32(BUCKETS - 1)).astype(np.int64)
    out[none] = BUCKETS
    return out


def counts_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their counts in a whole text."""
    data, total = _KEEP[np.frombuffer(prepared(text), np.uint8)], np.zeros(BUCKETS + 1, np.int64)
    for a in range(0, len(data), SLICE):
        for size in SIZES:
            total += np.bincount(hashed(data[a : a + SLICE + size - 1], size), minlength=BUCKETS + 1)
    found = np.flatnonzero(total[:BUCKETS])
    return found, total[found]


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # (BUCKETS + 1, width + 2): logits or embeddings, known from training, counts
    bias: np.ndarray
    temperature: float
    least_score: float
    least_known: float
    project: np.ndarray | None = None  # embeddings to logits, where scores holds embeddings

    def judge(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score and rejection for rows of summed scores."""
        n = np.maximum(sums[:, -1], 1)
        p = softmax(self.logits(sums) / self.temperature)
        best, score, known = p.argmax(1), p.max(1), sums[:, -2] / n
        # runs of all sizes overlap, so a place counts once
        error = np.sqrt(np.clip(known * (1 - known), 0, None) * len(SIZES) / n)
        return best, score, (score < self.least_score) | (known + ERRORS * error < self.least_known)

    def logits(self, sums: np.ndarray) -> np.ndarray:
        mean = sums[:, :-2] / np.maximum(sums[:, -1:], 1)
        return (mean if self.project is None else mean @ self.project) + self.bias

    def sums(self, texts: list[str]) -> np.ndarray:
        """Summed scores of whole texts, many short ones or a slice of a long one at a time."""
        out = np.zeros((len(texts), self.scores.shape[1]))
        held, size = [], 0
        for k, text in enumerate(texts):
            held.append((k, prepared(text)))
            size += len(held[-1][1])
            if size >= SLICE or k == len(texts) - 1:
                self._add(out, held, size)
                held, size = [], 0
        return out

    def _add(self, out: np.ndarray, held: list, size: int) -> None:
        data = _KEEP[np.frombuffer(b"".join(d for _, d in held), np.uint8)]
        starts = np.cumsum([0, *(len(d) for _, d in held[:-1])])
        rows = np.array([k for k, _ in held])
        for a in range(0, size, 2 * SLICE):
            # texts meet at two borders, where no run counts
            first = int(np.searchsorted(starts, a, "right")) - 1
            last = int(np.searchsorted(starts, a + 2 * SLICE, "left"))
            for n in SIZES:
                h = hashed(data[a : a + 2 * SLICE + n - 1], n)
                if len(h):
                    at = np.maximum(starts[first:last] - a, 0)
                    own = at < len(h)
                    out[rows[first:last][own]] += np.add.reduceat(self.scores[h], at[own], axis=0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(languages: list[str], labels: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Embeddings and softmax from documents given as buckets and counts."""
    rng, k = np.random.default_rng(seed), len(languages)
    order = rng.permutation(len(rows))
    kept = order[: len(rows) // 5] if len(rows) >= 20 else order[:0]
    own = order[len(kept) :]
    embed = (rng.random((BUCKETS, DIMENSIONS)) - 0.5) / DIMENSIONS
    weights, bias = np.zeros((DIMENSIONS, k)), np.zeros(k)
    # a rare language weighs as much as a frequent one
    share = len(own) / (k * np.maximum(np.bincount(labels[own], minlength=k), 1))
    means = [(b, c / c.sum()) for b, c in rows]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(own):
            b, w = means[i]
            hidden = w @ embed[b]
            g = softmax(hidden @ weights + bias)
            g[labels[i]] -= 1
            g *= step * share[labels[i]]
            back = weights @ g
            weights -= np.outer(hidden, g)
            bias -= g
            embed[b] -= np.outer(w * np.sqrt(len(b)), back)
    known = np.zeros(BUCKETS)
    for i in own:
        known[means[i][0]] = 1
    table, project = (embed @ weights, None) if k <= DIMENSIONS else (embed, weights)
    scores = np.zeros((BUCKETS + 1, table.shape[1] + 2), np.float32)
    scores[:BUCKETS, :-2], scores[:BUCKETS, -2], scores[:BUCKETS, -1] = table, known, 1
    model = Model(languages, scores, bias, 1.0, CHANCE / k if k > 1 else 0.0, 0.0, project)
    if len(kept):
        sums = np.stack([c @ scores[b].astype(float) for b, c in (rows[i] for i in kept)])
        logits = model.logits(sums)
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(kept)), labels[kept]] + 1e-12).mean()
        model.temperature = float(min(2.0 ** np.arange(-4, 4.01, 0.25), key=loss))
        right = model.judge(sums)[0] == labels[kept]
        if right.any():
            model.least_known = float(max(0.0, np.quantile((sums[:, -2] / sums[:, -1])[right], QUANTILE) - MARGIN))
    return model


def fit(docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = PER_LANGUAGE, altogether: int = ALTOGETHER) -> Model | None:
    """A model from the labelled rows of docs; None without any."""
    rows = docs.select(F.col(label_col).cast("string").alias("lang"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("lang is not null and id is not null and text is not null")
    kinds = rows.agg(F.approx_count_distinct("lang", 0.01)).first()[0]
    if not kinds:
        return None
    key = F.xxhash64("text")
    # at most altogether rows, and one of each language
    chosen = F.broadcast(materialise(least_of_each(rows, F.col("lang"), F.col("id"), key, min(per_language, -(-altogether // kinds))), "language-chosen"))

    def run(batches):
        for batch in batches:
            got = [counts_of(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.astype("<u4").tobytes() for b, _ in got], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in got], pa.binary())], names=["lang", "buckets", "counts"])

    own = rows.withColumn("key", key).join(chosen.withColumnRenamed("label", "lang"), ["lang", "id", "key"])
    sample = own.groupBy("lang", "id", "key").agg(F.first("text").alias("text")).select("lang", "text")
    found = sample.mapInArrow(run, "lang string, buckets binary, counts binary").collect()
    found = sorted((r[0], bytes(r[1]), bytes(r[2])) for r in found if r[1])  # the order of the tasks must not matter
    found = [(name, np.frombuffer(b, "<u4"), np.frombuffer(c, "<u4")) for name, b, c in found]
    languages = sorted({x[0] for x in found})
    if not languages:
        return None
    at = {name: k for k, name in enumerate(languages)}
    return train(languages, np.array([at[x[0]] for x in found]), [x[1:] for x in found])


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in slices(batches):
            texts = [t.as_py() for t in batch.column(1)]
            some = [k for k, t in enumerate(texts) if model is not None and has_letter(t)]
            language, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            if some:
                best, p, out = model.judge(model.sums([texts[k] for k in some]))
                score[some], rejected[some] = p, out
                for k, b in zip(some, best, strict=True):
                    language[k] = model.languages[b]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(language), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language the model does not reject; no row moves."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in slices(batches):
            texts = [t.as_py() for t in batch.column(text_col)]
            keep = np.zeros(len(texts), bool)
            some = [k for k, t in enumerate(texts) if model is not None and has_letter(t)]
            if some:
                keep[some] = ~model.judge(model.sums([texts[k] for k in some]))[2]
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str, folds: int, fold: int):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold, F.lit(False))


def identify(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Predictions for docs by a model from the rows of labelled (else docs) outside the held-out fold."""
    source = docs if labelled is None else labelled
    model = fit(source.where(~held_out("doc_id", FOLDS, HELD)))
    return predict(docs, model).withColumn("held_out", held_out("doc_id", FOLDS, HELD))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "rejected")


QUERIES = {"op10_language_id": op10_language_id}
SQL: dict[str, str] = {}
