"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A document is a sparse vector of relative frequencies of hashed n-grams: words and word pairs, and one to three
neighbouring word shapes (runs of letter case, digits and other signs). A score is the sigmoid of its dot product with
the weights. Only text enters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame

from stratalake.llm.common import WORDS_KEPT, mixed, ready, rows, texts

#: Hashed dimensions: the weights, 8 bytes each, are all that reaches the driver and is broadcast.
DIMENSIONS = 1 << 18
#: Labelled rows used for training at most: the first by hash of the id. A documented bound, see quality_scores.
TRAINING_ROWS = 6000
#: Parameters of the learner.
EPOCHS, ALPHA, BETA, L1, L2, SCALE = 4, 0.5, 1.0, 0.001, 0.01, 20.0

_CLASSES = bytes(
    97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)


class WordFeatures(dict):
    """word bytes -> 31 bits of the word's hash and 32 of its shape's."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        shape = _RUN.sub(rb"\1", word.translate(_CLASSES))
        value = self[word] = (xxhash.xxh3_64_intdigest(word) & 0x7FFFFFFF) << 32 | xxhash.xxh32_intdigest(shape)
        return value


def features(text: str | None, table: WordFeatures) -> np.ndarray:
    """Dimensions of all n-gram occurrences of the whole text; a mark of its own for texts without words."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(1, np.int64)
    both = np.fromiter(map(table.__getitem__, words), np.int64, len(words)).view(np.uint64)
    word, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    same = (word[1:] == word[:-1]).astype(np.uint64) if len(word) > 1 else word[:0]
    parts = [word * np.uint64(8) + np.uint64(1), shape * np.uint64(8) + np.uint64(2), same * np.uint64(8) + np.uint64(3)]
    if len(word) > 1:
        parts.append(mixed(word[:-1] * np.uint64(0x1000003) + word[1:]) * np.uint64(8) + np.uint64(4))
        pair = mixed(shape[:-1] * np.uint64(0x1000003) + shape[1:])
        parts.append(pair * np.uint64(8) + np.uint64(5))
        if len(word) > 2:
            parts.append(mixed(pair[:-1] * np.uint64(0x1000003) + shape[2:]) * np.uint64(8) + np.uint64(6))
    return (mixed(np.concatenate(parts)) % np.uint64(DIMENSIONS - 1) + np.uint64(1)).astype(np.int64)


def vector(text: str | None, table: WordFeatures) -> tuple[np.ndarray, np.ndarray]:
    at, count = np.unique(features(text, table), return_counts=True)
    return at, SCALE * count / count.sum()


def train(examples: list[tuple[int, np.ndarray, np.ndarray]], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Weights after EPOCHS passes of per-coordinate follow-the-regularised-leader over (label, dimensions, values)."""
    z, n = np.zeros(dimensions + 1), np.zeros(dimensions + 1)  # the last is the bias, present in every example
    for _ in range(EPOCHS):
        for label, at, x in examples:
            at, x = np.append(at, dimensions), np.append(x, 1.0)
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            s = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] = zi + g - s * w
            n[at] = ni + g * g
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def score(text: str | None, table: WordFeatures, weights: np.ndarray) -> float:
    at = features(text, table)
    return float(1 / (1 + np.exp(-np.clip(SCALE * weights[at].mean() + weights[-1], -35, 35))))


def fit(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> np.ndarray:
    """Weights learnt from labelled rows whose crc32(doc_id as text) mod 4 is not 2: the first training_rows by hash.

    Labels other than 0 and 1, nulls and rows without a document are left out; of repeated labels the mean is rounded.
    Vectors are made in parallel; the learner, sequential by nature, runs in one task over that bounded sample. With no
    label at all every weight is 0.
    """
    spark = ready(docs.sparkSession)
    key = F.col("doc_id").cast("long")
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(key.alias("label_id")).agg(F.avg("quality").alias("q"))
    known = known.where(F.crc32(F.col("label_id").cast("string")) % 4 != 2)
    chosen = known.orderBy(F.xxhash64("label_id"), "label_id").limit(training_rows)
    sample = texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", F.round("q").cast("int").alias("q"), "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordFeatures()
        for b in batches:
            out = [(d, q, *vector(t, table)) for d, q, t in rows(b, "doc_id", "q", "text")]
            if out:
                d, q, at, x = zip(*out)
                yield pa.record_batch([pa.array(d, pa.int64()), pa.array(q, pa.int32()), pa.array(at, pa.list_(pa.int64())), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "q", "at", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for b in batches:
            at, x = b.column(2), b.column(3)
            for i, (d, q) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                found.append((xxhash.xxh64_intdigest(str(d)), d, len(found), q, at[i].values.to_numpy().astype(np.int32), x[i].values.to_numpy().astype(np.float32)))
        found.sort(key=lambda r: (r[:2], r[3], len(r[4])))
        w = train([r[3:] for r in found])
        at = np.nonzero(w)[0]
        yield pa.record_batch([pa.array(at), pa.array(w[at])], ["at", "w"])

    learnt = sample.mapInArrow(vectors, "doc_id long, q int, at array<long>, x array<double>").repartition(1).mapInArrow(learn, "at long, w double")
    weights = np.zeros(DIMENSIONS + 1)
    for at, w in learnt.collect():  # at most DIMENSIONS + 1 rows
        weights[at] = w
    del spark
    return weights


def quality_scores(docs: DataFrame, weights: np.ndarray, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of docs. Null text scores as the empty text; for a null
    doc_id held_out is false. Very long texts are read whole; other columns are ignored."""
    shared = ready(docs.sparkSession).sparkContext.broadcast(weights.astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, w = WordFeatures(), shared.value
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([score(t, table, w) for (t,) in rows(b, "text")], pa.float64())], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double").select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = 0.7) -> DataFrame:
    """docs whose text scores at least the threshold, all columns as they were."""
    shared = ready(docs.sparkSession).sparkContext.broadcast(weights.astype(np.float64))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, w = WordFeatures(), shared.value
        for b in batches:
            yield b.filter(pa.array([score(t, table, w) >= threshold for (t,) in rows(b, "text")], pa.bool_()))

    return docs.mapInArrow(run, schema)
