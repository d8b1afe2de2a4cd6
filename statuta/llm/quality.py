"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a text are the counts of its words and word pairs in hashed buckets, scaled to unit length.  Training runs in one executor task over a bounded, documented sample of
labelled rows (``max_rows`` of least id hash), example by example with FTRL-proximal steps; the weights, one float for
each bucket, are broadcast.  A score is a sparse dot product, made for a whole batch in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import map_columns, materialize, ship, slices
from ._words import mix, word_hashes

BUCKET_BITS = 20
MAX_ROWS = 8_000
_U = np.uint64


def _features(words: np.ndarray) -> np.ndarray:
    """Bucket of each word and word pair of one text."""
    if not len(words):
        return np.zeros(0, np.int64)
    pairs = mix(words[:-1] * _U(0x9E3779B97F4A7C15) + words[1:])
    return (mix(np.concatenate((words, pairs))) >> _U(64 - BUCKET_BITS)).astype(np.int64)


def _vector(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets without repeats, with the bias last, and their values."""
    at, n = np.unique(_features(words), return_counts=True)
    value = n / np.sqrt((n * n).sum()) if len(n) else n.astype(float)
    return np.append(at, 1 << BUCKET_BITS), np.append(value, 1.0)


def ftrl(vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = 2, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.0, l2: float = 1e-4) -> np.ndarray:
    """Weights after FTRL-proximal updates on each example in turn; the last one is the bias."""
    z, n = np.zeros((1 << BUCKET_BITS) + 1), np.zeros((1 << BUCKET_BITS) + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(epochs):
        for (at, x), y in zip(vectors, labels, strict=True):
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip((w * x).sum(), -35, 35))) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(np.arange(len(z))).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, **options) -> np.ndarray:
    """Weights learned from the ``max_rows`` labelled rows of least id hash.

    Labels other than 0 and 1 and null ids are left out; an id with several labels counts as the larger one.  A null text is
    an empty one; of an id with several texts the least is the example, so repeated rows add none and the bound holds.  Very
    long texts are read whole.  Without examples all weights are 0, every score 0.5.  Other columns are not read.
    """
    ship(docs.sparkSession)
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    chosen = usable.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id").groupBy("id", "h", "y").agg(F.min("text").alias("text"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                words, at = word_hashes(part.column(2))
                v = [_vector(words[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                ends = pa.array(np.concatenate(([0], np.cumsum([len(b) for b, _ in v]))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in ([b.astype(np.int32) for b, _ in v], [x.astype(np.float32) for _, x in v])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], ["h", "y", "at", "x"])

    vectors = materialize(map_columns(rows, ["h", "y", "text"], kernel, "h long, y int, at array<int>, x array<float>"), "examples")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(size=[len(a) for a in pdf["at"]]).sort_values(["h", "size", "y"], kind="stable")
        w = ftrl([(np.asarray(a), np.asarray(x, dtype=float)) for a, x in zip(pdf["at"], pdf["x"], strict=True)], pdf["y"].tolist(), **options)
        return pd.DataFrame({"w": [w.tobytes()]})

    learned = vectors.groupBy(F.lit(1).alias("all")).applyInPandas(learn, "w binary").first()
    return np.frombuffer(bytes(learned["w"]), np.float32) if learned else np.zeros((1 << BUCKET_BITS) + 1, np.float32)


def scores(weights: np.ndarray, column: pa.Array) -> np.ndarray:
    """Probability of label 1 of each text; an empty text has the bias alone."""
    words, at = word_hashes(column)
    out = np.full(len(column), float(weights[-1]))
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if b > a:
            where, n = np.unique(_features(words[a:b]), return_counts=True)
            out[i] += float((weights[where].astype(float) * n).sum() / np.sqrt(float((n * n).sum())))
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of each row's whole text; null: as empty.  Repeated rows get equal rows; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores(shared.value, part.column(1)))], ["id", "score"])

    return map_columns(docs, [id_col, text_col], kernel, f"id {docs.schema[id_col].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
