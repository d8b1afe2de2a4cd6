"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams of each language over all labelled rows: a task emits only the buckets that it saw, and
Spark sums them with partial aggregation.  The log-probability matrix has languages x buckets cells, a bound that is
checked before it is sent to the executors.  Scoring gathers matrix cells for the n-grams of a whole batch in numpy and
sums them by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import map_batches, map_columns, slices, strings

BUCKET_BITS = 17
ORDERS = (1, 2, 3)
MAX_CELLS = 1 << 26
SLICE = 1 << 18
_U = np.uint64
_LETTER = regex.compile(r"\p{L}")


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id's text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each between two spaces, and the bounds of the texts."""
    padded = [f" {t} " for t in texts]
    at = np.concatenate(([0], np.cumsum([len(t) for t in padded])))
    return np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32), at


def grams(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, buckets, row starts in them) of slices of rows; a long text comes in several slices of its own."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= SLICE):
            size += len(texts[hi]) + 2
            hi += 1
        if hi == lo + 1 and size > SLICE:
            text, most = f" {texts[lo]} ", max(ORDERS) - 1
            for a in range(0, len(text), SLICE):
                points = np.frombuffer(text[a : a + SLICE + most].encode("utf-32-le", "surrogatepass"), np.uint32)
                yield lo, hi, np.concatenate([_hash(points, n)[:SLICE] for n in ORDERS]), np.zeros(1, np.int64)
        else:
            points, at = _code_points(texts[lo:hi])
            rows = np.repeat(np.arange(hi - lo), np.diff(at))
            parts, owner = [], []
            for n in ORDERS:
                same = rows[: len(rows) - n + 1] == rows[n - 1 :]
                parts.append(_hash(points, n)[same])
                owner.append(rows[: len(rows) - n + 1][same])
            # rows of one order are ascending; the starts of each order come one after the other
            for part, own in zip(parts, owner, strict=True):
                yield lo, hi, part, np.searchsorted(own, np.arange(hi - lo))
        lo = hi


def _hash(points: np.ndarray, n: int) -> np.ndarray:
    if len(points) < n:
        return np.zeros(0, np.int64)
    h = points[: len(points) - n + 1].astype(np.uint64) + _U(n)
    for j in range(1, n):
        h = h * _U(0x9E3779B97F4A7C15) + points[j : len(points) - n + 1 + j]
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return (h >> _U(64 - BUCKET_BITS)).astype(np.int64)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # languages x buckets, float32
    log_prior: np.ndarray


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", alpha: float = 0.5) -> LanguageModel:
    """Model of all rows with a text and a language.  Without any, the model has no language and rejects every text.

    Rows with a null text or language are left out, empty texts count in the prior alone, repeated rows count each time, and
    very long texts are counted in slices.  Ties do not occur.  Other columns are not read.  A language column of more values
    than a matrix of ``MAX_CELLS`` cells has rows is refused before anything is counted.
    """
    most = MAX_CELLS >> BUCKET_BITS
    values = docs.where(F.col(lang_col).isNotNull()).select(lang_col).distinct().limit(most + 1).count()
    if values > most:
        raise ValueError(f"more than {most} languages: their matrix is not sent to every executor")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for part in (p for b in batches for p in slices(b, 0, 1000)):
            langs = part.column(1).to_pylist()
            texts = strings(pc.utf8_lower(part.column(0)))
            for lang in sorted(set(langs)):
                mine = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                total = counts.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                rows[lang] = rows.get(lang, 0) + len(mine)
                for _, _, buckets, _ in grams(mine):
                    total += np.bincount(buckets, minlength=1 << BUCKET_BITS)
        for lang, total in counts.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows[lang]))], ["lang", "bucket", "n"]
            )

    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(text_col, F.col(lang_col).cast("string").alias(lang_col))
    counts = map_columns(known, [text_col, lang_col], kernel, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # at most languages x (buckets + 1) rows, however many documents
    languages = sorted(set(table.column("lang").to_pylist()))
    place = {x: i for i, x in enumerate(languages)}
    row = np.array([place[x] for x in table.column("lang").to_pylist()], np.int64)
    bucket, n = table.column("bucket").to_numpy(), table.column("n").to_numpy()
    total = np.zeros((len(languages), 1 << BUCKET_BITS))
    total[row[bucket >= 0], bucket[bucket >= 0]] = n[bucket >= 0]
    rows = np.zeros(len(languages))
    rows[row[bucket < 0]] = n[bucket < 0]
    prob = (total + alpha) / (total + alpha).sum(axis=1, keepdims=True)
    return LanguageModel(languages, np.log(prob).astype(np.float32), np.log(rows / max(rows.sum(), 1)) if len(rows) else rows)


def score(model: LanguageModel, texts: list[str]) -> np.ndarray:
    """Log-likelihood with prior of each text (lower-cased) in each language."""
    out = np.tile(model.log_prior, (len(texts), 1))
    for lo, hi, buckets, starts in grams(texts):
        if not len(buckets):
            continue
        # reduceat needs starts inside the array and gives one cell for an empty row, whose sum is 0
        empty = np.append(starts[1:], len(buckets)) == starts
        for k in range(len(model.languages)):
            sums = np.add.reduceat(model.log_prob[k][buckets].astype(np.float64), np.minimum(starts, len(buckets) - 1))
            sums[empty] = 0
            out[lo:hi, k] += sums
    return out


def predictions(model: LanguageModel, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language (``und`` for a null text or one without a letter) and posterior of each row."""
    texts = strings(column)
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts))
    # the letter test is on the text as it is
    lettered = np.array([_LETTER.search(t) is not None for t in texts], dtype=bool)
    logs = score(model, strings(pc.utf8_lower(column)))
    best = logs.argmax(axis=1) if len(texts) else np.zeros(0, np.int64)
    top = logs.max(axis=1, initial=-np.inf, keepdims=True)
    posterior = 1 / np.exp(logs - top).sum(axis=1)
    return [model.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], np.where(lettered, posterior, 0.0)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) of each row; score: posterior of the language, 0 for ``und``.

    Ties go to the language that sorts first.  Null, empty and letterless texts: ``und``.  Repeated rows get equal rows;
    other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, 1, 1000)):
            lang, p = predictions(shared.value, part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(p, pa.float64())], ["id", "lang_pred", "score"])

    out = map_columns(docs, [id_col, text_col], kernel, f"id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is not ``und``, with all their columns.

    Rows with a null, empty or letterless text go, and all rows if the model has no language.  Repeated rows all stay or all
    go; very long texts are read whole; an empty table stays empty.  Names of columns don't matter but for the text's.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, at, 1000)):
            lang, _ = predictions(shared.value, part.column(at))
            yield part.filter(pa.array([x != "und" for x in lang], pa.bool_()))

    return map_batches(docs, kernel, docs.schema)
