"""Secret scans: base patterns, and character Markov models of random strings and of ordinary identifiers.

Two second-order character models are trained from labelled samples: strings drawn at random from the alphabets that
keys use (label 1) and ordinary words and identifiers (label 0).  A run of key characters, or a sub-run of it, is a secret
if its log-likelihood ratio, random against ordinary, is ``min_ratio`` nats a character or more.  Base spans stay as they
are; the model adds spans (kind ``markov``) in what they leave of the runs.

A base span is the whole match; spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import map_batches, map_columns, slices, strings

# The base patterns and the least length of what they must find.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

LEAST = 16  # of a run that the models judge: the least length that they are trained on
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
MIN_RATIO = 2.5
RANDOM_STRINGS = 6000
TOKENS_AT_ONCE = 50_000  # that a worker counts together
WORDS_AT_ONCE = 100_000  # distinct ones that a worker holds before it hands them on
_N = len(ALPHABET) + 1  # the last class: anything else, and the ends
_CLASS = np.full(256, _N - 1, dtype=np.int64)
_CLASS[[ord(c) for c in ALPHABET]] = np.arange(_N - 1)


def trigram_counts(tokens: list[str], times: list[int] | None = None) -> np.ndarray:
    """Counts of (two characters, next character) over ASCII tokens, each with two ends before and one after it, ``times`` over."""
    joined = "".join(f"\x00\x00{t}\x00" for t in tokens).encode("ascii", "replace")
    if not joined:
        return np.zeros(_N**3, np.int64)
    c = _CLASS[np.frombuffer(joined, np.uint8)]
    size = np.array([len(t) + 3 for t in tokens])
    inside, stop = np.ones(len(c), dtype=bool), np.cumsum(size)
    inside[stop - 1] = inside[stop - 2] = False  # other windows run from one token into the next
    weight = np.repeat(np.ones(len(tokens)) if times is None else times, size)[:-2][inside[:-2]]
    return np.bincount(((c[:-2] * _N + c[1:-1]) * _N + c[2:])[inside[:-2]], weight, _N**3).astype(np.int64)


def log_model(counts: np.ndarray, k: float = 0.05) -> np.ndarray:
    """log P(next | two before), smoothed with the model of one character before and that with the uniform one."""
    tri = counts.reshape(_N, _N, _N).astype(float)
    bi, uniform = tri.sum(axis=0), 1 / _N
    p_bi = (bi + 2 * uniform) / (bi.sum(axis=1, keepdims=True) + 2)
    weight = k * _N
    return np.log((tri + weight * p_bi[None]) / (tri.sum(axis=2, keepdims=True) + weight)).reshape(-1)


def random_strings(n: int = RANDOM_STRINGS, seed: int = 11) -> list[str]:
    """Labelled sample of label 1: uniform strings over the alphabets of common keys."""
    draw = random.Random(seed)
    upper, lower, digits = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
    kinds = (digits + "abcdef", digits + "ABCDEF", upper + "234567", upper + digits, lower + digits, upper + lower + digits, ALPHABET[:64], upper + lower + digits + "_-")
    return ["".join(draw.choices(kinds[i % len(kinds)], k=draw.randint(LEAST, 64))) for i in range(n)]


def identifiers(words: list[str], n: int, seed: int = 12) -> list[str]:
    """Labelled sample of label 0: identifiers, paths and dates made of ordinary words."""
    draw = random.Random(seed)
    forms = (
        lambda w: "_".join(w), lambda w: "-".join(w), lambda w: "/".join(w), lambda w: w[0] + "".join(x.title() for x in w[1:]),
        lambda w: "_".join(w).upper(), lambda w: f"{w[0]}{draw.randint(0, 999)}", lambda w: f"{draw.randint(1990, 2030)}-{draw.randint(10, 12)}-{draw.randint(10, 28)}",
        lambda w: "-" * draw.randint(3, 40), lambda w: "=" * draw.randint(3, 40), lambda w: "_" * draw.randint(3, 40),
    )
    return [forms[i % len(forms)](draw.choices(words, k=draw.randint(2, 4))) for i in range(n)] if words else []


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns' matches that are long enough."""
    found: list[tuple[int, int, str]] = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def _order(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def train(samples: DataFrame, token_col: str = "token", label_col: str = "label", times_col: str | None = None) -> np.ndarray:
    """Table of log-likelihood ratios of (two characters, next), from labelled tokens; counted on the executors.

    Tokens that hold other characters are cut to runs of the alphabet; label 1 is random, 0 ordinary.  Rows with any other
    label or a null token, label or times count nothing; repeated rows count each time.  Without rows both models are
    uniform and all ratios 0.  Other columns are not read.
    """
    piece = re.compile(r"[A-Za-z0-9+/_=-]+")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {0: np.zeros(_N**3, np.int64), 1: np.zeros(_N**3, np.int64)}
        held: dict[int, list[tuple[str, int]]] = {0: [], 1: []}
        for part in (p for b in batches for p in slices(b, 0, 50_000, 1 << 20)):
            for t, x, n in zip(strings(part.column(0)), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                if x in total and n:
                    held[x] += [(p, n) for p in piece.findall(t)]
            for label, found in held.items():
                if len(found) > TOKENS_AT_ONCE:
                    total[label] += trigram_counts([p for p, _ in found], [n for _, n in found])
                    found.clear()
        for label, found in held.items():
            total[label] += trigram_counts([p for p, _ in found], [n for _, n in found])
        yield from (_cells(label, c) for label, c in total.items())

    times = F.lit(1) if times_col is None else F.col(times_col)
    rows = samples.select(F.col(token_col).alias("token"), F.col(label_col).cast("long").alias("label"), times.cast("long").alias("times"))
    counts = _summed(map_columns(rows, ["token", "label", "times"], kernel, "label long, cell long, n long"))
    return (log_model(counts[1]) - log_model(counts[0])).astype(np.float32)


def _cells(label: int, counts: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), label)), pa.array(at), pa.array(counts[at])], ["label", "cell", "n"])


def _summed(cells: DataFrame) -> np.ndarray:
    """Counts of both labels, from the cells of all tasks."""
    table = cells.groupBy("label", "cell").agg(F.sum("n").alias("n")).toArrow()  # at most two rows for each of 68**3 cells
    counts = np.zeros((2, _N**3))
    counts[table.column("label").to_numpy(), table.column("cell").to_numpy()] = table.column("n").to_numpy()
    return counts


def learn(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """What :func:`train` makes of :func:`labelled_samples`, counted where the texts are read: no token leaves its task."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_N**3, np.int64)
        for tokens, times in _ordinary(batches):
            total += trigram_counts(tokens, times)
        yield _cells(0, total)

    counts = _summed(map_columns(docs, [text_col], kernel, "label long, cell long, n long"))
    return (log_model(trigram_counts(random_strings())) - log_model(counts[0])).astype(np.float32)


_WORD = re.compile(r"[A-Za-z][a-z]*(?:[_-][A-Za-z]+)*")


def _ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[int]]]:
    """Tokens and how often they stand: words of a task's texts, and identifiers made of them, a quarter as many by times."""

    def counted(held: Counter) -> tuple[list[str], list[int]]:
        words: Counter = Counter()
        for token, n in held.items():
            bare = token.strip(".,;:!?\"'()")
            if _WORD.fullmatch(bare):
                words[bare] += n
        names = sorted(words)
        made = identifiers(names, max(1, len(names) // 4))
        each = max(1, round(words.total() / 4 / max(1, len(made))))
        return [*names, *made], [words[w] for w in names] + [each] * len(made)

    held: Counter = Counter()
    for part in (p for b in batches for p in slices(b, 0)):
        for text in strings(part.column(0)):
            done = 0
            for a, b, _ in sorted(base_spans(text)):
                held.update(text[done:a].split())
                done = max(done, b)
            held.update((text[done:] if done else text).split())
        if len(held) > WORDS_AT_ONCE:
            yield counted(held)
            held.clear()
    yield counted(held)


def labelled_samples(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, label, times): random strings, and words of all documents with identifiers made of them.

    Words are counted by each task, ``WORDS_AT_ONCE`` distinct ones at a time, over whole texts and all rows; the models have
    68**3 cells whatever the corpus.  Tokens inside base spans and tokens with a digit are not taken for ordinary ones.  Null
    and empty texts give nothing, repeated rows count each time, an empty table gives random strings alone.
    """
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, times in _ordinary(batches):
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(np.zeros(len(tokens), np.int64)), pa.array(times, pa.int64())], ["token", "label", "times"])

    drawn = spark.createDataFrame([(t, 1, 1) for t in random_strings()], "token string, label long, times long")
    return map_columns(docs, [text_col], kernel, "token string, label long, times long").union(drawn)


def model_spans(run: str, ratio: np.ndarray, min_ratio: float = MIN_RATIO) -> list[tuple[int, int]]:
    """(start, end) in a run of key characters: the whole run where its mean ratio suffices, else its sub-runs of which it does.

    A sub-run has ``LEAST`` characters or more.  Any longer one that suffices holds one of ``LEAST`` to 2 * ``LEAST`` - 1
    characters that does, so windows of these lengths find all, in time that grows with the run.  Windows that touch are
    one span; ordinary words that they took in are cut from its ends, where the sum of ratios is largest, but letters and
    digits that are joined to the rest stay.
    """
    n = len(run)
    if n < LEAST:
        return []
    c = _CLASS[np.frombuffer(b"\x00\x00" + run.encode() + b"\x00", np.uint8)]
    each = ratio[(c[:-2] * _N + c[1:-1]) * _N + c[2:]].astype(np.float64)
    if each.sum() >= min_ratio * n:
        return [(0, n)]
    total = np.concatenate(([0.0], np.cumsum(each[:n])))
    above = total - min_ratio * np.arange(n + 1)
    edges = np.zeros(n + 1, np.int64)
    for size in range(LEAST, min(2 * LEAST - 1, n) + 1):
        at = np.flatnonzero(above[size:] >= above[:-size])
        edges[at] += 1
        edges[at + size] -= 1
    inside = np.concatenate(([0], np.cumsum(edges) > 0)).astype(np.int8)
    out = []
    for a, b in np.flatnonzero(np.diff(inside)).reshape(-1, 2).tolist():
        start = a + int(total[a : a + LEAST].argmin())
        while start > a and run[start - 1].isalnum():
            start -= 1
        end = b - int(total[b - LEAST + 1 : b + 1][::-1].argmax())
        while end < b and run[end].isalnum():
            end += 1
        out.append((start, end) if end - start >= LEAST else (a, b))
    return out


def all_spans(text: str, ratio: np.ndarray, min_ratio: float = MIN_RATIO) -> list[tuple[int, int, str]]:
    """Base spans and those that the models add to what the base spans leave of each run, by start and then kind."""
    base = base_spans(text)
    found = list(base)
    cuts = sorted((x, y) for x, y, _ in base)
    k = 0
    for m in RUN.finditer(text):
        at, end = m.span()
        while k < len(cuts) and cuts[k][1] <= at:
            k += 1
        pieces, j = [], k
        while j < len(cuts) and cuts[j][0] < end:
            pieces.append((at, cuts[j][0]))
            at = max(at, cuts[j][1])
            j += 1
        pieces.append((at, end))
        found += [(a + s, a + e, "markov") for a, b in pieces if b - a >= LEAST for s, e in model_spans(text[a:b], ratio, min_ratio)]
    return sorted(found, key=_order)


def _joined(spans: Iterable[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text", min_ratio: float = MIN_RATIO) -> DataFrame:
    """(id_col, secrets) of each row: array of (kind, start, end, value), by start and then kind.

    Null and empty texts: an empty array.  Texts are scanned whole; repeated rows give equal rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, 1)):
            rows = [[{"kind": k, "start": a, "end": b, "value": t[a:b]} for a, b, k in all_spans(t, shared.value, min_ratio)] for t in strings(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], ["id", "secrets"])

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, secrets array<struct<kind:string,start:long,end:long,value:string>>"
    return map_columns(docs, [id_col, text_col], kernel, schema).withColumnRenamed("id", id_col)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of each base kind, hash of the base spans, and all spans, from :func:`scan`."""
    base = F.filter("secrets", lambda s: s["kind"] != "markov")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return scanned.select(
        id_col, *[count(k) for k in KINDS], F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans")
    )


def mask(docs: DataFrame, ratio: np.ndarray, text_col: str = "text", min_ratio: float = MIN_RATIO, word: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret of ``text_col`` replaced by ``word``; overlapping spans become one.  Other columns stay."""
    shared, at = docs.sparkSession.sparkContext.broadcast(ratio), docs.columns.index(text_col)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, at)):
            texts = part.column(at).to_pylist()
            for i, t in enumerate(texts):
                if t:
                    texts[i] = masked(t, all_spans(t, shared.value, min_ratio), word)
            columns = list(part.columns)
            columns[at] = pa.array(texts, part.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return map_batches(docs, kernel, docs.schema)


def masked(text: str, spans: list[tuple[int, int, str]], word: str) -> str:
    out, done = [], 0
    for a, b, _ in spans:
        if a >= done:
            out += [text[done:a], word]
        done = max(done, b)
    return "".join([*out, text[done:]]) if spans else text


def sha256_of(spans: Iterable[tuple[int, int, str]]) -> str:
    """Hash of base spans as :func:`digest` makes it; for checks."""
    return hashlib.sha256(_joined(s for s in sorted(spans, key=_order) if s[2] != "markov").encode()).hexdigest()
