"""Vectorised words and word shingles: 64-bit hashes straight from the UTF-8 bytes of an Arrow batch.

A word hash is a polynomial over random byte values, taken from prefix sums modulo 2**64, so no Python
object is made for a word.  Long texts are cut between words into slices, so memory follows the number of
words and not a multiple of the bytes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(2)
def _powers(inverse: bool) -> np.ndarray:
    base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    out = np.full(SLICE + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(4)
def _tables(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: whether it belongs to a word, and its random value after folding A-Z."""
    word = np.ones(256, dtype=bool)
    if kind == "space":
        word[[0x20, *range(0x09, 0x0E)]] = False
    elif kind == "alnum":
        word[:128] = False
        for first, last in ("09", "AZ", "az"):
            word[ord(first) : ord(last) + 1] = True
    else:
        raise ValueError(kind)
    value = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95)) | _U(1)
    value[65:91] = value[97:123]
    return word, value


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null: empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def word_hashes(column: pa.Array, kind: str = "space") -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of each row, and the bounds of the rows in them (one more than rows).

    kind: ``space`` takes maximal runs of anything but ASCII white space, ``alnum`` maximal runs of ASCII
    letters and digits and of anything beyond ASCII.  A-Z are folded.
    """
    data, at = utf8(column)
    n = len(data)
    is_word, value = _tables(kind)
    cut = np.zeros(n + 1, dtype=bool)
    cut[at] = True
    hashes, starts = [], []
    lo = 0
    while lo < n:
        hi = min(n, lo + SLICE)
        if hi < n:
            back = np.flatnonzero(~is_word[data[lo:hi]] | cut[lo:hi])
            if len(back) and back[-1] > 0:
                hi = lo + int(back[-1])
            else:  # one word longer than a slice: up to its end
                while hi < n and not cut[hi] and is_word[data[hi]]:
                    stop = np.flatnonzero(~is_word[data[hi : hi + SLICE]] | cut[hi : hi + SLICE][: len(data[hi : hi + SLICE])])
                    hi += int(stop[0]) if len(stop) else len(data[hi : hi + SLICE])
                    if len(stop):
                        break
        piece = data[lo:hi]
        w = is_word[piece]
        edge = cut[lo:hi]
        first = w.copy()
        first[1:] &= ~w[:-1] | edge[1:]
        last = w.copy()
        last[:-1] &= ~w[1:] | edge[1:]
        s = np.flatnonzero(first)
        e = np.flatnonzero(last) + 1
        if len(s):
            if len(piece) <= SLICE:
                sums = np.zeros(len(piece) + 1, dtype=np.uint64)
                np.cumsum(value[piece] * _powers(False)[: len(piece)], out=sums[1:])
                h = (sums[e] - sums[s]) * _powers(True)[s]
            else:
                h = np.array([_long(value[piece[a:b]]) for a, b in zip(s.tolist(), e.tolist(), strict=True)], dtype=np.uint64)
            hashes.append(mix(h + (e - s).astype(np.uint64)))
            starts.append(s + lo)
        lo = hi
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    start = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(start, at, side="left")


def _long(values: np.ndarray) -> int:
    """The polynomial of one word longer than a slice, piece by piece."""
    total, scale = 0, 1
    step = pow(_BASE, SLICE, 1 << 64)
    for i in range(0, len(values), SLICE):
        part = values[i : i + SLICE]
        total = (total + scale * int((part * _powers(False)[: len(part)]).sum(dtype=np.uint64))) % (1 << 64)
        scale = scale * step % (1 << 64)
    return total


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k successive words of one row; with fewer words, the one of them all; without words, none."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    h = mix(words[: n - width + 1] + _U(width))
    for j in range(1, width):
        h = mix(h * _U(0xD6E8FEB86659FD93) + words[j : n - width + 1 + j])
    h.sort()
    if len(h) > 1:
        h = h[np.concatenate(([True], h[1:] != h[:-1]))]
    return h


def shingle_sets(column: pa.Array, k: int, kind: str = "space") -> list[np.ndarray]:
    """The shingle set of each row."""
    words, at = word_hashes(column, kind)
    return [shingles(words[a:b], k) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
