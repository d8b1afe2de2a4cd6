"""Token counts by rank-synchronous merging of ragged arrays.

Pre-tokens are held in one flat array of symbols with their bounds.  In each round every sequence applies its
lowest-rank pair: at all its places at once where that cannot differ from doing so from left to right (no pair with the
product ranks before it), else at the leftmost.  Sequences without a pair leave; the symbols that remain, or the bytes of
characters beyond the vocabulary, are counted.

A text is cut where no piece of the vocabulary reaches across, a property checked when the model is read.  Counts are made
once for each distinct pre-token of a worker; ``KNOWN_BYTES`` of them are remembered, then only those in use are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from ._io import map_columns, slices, strings

KNOWN_BYTES = 24 << 20  # of the pre-tokens that a worker remembers
PIECES_AT_ONCE = 100_000
SYMBOLS_AT_ONCE = 250_000
_ENTRY = 160  # bytes of a remembered pre-token besides its letters
_NONE = np.int64(1 << 40)
_MARK = "▁"


class Counter:
    """Counts the tokens that a sentencepiece BPE model with byte fallback gives."""

    def __init__(self, path: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        if any(_MARK in p.lstrip(_MARK) or "\n" in p for p in pieces):
            raise ValueError("a piece of this model holds a space after other characters, or a line end")
        single = sorted({c for p in pieces for c in p})
        names = {p: i for i, p in enumerate(dict.fromkeys([*single, *pieces]))}
        order = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        rank = {p: order[s] for p, s in pieces.items()}
        self.weight = np.array([1 if p in pieces else len(p.encode()) for p in names])
        joins = []
        for p in pieces:
            joins += [(names[p[:i]], names[p[i:]], rank[p], names[p]) for i in range(1, len(p)) if p[:i] in names and p[i:] in names]
        self._width = len(names) + 1
        table = np.array(joins, np.int64).reshape(-1, 4)
        key = table[:, 0] * self._width + table[:, 1]
        at = np.argsort(key)
        self._keys, self._ranks, self._made = key[at], table[at, 2], table[at, 3]
        # ranks whose places may all be merged at once: of one piece, and no pair with that piece ranks before it
        together = np.ones(len(order) + 1, dtype=bool)
        owners: dict[int, int] = {}
        for p, r in rank.items():
            if len(p) > 1:
                owners[r] = owners.get(r, 0) + 1
        own = np.full(len(names), -1)
        for p, r in rank.items():
            own[names[p]] = r
        for side in (0, 1):
            bad = table[:, 2] <= own[table[:, side]]
            together[own[table[bad, side]]] = False
        together[[r for r, n in owners.items() if n > 1]] = False
        self._together = together
        self._code = np.full(0x110000, -1, np.int32)
        self._code[[ord(c) for c in single]] = [names[c] for c in single]
        self._cut = self._pattern(pieces)
        self._known: dict[str, int] = {}
        self._held = 0

    @staticmethod
    def _pattern(pieces: dict[str, float]) -> re.Pattern:
        """Cuts at spaces, line ends, and between marks of a set and all else where no piece reaches across."""
        marks = {c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum()}
        while True:
            bad = {
                c for p in pieces for a, b in zip(p, p[1:], strict=False) for c, d in ((a, b), (b, a)) if c in marks and d not in marks and not (d == _MARK and (d, c) == (a, b))
            }
            if not bad:
                break
            marks -= bad
        inside = re.escape("".join(sorted(marks)))
        if not inside:
            return re.compile(rf"\n|{_MARK}*[^{_MARK}\n]+|{_MARK}+")
        return re.compile(rf"\n|{_MARK}*[^{_MARK}\n{inside}]+|{_MARK}*[{inside}]+|{_MARK}+")

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (a large number if it doesn't merge) and its place in the table."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self._width + right, -1)
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], _NONE), at

    def count_pieces(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each pre-token, all merged together."""
        total = np.zeros(len(pieces), np.int64)
        lengths = np.array([len(p) for p in pieces], np.int64)
        points = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self._code[points].astype(np.int64)
        owner = np.repeat(np.arange(len(pieces)), lengths)
        # characters beyond the vocabulary fall back to their bytes
        lost = symbols < 0
        if lost.any():
            p = points[lost]
            total += np.bincount(owner[lost], 1 + (p > 0x7F) + (p > 0x7FF) + (p > 0xFFFF), len(pieces)).astype(np.int64)
        while len(symbols):
            rank = np.full(len(symbols), _NONE)
            place = np.zeros(len(symbols), np.int64)
            if len(symbols) > 1:
                rank[:-1], place[:-1] = self._rank(symbols[:-1], symbols[1:])
                rank[:-1][owner[1:] != owner[:-1]] = _NONE
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sizes = np.diff(np.append(starts, len(symbols)))
            least = np.minimum.reduceat(rank, starts)
            over = np.repeat(least == _NONE, sizes)
            if over.any():
                done = over & (symbols >= 0)
                total += np.bincount(owner[done], self.weight[symbols[done]], len(pieces)).astype(np.int64)
                symbols, owner, rank, place = symbols[~over], owner[~over], rank[~over], place[~over]
                sizes, least = sizes[least != _NONE], least[least != _NONE]
                if not len(symbols):
                    break
            low = np.repeat(least, sizes)
            chosen = np.flatnonzero(rank == low)
            # of touching places take the first, third, ... of each run, as from left to right
            fresh = np.concatenate(([True], chosen[1:] != chosen[:-1] + 1))
            first = chosen[np.maximum.accumulate(np.where(fresh, np.arange(len(chosen)), 0))]
            chosen = chosen[(chosen - first) % 2 == 0]
            alone = ~self._together[low[chosen]]
            if alone.any():
                same = np.concatenate(([False], owner[chosen[1:]] == owner[chosen[:-1]]))
                chosen = chosen[~(alone & same)]
            symbols[chosen] = self._made[place[chosen]]
            stay = np.ones(len(symbols), dtype=bool)
            stay[chosen + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        return total

    def _learn(self, pieces: list[str]) -> None:
        lo = 0
        while lo < len(pieces):
            hi, size = lo, 0
            while hi < len(pieces) and (hi == lo or size + len(pieces[hi]) <= SYMBOLS_AT_ONCE):
                size += len(pieces[hi])
                hi += 1
            self._known.update(zip(pieces[lo:hi], self.count_pieces(pieces[lo:hi]).tolist(), strict=True))
            lo = hi

    def _pieces(self, text: str) -> Iterator[list[str]]:
        if not text:
            return
        text = _MARK + text.replace(" ", _MARK)
        if len(text) < 4 * PIECES_AT_ONCE:
            yield self._cut.findall(text)
        else:
            found = (m[0] for m in self._cut.finditer(text))
            while some := list(islice(found, PIECES_AT_ONCE)):
                yield some

    def count(self, texts: list[str]) -> list[int]:
        totals = [0] * len(texts)
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            used = set().union(*(p for _, p in held))
            new = used - self._known.keys()
            cost = sum(map(len, new)) + _ENTRY * len(new)
            if self._held and self._held + cost > KNOWN_BYTES:
                self._known = {p: self._known[p] for p in used - new}
                self._held = sum(len(p) + _ENTRY for p in self._known)
            self._held += cost
            self._learn(sorted(new))
            for row, pieces in held:
                totals[row] += sum(map(self._known.__getitem__, pieces))
            held.clear()

        for row, text in enumerate(texts):
            for pieces in self._pieces(text):
                held.append((row, pieces))
                size += len(pieces)
                if size >= PIECES_AT_ONCE:
                    flush()
                    size = 0
        flush()
        return totals


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens) of each whole text; null and empty texts have 0 of both.

    Nothing is added, cut or padded, and special strings are ordinary text.  Repeated rows give equal rows; other columns
    are not read.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = counter(model)
        for part in (p for b in batches for p in slices(b, 1)):
            texts = strings(part.column(1))
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(use.count(texts), pa.int64())], ["id", "n_bytes", "n_tokens"])

    out = map_columns(docs, [id_col, text_col], kernel, f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumnRenamed("id", id_col)
