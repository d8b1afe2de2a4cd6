"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a pre-token there is exactly one token that can end its encoding (every run of tokens of an
encoding is the encoding of its own text, and a sequence is an encoding if each two neighbours are).  So for each end
position the tokens that end there, found by an automaton over the vocabulary's suffix links, are tried: the one that is
compatible with the last token of the prefix before it is stored.  Back-pointers from the end give the ids.  Two tokens
are compatible if undoing their merges from the seam, latest first, meets no merge across the seam that would have come
earlier.

Work is done once for each distinct pre-token of a worker (``KNOWN_BYTES`` of them are remembered; then only those in use are kept); texts are then assembled
from ragged numpy arrays.  The vocabulary is read on the executors from a path, a parameter.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._io import map_columns, slices, strings

KNOWN_BYTES = 48 << 20  # of the pre-tokens that a worker remembers
PAIRS_MOST = 200_000  # remembered answers about pairs, of about 100 bytes
PIECES_AT_ONCE = 100_000
_ENTRY = 200  # bytes of a remembered pre-token besides its letters


def _byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


# Characters with the White_Space property.
_SPACE = r"\t-\r\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def split_pattern() -> regex.Pattern:
    """The published split pattern of byte-level vocabularies, white space spelled out: the matcher's own class also holds information separators."""
    return regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in text)
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        self.rank, self.parts, self.joins = [-1] * size, [(0, 0)] * size, {}
        for r, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            i = vocab[left + right]
            self.joins[vocab[left], vocab[right]] = r
            if self.rank[i] < 0:
                self.rank[i], self.parts[i] = r, (vocab[left], vocab[right])
        self.matches = ahocorasick.Automaton()
        for i in vocab.values():
            self.matches.add_word(self.bytes[i].decode("latin-1"), (i, len(self.bytes[i])))
        self.matches.make_automaton()
        self.split = split_pattern()
        self.specials = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._fits: dict[int, bool] = {}
        self._alone: dict[int, bool] = {}
        lengths = np.array([len(b) for b in self.bytes])
        self._ends = np.cumsum(lengths)
        self._lengths = lengths
        self._flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self._forget()

    # pair compatibility

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of a's bytes followed by b's is these two tokens (each being its own encoding)."""
        rank, parts, joins = self.rank, self.parts, self.joins
        bound = len(rank)
        while True:
            across = joins.get((a, b))
            if across is not None and across < bound:
                return False
            ra, rb = rank[a], rank[b]
            if ra > rb:
                bound, a = ra, parts[a][1]
            elif rb >= 0:  # equal ranks: the left one was made first, so the right one is undone first
                bound, b = rb + 1, parts[b][0]
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        pair = a * len(self.rank) + b
        known = self._fits.get(pair)
        if known is None:
            if len(self._fits) >= PAIRS_MOST:
                self._fits.clear()
            known = self._fits[pair] = self.compatible(a, b)
        return known

    def alone(self, t: int) -> bool:
        """Whether a token is the encoding of its own bytes: its two parts are, and nothing would part them earlier."""
        known = self._alone.get(t)
        if known is None:
            known = True
            if self.rank[t] >= 0:
                left, right = self.parts[t]
                known = self.alone(left) and self.alone(right) and self._joined_first(left, right, self.rank[t])
            self._alone[t] = known
        return known

    def _joined_first(self, a: int, b: int, bound: int) -> bool:
        """As :meth:`compatible`, but the merge of the two themselves, of rank ``bound``, is the one that is made."""
        joins, rank, parts = self.joins, self.rank, self.parts
        first = True
        while True:
            across = joins.get((a, b))
            if not first and across is not None and across < bound:
                return False
            first = False
            ra, rb = rank[a], rank[b]
            if ra > rb:
                bound, a = ra, parts[a][1]
            elif rb >= 0:
                bound, b = rb + 1, parts[b][0]
            else:
                return True

    # encoding

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        n, size_all, known, alone = len(data), len(self.rank), self._fits, self._alone
        last = [-1] * (n + 1)
        for end, (token, size) in self.matches.iter(data.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            if size == end:
                good = alone.get(token)
                if good is None:
                    good = self.alone(token)
            else:
                before = last[end - size]
                if before < 0:
                    continue
                good = known.get(before * size_all + token)
                if good is None:
                    good = self.fits(before, token)
            if good:
                last[end] = token
        out = []
        while n:
            t = last[n]
            if t < 0:
                raise ValueError("the vocabulary lacks a byte")
            out.append(t)
            n -= len(self.bytes[t])
        return out[::-1]

    def _forget(self, but: set[str] = frozenset()) -> None:
        """Drop all remembered pre-tokens but some known ones."""
        kept = [(p, self._ids[self._bounds[i] : self._bounds[i + 1]].tolist()) for p in sorted(but - self.special.keys()) for i in [self._place[p]]]
        self._place: dict[str, int] = {s: i for i, s in enumerate(self.special)}
        ids = list(self.special.values())
        self._ids = np.array(ids + [0] * 1024, np.int32)
        self._used = len(ids)
        self._bounds = list(range(len(ids) + 1))
        self._held = sum(len(p) + _ENTRY for p, _ in kept)
        self._remember(kept)

    def _learn(self, pieces: set[str]) -> None:
        self._remember([(p, self.encode_piece(p.encode("utf-8", "surrogatepass"))) for p in sorted(pieces)])

    def _remember(self, made: list[tuple[str, list[int]]]) -> None:
        flat = np.array([t for _, ids in made for t in ids], np.int32)
        if self._used + len(flat) > len(self._ids):
            self._ids = np.concatenate((self._ids, np.zeros(max(len(self._ids), len(flat)), np.int32)))
        self._ids[self._used : self._used + len(flat)] = flat
        for p, ids in made:
            self._place[p] = len(self._bounds) - 1
            self._used += len(ids)
            self._bounds.append(self._used)

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens and special strings of a text, in lists of bounded length."""
        for i, part in enumerate(self.specials.split(text) if self.specials and "<" in text else [text]):
            if i % 2:
                yield [part]
            elif len(part) < 4 * PIECES_AT_ONCE:
                yield self.split.findall(part)
            else:
                found = (m[0] for m in self.split.finditer(part))
                while some := list(islice(found, PIECES_AT_ONCE)):
                    yield some

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the bounds of each text in them."""
        out, sizes = [], np.zeros(len(texts), np.int64)
        held: list[str] = []
        owner: list[int] = []
        counts: list[int] = []

        def flush() -> None:
            if not held:
                return
            new = set(held) - self._place.keys()
            cost = sum(map(len, new)) + _ENTRY * len(new)
            if self._held and self._held + cost > KNOWN_BYTES:
                self._forget(set(held) - new)
            self._held += cost
            self._learn(new)
            place = np.fromiter(map(self._place.__getitem__, held), np.int64, len(held))
            bounds = np.array(self._bounds)
            lo, size = bounds[place], bounds[place + 1] - bounds[place]
            stop = np.cumsum(size)
            out.append(self._ids[np.repeat(lo - (stop - size), size) + np.arange(stop[-1])])
            np.add.at(sizes, np.repeat(owner, counts), size)
            held.clear(), owner.clear(), counts.clear()

        for row, text in enumerate(texts):
            for pieces in self._pieces(text):
                held += pieces
                owner.append(row)
                counts.append(len(pieces))
                if len(held) >= PIECES_AT_ONCE:
                    flush()
        flush()
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.concatenate(([0], np.cumsum(sizes)))

    # decoding

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of rows of ids; bytes that are no UTF-8 become U+FFFD."""
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            parts = []
            for lo in range(a, b, PIECES_AT_ONCE):
                some = ids[lo : min(b, lo + PIECES_AT_ONCE)]
                size = self._lengths[some]
                stop = np.cumsum(size)
                parts.append(self._flat[np.repeat(self._ends[some] - stop, size) + np.arange(stop[-1])].tobytes())
            out.append(b"".join(parts).decode("utf-8", "replace"))
        return out


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, decoded): the ids of each whole text, and the text that those ids give.

    Special strings in a text are special tokens; nothing is added, cut or padded.  Null and empty texts: no ids, an empty
    text.  Repeated rows give equal rows; other columns are not read.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(vocabulary)
        for batch in batches:
            for part in slices(batch, 1):
                ids, bounds = use.encode(strings(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), pa.array(use.decode(ids, bounds), pa.string())],
                    ["id", "ids", "decoded"],
                )

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, ids array<int>, decoded string"
    return map_columns(docs, [id_col, text_col], kernel, schema).withColumnRenamed("id", id_col)
