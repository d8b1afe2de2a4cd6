"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item with q shingles is contained in a document that holds need = ceil(threshold * q) of them or more.  The
item's sketch is its bottom-k MinHash: its k = q - need + 1 shingles of least hash.  Whatever the document, fewer than
k of the item's shingles may be absent from it, so a contaminated document shares at least one sketch value: the sketch
works as an exact prefix filter, the candidate search has a recall of 1 however long the document, and the exact count of
common shingles decides.  (A signature of fixed size on the document side cannot do that: for an item of 30 shingles in a
document of 20,000 the Jaccard similarity is about 0.001.  So documents have no signature; they are partitioned by size
in powers of two, and each partition probes only the items that its largest size could contain.)

Items are the query set: they go to the executors in blocks of at most ``block_shingles`` shingles (8 bytes each), one
pass over the documents for each block.  One block is broadcast at a time and released once its pass is written, so
neither the driver nor a worker ever holds more than one.  Documents are not shuffled; copies of a document give rows of
their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._io import map_batches, map_columns, materialize, slices
from ._words import mix, shingle_sets

_BITS = 22
_U = np.uint64


def _sets(column: pa.Array, words: int) -> list[np.ndarray]:
    return shingle_sets(pc.utf8_lower(column), words, "alnum")


class _Probe:
    """Sketch table of the items that a partition of documents could contain."""

    def __init__(self, items: list[tuple[np.ndarray, int]], most: int) -> None:
        hashes, owner = [], []
        for i, (s, need) in enumerate(items):
            if need <= most:
                order = np.argsort(mix(s ^ _U(0x2545F4914F6CDD1D)), kind="stable")
                hashes.append(s[order[: len(s) - need + 1]])
                owner.append(np.full(len(hashes[-1]), i))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes, self.owner = h[order], np.concatenate(owner)[order] if hashes else np.zeros(0, np.int64)
        self.seen = np.zeros(1 << _BITS, dtype=bool)
        self.seen[self.hashes >> _U(64 - _BITS)] = True

    def candidates(self, s: np.ndarray) -> np.ndarray:
        s = s[self.seen[s >> _U(64 - _BITS)]]
        if not len(s) or not len(self.hashes):
            return np.zeros(0, np.int64)
        lo, hi = np.searchsorted(self.hashes, s, "left"), np.searchsorted(self.hashes, s, "right")
        hit = hi > lo
        return np.unique(np.concatenate([self.owner[a:b] for a, b in zip(lo[hit], hi[hit], strict=True)])) if hit.any() else np.zeros(0, np.int64)


def _hits(sets: list[np.ndarray], items: list[tuple[np.ndarray, int]], probes: dict[int, _Probe]) -> Iterator[tuple[int, int, int]]:
    """(row, item, common shingles) of each verified containment; probes: made as size classes are met."""
    for row, s in enumerate(sets):
        if not len(s):
            continue
        size_class = len(s).bit_length()
        if size_class not in probes:
            probes[size_class] = _Probe(items, (1 << size_class) - 1)
        for i in probes[size_class].candidates(s).tolist():
            item, need = items[i]
            common = int((s[np.minimum(np.searchsorted(s, item), len(s) - 1)] == item).sum())
            if common >= need:
                yield row, i, common


def _item_blocks(items: DataFrame, id_col: str, text_col: str, words: int, threshold: tuple[int, int], block_shingles: int) -> Iterator[tuple[bool, Broadcast]]:
    """Whether it is the last one, and a broadcast (ids, [(set, need)]) of each block of about ``block_shingles`` shingles.

    A block is released when the next one is asked for; the caller has written its pass by then.
    """
    num, den = threshold

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, 1)):
            sets = _sets(part.column(1), words)
            at = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["item", "shingles"])

    schema = f"item {items.schema[id_col].dataType.simpleString()}, shingles array<long>"
    sets = materialize(map_columns(items, [id_col, text_col], kernel, schema).where(F.size("shingles") > 0), "items")
    blocks = max(1, math.ceil((sets.agg(F.sum(F.size("shingles"))).first()[0] or 0) / block_shingles))
    shared = None
    for b in range(blocks):
        if shared is not None:
            shared.destroy()
        part = sets.where(F.pmod(F.xxhash64("shingles"), F.lit(blocks)) == b).toArrow()
        lists = part.column("shingles").combine_chunks() if part.num_rows else []
        arrays = [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in lists]
        shared = items.sparkSession.sparkContext.broadcast((part.column("item").to_pylist(), [(a, -(-num * len(a) // den)) for a in arrays]))
        del part, lists, arrays
        yield b == blocks - 1, shared


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    words: int = 5,
    threshold: tuple[int, int] = (80, 100),
    block_shingles: int = 1_000_000,
) -> DataFrame:
    """(item_id, doc_id, n_item_shingles, n_common): each pair in which the document holds ``threshold`` of the item's distinct shingles.

    Words are maximal runs of lower-cased letters and digits (anything beyond ASCII counts as a letter).  A text of
    fewer words than a shingle has one shingle of all of them; a null, empty or wordless text has none: such an item is
    contained nowhere, such a document contains nothing.  Repeated items and documents give a row each; null ids stay
    null.  Empty tables give no rows.  Other columns are not read.
    """
    kinds = [items.schema[item_id_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()]
    found = None
    item_type = to_arrow_type(items.schema[item_id_col].dataType)
    for last, shared in _item_blocks(items, item_id_col, item_text_col, words, threshold, block_shingles):

        def kernel(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            probes: dict[int, _Probe] = {}
            names, wanted = shared.value
            for batch in batches:
                for part in slices(batch, 1):
                    hits = list(_hits(_sets(part.column(1), words), wanted, probes))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([names[i] for _, i, _ in hits], item_type),
                            part.column(0).take(pa.array([r for r, _, _ in hits], pa.int64())),
                            pa.array([len(wanted[i][0]) for _, i, _ in hits], pa.int64()),
                            pa.array([c for _, _, c in hits], pa.int64()),
                        ],
                        ["item", "doc", "n_item_shingles", "n_common"],
                    )

        hits = map_columns(docs, [id_col, text_col], kernel, f"item {kinds[0]}, doc {kinds[1]}, n_item_shingles long, n_common long")
        hits = hits if last else materialize(hits, "hits")
        found = hits if found is None else found.union(hits)
    return found.select(F.col("item").alias(item_id_col), F.col("doc").alias(id_col), "n_item_shingles", "n_common")


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_text_col: str = "text",
    words: int = 5,
    threshold: tuple[int, int] = (80, 100),
    block_shingles: int = 1_000_000,
) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns; rows are judged in place, without a join.

    Null, empty and wordless texts contain nothing and stay; very long texts are read whole; repeated rows all stay or all
    go.  Items with a null or wordless text match nothing; without items all rows stay.  An empty table stays empty.  Names
    of columns don't matter but for the text's.
    """
    at, schema = docs.columns.index(text_col), docs.schema
    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_text_col).alias("text"))
    for last, shared in _item_blocks(numbered, "item", "text", words, threshold, block_shingles):

        def kernel(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            probes: dict[int, _Probe] = {}
            _, wanted = shared.value
            for batch in batches:
                for part in slices(batch, at):
                    clean = np.ones(part.num_rows, dtype=bool)
                    clean[[r for r, _, _ in _hits(_sets(part.column(at), words), wanted, probes)]] = False
                    yield part.filter(pa.array(clean))

        docs = map_batches(docs, kernel, schema)
        docs = docs if last else materialize(docs, "clean")
    return docs
