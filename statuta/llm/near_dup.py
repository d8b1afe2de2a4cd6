"""MinHash near-duplicate detection with fast similarity sketching.

Sketch (Dahlgaard, Knudsen and Thorup, "Fast Similarity Sketching", 2017): in round i every shingle draws a bin
and a value; a bin keeps the least value of the first round that reached it.  In rounds t..2t-1 all shingles go to
bin i-t, so after 2t rounds every one of the t coordinates is filled, and the share of equal coordinates estimates
the Jaccard similarity with Chernoff-type bounds in O(n + t log t) hash evaluations instead of n*t.

Plan
1. One pass over the texts: set size, a 128-bit fingerprint of the full shingle set, and band keys of the sketch.
2. Rows with equal sets form a class by their fingerprint; only its least id goes on, so thousands of copies are one node.
3. Each band bucket ties its members to its least member, its head (a star: rows stay linear in the bucket).  What the
   buckets of one head hold is a star set, and any two members of one bucket are in one star set.  Where a head has a
   lesser head of its own, its star set goes over to that one, so the many heads of a tight group are one.
4. Each member sits in the star set of its least head.  A star set is dealt into blocks of bounded size, the head in all
   of them; a task takes one block and emits a forest of the links in it, confirmed on the full sets.  Components follow.
5. A star set is open while it holds several components and not all of its members met in one block.  It has a settled
   side, whose members are one component or met in one block (the larger of the two), and the rest; both are dealt into
   blocks.  A task takes a block of each, or two of the rest.  So every pair of a bucket is either in one component or
   compared on the full sets, no row per pair is made, and the members of a large component are sent once for each block
   of the rest and not for each block of their own.
6. Components of all confirmed links.

Inside a task candidates come from an exact prefix filter: of two sets with a similarity of s or more, those of the first
n - ceil(s * n) + 1 shingles of each, rarest in the task first, must share one.

With ``bands`` bands of ``rows`` coordinates a link at the threshold is missed with probability (1 - s^rows)^bands; rows
is the largest for which that is 1e-8 or less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import discard, give_back, limit_batches, map_columns, materialize, ship, slices
from ._words import mix, shingle_sets
from .components import connected_components

BLOCK = 1024  # members of a block
BLOCK_SHINGLES = 1 << 18  # shingles of a block
MOST_BITS = 1 << 28  # of a bitmap: 32 MB
_U = np.uint64


@lru_cache(8)
def _seeds(t: int) -> np.ndarray:
    return mix(np.arange(1, 2 * t + 1, dtype=np.uint64) * _U(0xA0761D6478BD642F))


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketch of each set: rows of t 64-bit coordinates (an empty set: all ones)."""
    full = np.full((len(sets), t), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat = full.reshape(-1)
    seeds = _seeds(t)
    live = np.array([i for i, s in enumerate(sets) if len(s)], dtype=np.int64)
    empty = _U(np.iinfo(np.uint64).max)
    i = 0
    while len(live) and i < 2 * t:
        items = np.concatenate([sets[k] for k in live])
        base = np.repeat(live * t, [len(sets[k]) for k in live])
        # several rounds before the next look at which rows are full: least keys belong to the earliest round anyway
        for _ in range(1 if i < 8 else 8):
            if i >= 2 * t:
                break
            h = mix(items ^ seeds[i])
            place = (h >> _U(40)).astype(np.int64) * t >> 24 if i < t else np.full(len(h), i - t)
            np.minimum.at(flat, base + place, (_U(i) << _U(40)) | (h & _U((1 << 40) - 1)))
            i += 1
        live = live[(full[live] == empty).any(axis=1)]
    return full


def band_shape(threshold: float, bands: int, miss: float = 1e-8) -> int:
    """Most rows in a band for which a pair at the threshold is missed with probability ``miss`` or less."""
    rows = 1
    while (1 - threshold ** (rows + 1)) ** bands <= miss:
        rows += 1
    return rows


def band_keys(sets: list[np.ndarray], rows: int, bands: int) -> np.ndarray:
    s = sketch(sets, rows * bands).reshape(len(sets), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(sets), bands)).copy()
    for j in range(rows):
        key = mix(key * _U(0xD6E8FEB86659FD93) + s[:, :, j])
    return key.view(np.int64)


def features(docs: DataFrame, id_col: str, text_col: str, words: int, rows: int, bands: int, kind: str = "space") -> DataFrame:
    """id, n_shingles, fp_a, fp_b (fingerprint of the full set), bands (empty for an empty set)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = shingle_sets(part.column(1), words, kind)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                fp_a = np.array([mix(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
                fp_b = np.array([mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
                keys = band_keys(sets, rows, bands)
                at = np.concatenate(([0], np.cumsum(np.where(n > 0, bands, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(keys[n > 0].reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.array(fp_a), pa.array(fp_b), lists], ["id", "n_shingles", "fp_a", "fp_b", "bands"]
                )

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_shingles long, fp_a long, fp_b long, bands array<long>"
    return map_columns(docs, [id_col, text_col], kernel, schema)


def bitmap_bits(n: int) -> int:
    """Bits of a bitmap for n ids: 16 to 32 for each, a power of two, ``MOST_BITS`` at most.

    Beyond 2**24 ids the share of foreign ids that pass grows from a few hundredths; they cost a shuffle and change nothing.
    """
    return min(MOST_BITS, 1 << max(10, (16 * n - 1).bit_length()))


def id_filter(ids: DataFrame, id_col: str) -> np.ndarray:
    """Bitmap of hashed ids, sized by their number: an id whose bit is not set is not among them."""
    bits = bitmap_bits(ids.count())
    at = ids.select(F.pmod(F.xxhash64(id_col), F.lit(bits)).alias("at"))
    words_ = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    table = words_.toArrow()  # at most MOST_BITS / 64 rows
    out = np.zeros(bits >> 6, np.int64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return out.view(np.uint64)


def _maybe(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & _U(1) > 0


def _place(id_col: str, bitmap: np.ndarray) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(len(bitmap) << 6))


def maybe_among(df: DataFrame, id_col: str, bitmap: np.ndarray) -> Column:
    """Whether an id may be among those of a bitmap; false is certain, a null id is false."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def test(at: pd.Series) -> pd.Series:
        return pd.Series(_maybe(shared.value, at.to_numpy(np.int64)))

    return F.col(id_col).isNotNull() & test(_place(id_col, bitmap))


def full_sets(docs: DataFrame, id_col: str, text_col: str, words: int, kind: str, bitmap: np.ndarray) -> DataFrame:
    """(id, n, shingles) of each row whose id may be among those of a bitmap; texts are not shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_maybe(shared.value, batch.column(2).to_numpy(zero_copy_only=False))))
            for part in slices(batch, 1):
                sets = shingle_sets(part.column(1), words, kind)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                at = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), lists], ["id", "n", "shingles"])

    hashed = docs.where(F.col(id_col).isNotNull()).select(id_col, text_col, _place(id_col, bitmap).alias("_at"))
    return map_columns(hashed, [id_col, text_col, "_at"], kernel, f"id {docs.schema[id_col].dataType.simpleString()}, n long, shingles array<long>")


def forest(flat: np.ndarray, size: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links (i, j) of a left and a right set with other labels and den * |A & B| >= num * |A | B|, as a forest over the labels.

    ``flat`` holds the sets one after the other, ``size`` their lengths.  Linked labels are made one in ``label``.
    """
    at = np.concatenate(([0], np.cumsum(size)))
    owner = np.repeat(np.arange(len(size)), size)
    _, code, often = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    flat = np.sort(owner * len(often) + rank[code.reshape(-1)]) - owner * len(often)  # rarest first, set by set
    prefix = np.flatnonzero(np.arange(len(flat)) - at[owner] <= size[owner] + (-num * size[owner] // den))
    posted = prefix[np.argsort(flat[prefix], kind="stable")]
    lists, holder = np.searchsorted(flat[posted], np.arange(len(often) + 1)), owner[posted]
    out, mark, wanted = [], np.zeros(len(often), dtype=bool), np.zeros(len(size), dtype=bool)
    for i in np.flatnonzero(left).tolist():
        wanted = right & (label != label[i]) & (den * np.minimum(size, size[i]) >= num * np.maximum(size, size[i]))
        if not wanted.any():
            continue
        mine = flat[at[i] : at[i + 1]]
        probe = mine[: size[i] + (-num * size[i] // den) + 1]
        span = lists[probe + 1] - lists[probe]
        found = np.unique(holder[np.repeat(lists[probe + 1] - np.cumsum(span), span) + np.arange(span.sum())])
        found = found[wanted[found] & (~left[found] | (found > i))]  # two left ones are met once
        mark[mine] = True
        while len(found):
            some, found = found[:64], found[64:]
            stop = np.cumsum(size[some])
            shared = mark[flat[np.repeat(at[some + 1] - stop, size[some]) + np.arange(stop[-1])]]
            common = np.add.reduceat(shared, stop - size[some], dtype=np.int64)
            for j in some[den * common >= num * (size[some] + size[i] - common)].tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    out.append((i, j))
            found = found[label[found] != label[i]]
        mark[mine] = False
    return out


def _linked(num: int, den: int) -> Callable[[pa.Table], pa.Table]:
    """Grouped kernel: confirmed links of rows (id, label, side, shingles), of side 0 with side 1, or among all if there is no side 1."""

    def links(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, side = table.column("id").to_numpy(), table.column("side").to_numpy()
        lists = table.column("shingles").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        _, label = np.unique(table.column("label").to_numpy(), return_inverse=True)
        right = side == 1 if (side == 1).any() else side == 0
        found = forest(lists.flatten().to_numpy(), size, label, side == 0, right, num, den)
        give_back()
        return pa.table({"a": pa.array([ids[i] for i, _ in found], pa.int64()), "b": pa.array([ids[j] for _, j in found], pa.int64())})

    return links


def _blocks(members: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(members / BLOCK), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _block(n: str) -> Column:
    return F.expr(f"cast(pmod(xxhash64(id, 7), {n}) as int)")


def confirmed_links(feats: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int, kind: str = "space") -> DataFrame:
    """Confirmed links (a, b) between classes that connect all that the bands bring together; ids are class leaders."""
    leaders = feats.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0)).groupBy("fp_a", "fp_b", "n_shingles").agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
    slots = materialize(leaders.select("id", F.explode("bands").alias("key")), "bands")
    heads = slots.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("m")).where("m > 1").drop("m")
    heads = materialize(heads, "heads")
    in_doubt = slots.where(maybe_among(slots, "key", id_filter(heads, "key")))  # most buckets hold one class: they are not shuffled again
    stars = materialize(in_doubt.join(heads, "key").select("id", "head").distinct(), "stars")  # a head is a member of its own star set
    discard(slots, heads)
    over = stars.groupBy(F.col("id").alias("head")).agg(F.min("head").alias("lesser")).join(stars.select("head").distinct(), "head", "left_semi").where("lesser < head")
    members = materialize(stars.join(over, "head", "left").select("id", F.coalesce("lesser", "head").alias("head")).distinct(), "members")
    discard(stars)
    involved = members.select("id").distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # rows of one id that differ in text are one node; each of its sets may link it
    sets = materialize(full_sets(texts, "id", "text", words, kind, id_filter(involved, "id")).where("n > 0"), "sets")
    # each member in the star set of its least head, and the head in all blocks
    seats = members.groupBy("id").agg(F.min("head").alias("head")).where("id <> head")
    weights = sets.groupBy("id").agg(F.sum("n").alias("n"))
    sized = seats.join(weights, "id").groupBy("head").agg(_blocks(F.count("*"), F.sum("n")).alias("nb"))
    seated = seats.join(sized, "head").select("id", "head", _block("nb").alias("i"), (F.col("nb") == 1).alias("met"))
    seated = materialize(seated.union(sized.select(F.col("head").alias("id"), "head", F.explode(F.expr("sequence(0, nb - 1)")), F.col("nb") == 1)), "seats")
    ship(docs.sparkSession)
    limit_batches(docs.sparkSession)
    first = seated.join(sets, "id").select("head", "i", "id", F.col("id").alias("label"), F.lit(0).alias("side"), "shingles")
    links = materialize(first.groupBy("head", "i").applyInArrow(_linked(num, den), "a long, b long"), "links")
    comps = connected_components(links).select(F.col("node").alias("id"), F.col("component").alias("comp"))
    placed = members.join(comps, "id", "left").join(seated.where("met").select("id", "head", "met"), ["id", "head"], "left")
    placed = placed.select("id", "head", F.coalesce("comp", "id").alias("comp"), F.coalesce("met", F.lit(False)).alias("met"))
    shares = placed.groupBy("head", "comp").agg(F.count("*").alias("m"), F.count_if("met").alias("k"))
    open_ = shares.groupBy("head").agg(F.max_by("comp", F.struct("m", "comp")).alias("most"), F.max("m").alias("a"), F.sum("m").alias("n"), F.sum("k").alias("k"), F.count("*").alias("c"))
    open_ = open_.where("c > 1 and k < n").select("head", "most", (F.col("k") > F.col("a")).alias("by_met"))
    settled = F.when(F.col("by_met"), F.col("met")).otherwise(F.col("comp") == F.col("most"))
    left = materialize(placed.join(open_, "head").select("id", "head", F.col("comp").alias("label"), settled.alias("main")), "open")
    discard(seated, members)
    loads = left.join(weights, "id").groupBy("head").agg(
        _blocks(F.count_if("main"), F.sum(F.when(F.col("main"), F.col("n")))).alias("na"), _blocks(F.count_if(~F.col("main")), F.sum(F.when(~F.col("main"), F.col("n")))).alias("nr")
    )
    dealt = left.join(loads, "head").withColumn("i", F.when(F.col("main"), _block("na")).otherwise(_block("nr")))
    task = "named_struct('own', {own}, 'lo', {lo}, 'hi', {hi}, 'side', {side})"
    across = task.format(own=0, lo="if(main, i, j)", hi="if(main, j, i)", side="if(main, 0, 1)")
    within = task.format(own=1, lo="least(i, j)", hi="greatest(i, j)", side="if(i <= j, 0, 1)")
    tasks = dealt.select(
        "head", "id", "label",
        F.explode(F.expr(f"if(main, transform(sequence(0, nr - 1), j -> {across}), concat(transform(sequence(0, na - 1), j -> {across}), transform(sequence(0, nr - 1), j -> {within})))")).alias("t"),
    ).select("head", "id", "label", "t.*")
    wanted = sets.where(maybe_among(sets, "id", id_filter(left.select("id").distinct(), "id")))
    more = tasks.join(wanted, "id").select("head", "own", "lo", "hi", "id", "label", "side", "shingles").groupBy("head", "own", "lo", "hi").applyInArrow(_linked(num, den), "a long, b long")
    more = materialize(more, "more")
    discard(sets, left)
    return links.union(more)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    threshold: tuple[int, int] = (80, 100),
    bands: int = 40,
    kind: str = "space",
) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of every row.

    Two rows are linked if the Jaccard similarity of their sets of distinct word shingles is ``threshold`` (a fraction) or
    more; component_id is the least id reachable, kept marks that row.  A text of fewer words than a shingle has one
    shingle of all of them; a null, empty or wordless text has none and is linked with nothing.  Rows with one id are one
    node: they share its component, and repeated rows are all kept or all not.  A null id: component null, kept true.
    Ids must be integers.  Other columns are not read.
    """
    num, den = threshold
    rows = band_shape(num / den, bands)
    feats = materialize(features(docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col, words, rows, bands, kind), "feats")
    links = confirmed_links(feats, docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col, words, num, den, kind)
    per_class = feats.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0)).groupBy("fp_a", "fp_b", "n_shingles").agg(F.min("id").alias("leader"), F.count_distinct("id").alias("ids"))
    # an id with several sets ties its classes together
    shared = (
        feats.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
        .groupBy("id").agg(F.count_distinct("fp_a", "fp_b", "n_shingles").alias("k")).where("k > 1").select("id")
    )
    rows_ = feats.select("id", "n_shingles", "fp_a", "fp_b")
    with_leader = rows_.join(per_class.where("ids > 1").drop("ids"), ["fp_a", "fp_b", "n_shingles"], "left").withColumn("leader", F.coalesce("leader", "id"))
    with_leader = materialize(with_leader.select("id", "n_shingles", "leader"), "rows")
    ties = with_leader.join(shared, "id", "left_semi").select(F.col("id").alias("a"), F.col("leader").alias("b"))
    comps = connected_components(links.union(ties))
    out = with_leader.join(comps.withColumnRenamed("node", "leader"), "leader", "left")
    component = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "leader"))
    return out.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, with all their columns."""
    lost = materialize(near_duplicates(docs, id_col, text_col, **options).where("not kept").select(F.col(id_col).alias("lost_id")).distinct(), "lost")
    # rows that are certainly kept are not shuffled; each copy of an id that is lost goes
    doubt = maybe_among(docs, id_col, id_filter(lost, "lost_id"))
    maybe = docs.where(doubt)
    return docs.where(~doubt).union(maybe.join(lost, maybe[id_col].cast("long") == lost["lost_id"], "left_anti"))
