"""Annotation records: last save wins, rows to links, agreement of annotators, export with adjudication, suggestions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions import text
from statuta.operators import evaluation

ADJUDICATOR = "adjudicator"
VALUES = ["article", "point", "subpoint"]


def last_saves(records: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """The last record of each annotator and document, by seq and then by ``ties``; one aggregation, nothing is ranked."""
    rest = [c for c in records.columns if c not in ("annotator", "doc_id")]
    last = records.groupBy("annotator", "doc_id").agg(F.max_by(F.struct(*rest), F.struct("seq", *ties)).alias("_r"))
    return last.select("annotator", "doc_id", "_r.*").select(*records.columns)


def expand_rows(rows: DataFrame, keep: list[str]) -> DataFrame:
    """A link for each combination of a row's comma lists; rows without a law give none, an empty list stands for null."""
    out = rows.where(F.col("law_id").isNotNull())
    for name in VALUES:
        out = out.withColumn(name, F.explode(text.split_values(F.col(name))))
    return out.select(*keep, "law_id", "article", F.col("point").alias("point_article"), F.col("subpoint").alias("subpoint_article"))


def _per_annotator(links: DataFrame, saved: DataFrame) -> DataFrame:
    """(annotator, doc_id, n, h) of each saved record: number of its links and the sum of their hashes; both sides meet in one
    aggregation, so nothing is joined."""
    hashed = F.xxhash64(*evaluation.KEY).cast("decimal(38,0)")
    zero = F.lit(0).cast("decimal(38,0)")
    found = links.where("annotator is not null").select("annotator", "doc_id", F.lit(1).alias("n"), hashed.alias("h"), F.lit(False).alias("saved"))
    both = saved.select("annotator", "doc_id", F.lit(0).alias("n"), zero.alias("h"), F.lit(True).alias("saved")).unionByName(found)
    return both.groupBy("annotator", "doc_id").agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.max("saved").alias("saved")).where("saved").drop("saved")


def _pairs(grouped: DataFrame) -> DataFrame:
    """(first, second, a, b) of each pair of annotators in each row's list ``who`` of (annotator, n)."""
    first = grouped.select("who", F.explode("who").alias("x"))
    return first.select("x", F.explode(F.filter("who", lambda y: y["annotator"] > F.col("x.annotator"))).alias("y")).select(
        F.col("x.annotator").alias("first"), F.col("y.annotator").alias("second"), F.col("x.n").alias("a"), F.col("y.n").alias("b")
    )


def agreement(links: DataFrame, saved: DataFrame) -> DataFrame:
    """first, second, f1, shared of each pair of annotators over the documents that both saved.

    Pairs are made within one document and, for what they share, within one of its links, so their number follows the
    annotators of one document, not the square of all rows.
    """
    people = F.col("annotator") != ADJUDICATOR
    who = F.collect_list(F.struct("annotator", "n")).alias("who")
    both = _pairs(_per_annotator(links, saved).where(people).groupBy("doc_id").agg(who))
    shared = both.groupBy("first", "second").agg(F.count("*").alias("shared"), F.sum(F.col("a") + F.col("b")).alias("links"))
    # links of a record stand together for a moment, to leave those out that no saved record has
    found = links.where(people).select("annotator", "doc_id", F.struct(*evaluation.KEY).alias("k"))
    every = found.unionByName(saved.where(people).select("annotator", "doc_id"), allowMissingColumns=True)
    whole = every.groupBy("annotator", "doc_id").agg(F.collect_list("k").alias("ks"), F.max(F.col("k").isNull()).alias("saved"))
    known = whole.where("saved").select("annotator", "doc_id", F.explode("ks").alias("k")).select("annotator", "doc_id", "k.*")
    counts = known.groupBy("annotator", "doc_id", *evaluation.KEY).agg(F.count("*").alias("n"))
    alike = _pairs(counts.groupBy("doc_id", *evaluation.KEY).agg(who)).groupBy("first", "second").agg(F.sum(F.least("a", "b")).alias("tp"))
    f1 = F.when(F.col("links") > 0, 2 * F.coalesce("tp", F.lit(0)) / F.col("links")).otherwise(1.0)
    return shared.join(alike, ["first", "second"], "left").select("first", "second", f1.alias("f1"), "shared")


def _settled(links: DataFrame, saved: DataFrame) -> DataFrame:
    """doc_id, outcome, n_annotators, and the annotator who speaks for the document."""
    same = lambda c: F.min(c) == F.max(c)
    per = _per_annotator(links, saved).groupBy("doc_id").agg(
        F.max(F.col("annotator") == ADJUDICATOR).alias("judged"), (same("n") & same("h")).alias("same"), F.count("*").alias("n_annotators"), F.min("annotator").alias("least")
    )
    outcome = F.when(F.col("judged"), "adjudicated").when(F.col("same"), "unanimous").otherwise("conflict")
    return per.select("doc_id", outcome.alias("outcome"), "n_annotators", F.when(F.col("judged"), ADJUDICATOR).otherwise(F.col("least")).alias("annotator"))


def outcomes(links: DataFrame, saved: DataFrame) -> DataFrame:
    """doc_id, outcome (adjudicated, unanimous or conflict), n_annotators: multisets are compared by order-free hashes."""
    return _settled(links, saved).select("doc_id", "outcome", "n_annotators")


def gold(links: DataFrame, saved: DataFrame) -> DataFrame:
    """Links of each document that is settled: the adjudicator's, or those on which all annotators agree; with the outcome.

    A settled document without links gives no row; documents in conflict are those whose outcome says so.
    """
    judged = _settled(links, saved).where("outcome <> 'conflict'")
    return links.join(judged.select("doc_id", "annotator", "outcome"), ["doc_id", "annotator"])


def save_problem(rows: Column, no_links: Column) -> Column:
    """Why a record can't be saved: rows and the mark that there are none exclude each other, and one of them is needed; null if it can."""
    some, none = F.coalesce(F.size(rows), F.lit(0)) > 0, F.coalesce(no_links, F.lit(False))
    return F.when(some & none, "rows and no links").when(~some & ~none, "neither rows nor no links")


def merged_rows(links: DataFrame, by: list[str]) -> DataFrame:
    """Links of one span and law as one row of comma lists where they are a full product of their values, else a row each.

    Values keep the order of link_ord; a span's links are few, so arrays stay small.
    """
    cols = ["article", "point_article", "subpoint_article"]
    seq = F.sort_array(F.collect_list(F.struct("link_ord", *cols)))
    grouped = links.groupBy(*by, "law_id").agg(seq.alias("ls"))
    values = {c: F.array_distinct(F.filter(F.col(f"ls.{c}"), lambda v: v.isNotNull())) for c in cols}
    size = F.lit(1)
    for c in cols:
        size = size * F.greatest(F.lit(1), F.size(values[c]))
    one = F.struct(*[F.array_join(values[c], ", ").alias(c) for c in cols])
    each = F.transform("ls", lambda x: F.struct(*[F.coalesce(x[c], F.lit("")).alias(c) for c in cols]))
    return grouped.select(*by, "law_id", F.explode(F.when(size == F.size("ls"), F.array(one)).otherwise(each)).alias("r")).select(*by, "law_id", "r.*")


def next_document(tasks: DataFrame, saved: DataFrame) -> DataFrame:
    """First task in order that has no record."""
    return tasks.join(saved.select("doc_id").distinct(), "doc_id", "left_anti").agg(F.min_by("doc_id", "ord").alias("doc_id"))
