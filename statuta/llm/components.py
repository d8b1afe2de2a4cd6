"""Distributed connected components by alternating large-star and small-star steps.

Every step is a group-by and a join of the edge list with itself; hot nodes are pre-aggregated by the partial
minimum and, in the joins, split by AQE.  Edges never come to the driver: it sees only one digest per round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import discard, materialize


def _digest(edges: DataFrame) -> tuple[int, int]:
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    return int(row["n"]), int(row["s"] or 0)


def _star(pairs: DataFrame, keep: Column) -> DataFrame:
    """Each kept neighbour of a node is linked to the least id around that node."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return pairs.where(keep).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``edges`` (two columns of one orderable type); component: the least reachable id.

    Self-links, repeated and reversed links are fine; links with a null end are ignored.  No links: no rows.
    """
    a, b = edges.columns
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    alone = ends.where(F.col("u") == F.col("v")).select("u", "v").distinct()
    links = materialize(
        ends.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc"
    )
    before = _digest(links)
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, F.col("v") > F.col("u")).where(F.col("u") != F.col("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        previous, links = links, materialize(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct(),
            "cc",
        )
        discard(previous)
        now = _digest(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = found.select(F.col("component").alias("node"), F.col("component")).distinct()
    rest = alone.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(roots).union(rest.join(found.union(roots), "node", "left_anti"))
