"""Window-shaped steps over chains: back-references, enumerations, bounds, overlaps, prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_of_kind(events: DataFrame, by: list[str], order: list[str], kind: str, value: str, out: str) -> DataFrame:
    """Backward as-of: the last known value before a row among rows of the same kind."""
    w = Window.partitionBy(*by, kind).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn(out, F.last(value, ignorenulls=True).over(w))


def fill_from_next(chains: DataFrame, by: list[str], order: list[str], value: str, joined: str, out: str) -> DataFrame:
    """Forward as-of within runs: a row without a value takes that of the next row with one, as long as each is joined to the next."""
    w = Window.partitionBy(*by).orderBy(*order)
    starts = chains.withColumn("_new", F.when(F.lag(joined).over(w), 0).otherwise(1))
    runs = starts.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ahead = Window.partitionBy(*by, "_run").orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    return runs.withColumn(out, F.first(value, ignorenulls=True).over(ahead)).drop("_new", "_run")


def running_bound(rows: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Largest value of earlier rows, 0 before the first."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.coalesce(F.max(value).over(w), F.lit(0)))


def outside(candidates: DataFrame, covered: DataFrame, by: list[str]) -> DataFrame:
    """Candidates that overlap no covered span of their group (half-open spans); an anti-join on the group with a range test."""
    spans = covered.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("start").alias("_s"), F.col("end").alias("_e"))
    same = [F.col(c) == F.col(f"_{c}") for c in by]
    hit = (F.col("end") > F.col("_s")) & (F.col("start") < F.col("_e"))
    condition = hit
    for s in same:
        condition = s & condition
    return candidates.join(spans, condition, "left_anti")


def prefixes(tokens: DataFrame, array_col: str, most: int = 20) -> DataFrame:
    """(…, k, prefix): the first 1..most tokens of an array, joined."""
    wide = tokens.select("*", F.explode(F.sequence(F.lit(1), F.least(F.size(array_col), F.lit(most)))).alias("k")).where(F.size(array_col) > 0)
    return wide.withColumn("prefix", F.array_join(F.slice(F.col(array_col), F.lit(1), F.col("k")), " "))


def shortest_exact(found: DataFrame, index: DataFrame, by: list[str], key: str = "prefix") -> DataFrame:
    """Of prefixes that equal an index key the shortest of each group, a row for each index row that has the key."""
    w = Window.partitionBy(*by).orderBy("k")
    return found.join(index, found[key] == index["alias_key"]).withColumn("_n", F.rank().over(w)).where("_n = 1").drop("_n")


def tag_counts(tagged: DataFrame, by: str, order: str) -> DataFrame:
    """(before2, before1, tag, n): counts of role trigrams, ^ before a text's start."""
    w = Window.partitionBy(by).orderBy(order)
    before = lambda n: F.coalesce(F.lag("tag", n).over(w), F.lit("^"))
    return tagged.select(before(2).alias("before2"), before(1).alias("before1"), "tag").groupBy("before2", "before1", "tag").agg(F.count("*").alias("n"))


def smoothed(trigrams: DataFrame, tags: int, k: float = 0.01, weights: tuple[float, float, float] = (0.8, 0.15, 0.05)) -> DataFrame:
    """log of the interpolated probability of each seen trigram."""
    share = lambda part, whole: (part + k) / (whole + k * tags)
    w2, w1 = Window.partitionBy("before2", "before1"), Window.partitionBy("before1")
    n = F.col("n")
    bi = F.sum(n).over(Window.partitionBy("before1", "tag"))
    uni, all_ = F.sum(n).over(Window.partitionBy("tag")), F.sum(n).over(Window.partitionBy(F.lit(1)))
    p = weights[0] * share(n, F.sum(n).over(w2)) + weights[1] * share(bi, F.sum(n).over(w1)) + weights[2] * share(uni, all_)
    return trigrams.select("before2", "before1", "tag", "n", F.log(p).alias("log_p"))
