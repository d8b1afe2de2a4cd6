"""Yes/no survey statistics: voter screening, majority decisions, precision with intervals, agreement, queues.

Votes: vote_id, voter, item_id, answer, ms, seq (their order).  Items: item_id, kind (verify, missed, control), expected,
n_links, after, votes they had, version.  Items are joined as they come; Spark broadcasts them only below its own limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Answers that mean no, and the screen's limits.
NO_ANSWERS = ("no", "no_law", "no_article", "no_part", "no_numbers", "no_ref", "other_doc")
MIN_CONTROLS, MIN_ACCURACY, Z = 3, 0.75, 1.96
CONTROL_EVERY = 8


def first_votes(raw: DataFrame) -> DataFrame:
    """Of log lines with one vote_id the first by path and line stays."""
    w = Window.partitionBy("vote_id").orderBy("path", "line")
    return raw.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def is_right(answer: Column, expected: Column) -> Column:
    return F.when(expected == "yes", answer == "yes").otherwise(answer.isin(*NO_ANSWERS))


def screen(votes: DataFrame, items: DataFrame) -> DataFrame:
    """voter, answers, controls, right, accuracy, kept, median_ms (the upper median)."""
    joined = votes.join(items.select("item_id", "kind", "expected"), "item_id", "left")
    control = (F.col("kind") == "control") & (F.col("answer") != "unsure")
    stats = joined.groupBy("voter").agg(
        F.count("*").alias("answers"),
        F.count_if(control).alias("controls"),
        F.count_if(control & is_right(F.col("answer"), F.col("expected"))).alias("right"),
        F.expr("percentile_disc(0.5) within group (order by coalesce(ms, 0) desc)").cast("long").alias("median_ms"),
    )
    accuracy = F.when(F.col("controls") > 0, F.col("right") / F.col("controls"))
    return stats.withColumn("accuracy", accuracy).withColumn("kept", (F.col("controls") >= MIN_CONTROLS) & F.coalesce(F.col("accuracy") >= MIN_ACCURACY, F.lit(False)))


def decisions(votes: DataFrame) -> DataFrame:
    """item_id, decision: "yes", the most common no (first seen on a tie), or null where neither has the majority."""
    known = votes.where("answer <> 'unsure'")
    by_answer = known.groupBy("item_id", "answer").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    no = F.col("answer").isin(*NO_ANSWERS)
    tally = by_answer.groupBy("item_id").agg(
        F.coalesce(F.sum(F.when(F.col("answer") == "yes", F.col("n"))), F.lit(0)).alias("yes"),
        F.coalesce(F.sum(F.when(no, F.col("n"))), F.lit(0)).alias("no"),
        F.max_by(F.when(no, F.col("answer")), F.when(no, F.struct(F.col("n"), -F.col("first")))).alias("reason"),
    )
    seen = votes.select("item_id").distinct().join(tally, "item_id", "left")
    decision = F.when(F.col("yes") > F.col("no"), "yes").when(F.col("no") > F.col("yes"), F.col("reason"))
    return seen.select("item_id", decision.alias("decision"))


def kept_votes(votes: DataFrame, items: DataFrame) -> DataFrame:
    """Votes of screened voters on items that are no controls."""
    kept = screen(votes, items).where("kept").select("voter")
    asked = items.where(F.col("kind").isin("verify", "missed")).select("item_id")
    return votes.join(kept, "voter", "left_semi").join(asked, "item_id", "left_semi")


def wilson(k: Column, n: Column, z: float = Z) -> Column:
    """struct(low, high) of a share's score interval; (0, 1) without cases."""
    p, zz = k / n, z * z
    centre, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.when(n > 0, F.struct(low.alias("low"), high.alias("high"))).otherwise(F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high")))


def analyze(votes: DataFrame, items: DataFrame) -> DataFrame:
    """One row: decided items, precision with its interval, link-weighted precision, missed items and relative recall."""
    decided = decisions(kept_votes(votes, items)).where("decision is not null").join(items, "item_id")
    verify, missed, yes = F.col("kind") == "verify", F.col("kind") == "missed", F.col("decision") == "yes"
    outside = F.substring("after", 1, 60).rlike("(?iu)конституци")
    out = decided.agg(
        F.count_if(verify).alias("verify_decided"), F.count_if(verify & yes).alias("verify_right"),
        F.coalesce(F.sum(F.when(verify & yes, F.col("n_links"))), F.lit(0)).alias("links_right"), F.coalesce(F.sum(F.when(verify, F.col("n_links"))), F.lit(0)).alias("links_all"),
        F.count_if(missed).alias("missed_decided"), F.count_if(missed & yes & ~outside).alias("missed_yes"), F.count_if(missed & yes & outside).alias("missed_outside"),
    )
    share = lambda a, b: F.when(b > 0, a / b)
    ci = wilson(F.col("verify_right"), F.col("verify_decided"))
    return out.select(
        "*", share(F.col("verify_right"), F.col("verify_decided")).alias("precision"), ci["low"].alias("ci_low"), ci["high"].alias("ci_high"),
        share(F.col("links_right"), F.col("links_all")).alias("link_precision"), share(F.col("verify_right"), F.col("verify_right") + F.col("missed_yes")).alias("relative_recall"),
    )


def error_histogram(votes: DataFrame, items: DataFrame) -> DataFrame:
    """Decisions other than yes on verified items, counted."""
    decided = decisions(kept_votes(votes, items)).join(items.where("kind = 'verify'").select("item_id"), "item_id")
    return decided.where("decision <> 'yes'").groupBy("decision").agg(F.count("*").alias("n"))


def agreement(votes: DataFrame) -> DataFrame:
    """pairs, agreeing, agreement over all vote pairs on an item, in closed form: no self-join."""
    per = votes.where("answer <> 'unsure'").groupBy("item_id").agg(F.count_if(F.col("answer") == "yes").alias("y"), F.count_if(F.col("answer") != "yes").alias("n"))
    two = lambda c: c * (c - 1) / 2
    y, n = F.col("y"), F.col("n")
    total = per.agg(F.coalesce(F.sum(two(y + n)), F.lit(0)).cast("long").alias("pairs"), F.coalesce(F.sum(two(y) + two(n)), F.lit(0)).cast("long").alias("agreeing"))
    return total.withColumn("agreement", F.when(F.col("pairs") > 0, F.col("agreeing") / F.col("pairs")))


def leaderboard(votes: DataFrame, top: int = 10) -> DataFrame:
    """The feature is a top list: most answers first, then the name; rank, voter, answers."""
    counts = votes.groupBy("voter").agg(F.count("*").alias("answers"))
    best = counts.orderBy(F.desc("answers"), F.lower(F.col("voter").cast("string"))).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("answers"), F.lower(F.col("voter").cast("string")))))


def place_of(votes: DataFrame, voter: object) -> DataFrame:
    """rank, voter, answers of one voter among all, in the leaderboard's order: a count of those before, not a sort of all."""
    name = F.lower(F.col("voter").cast("string"))
    counts = votes.groupBy("voter").agg(F.count("*").alias("answers"))
    own = counts.where(F.col("voter") == voter).select(F.col("answers").alias("own"), name.alias("own_name"), F.col("voter").alias("who"))
    before = (F.col("answers") > F.col("own")) | ((F.col("answers") == F.col("own")) & (name < F.col("own_name")))
    placed = counts.join(F.broadcast(own))  # one row, or none for a voter without answers
    return placed.groupBy("who", "own").agg((F.count_if(before) + 1).cast("int").alias("rank")).select("rank", F.col("who").alias("voter"), F.col("own").alias("answers"))


def answered(votes: DataFrame) -> DataFrame:
    """(voter, item_id): what each voter has answered, a row each: a set of a voter's items is never one value."""
    return votes.select("voter", "item_id").distinct()


def next_item(items: DataFrame, votes: DataFrame, voter: object, every: int = CONTROL_EVERY, enough: int = 2) -> DataFrame:
    """The item that a voter is asked next: of those not answered yet the first in the queue's order, at every ``every``-th answer a control.

    Where no control is left, or nothing but controls, what is left comes.
    """
    own = votes.where(F.col("voter") == voter)
    asked = items.join(own.select("item_id").distinct(), "item_id", "left_anti")
    counts = votes.groupBy("item_id").agg(F.count("*").alias("n"))
    turn = own.agg((F.count("*") % every == every - 1).alias("turn"))
    open_ = asked.join(counts, "item_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).join(F.broadcast(turn))
    order = [((F.col("kind") == "control") != F.col("turn")), F.col("n") >= enough, F.desc("version"), "n", F.md5(F.col("item_id").cast("string")), "item_id"]
    return open_.orderBy(*order).limit(1).select("item_id", "kind", "version", "n")


def queue(items: DataFrame, votes: DataFrame, enough: int = 2) -> DataFrame:
    """Order in which items are asked within a kind: items short of votes first, newest version, fewest votes, seeded tie-break."""
    counts = votes.groupBy("item_id").agg(F.count("*").alias("n"))
    counted = items.join(counts, "item_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("kind").orderBy(F.col("n") >= enough, F.desc("version"), "n", F.md5(F.col("item_id").cast("string")), "item_id")
    return counted.select("item_id", "kind", "version", "n", F.row_number().over(w).alias("place"))


def votes_per_item(votes: DataFrame) -> DataFrame:
    """Votes and voters of each item; the set of voters is bounded by the votes on one item."""
    return votes.groupBy("item_id").agg(F.count("*").alias("n_votes"), F.count_distinct("voter").alias("n_voters"))
