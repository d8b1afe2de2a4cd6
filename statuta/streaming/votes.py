"""Votes as a stream (an extension): running counts of each item from an append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.sources.tables import VOTE


def read_votes(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New JSON-lines files of a folder, as they come."""
    return spark.readStream.schema(VOTE).option("maxFilesPerTrigger", files_per_batch).json(path).withColumn("at", F.to_timestamp("time"))


def counts(votes: DataFrame, late: str = "1 hour") -> DataFrame:
    """Votes of each item and answer; a vote id counts once within the watermark, so a resent file adds nothing."""
    once = votes.withWatermark("at", late).dropDuplicatesWithinWatermark(["vote_id"])
    return once.groupBy("item_id", "answer").agg(F.count("*").alias("n"))


def windowed(votes: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Votes of each item in tumbling windows, for append mode."""
    once = votes.withWatermark("at", late).dropDuplicatesWithinWatermark(["vote_id"])
    return once.groupBy(F.window("at", width), "item_id").agg(F.count("*").alias("n")).select("window.start", "window.end", "item_id", "n")
