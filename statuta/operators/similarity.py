"""TF-IDF over character n-grams of words as DataFrames: fit, weights, and best matches by an inverted index.

Matching joins on n-grams and sums products, with partial sums before the shuffle.  Index entries beyond a document
frequency are not cut: idf gives them their small weight.  Candidates are first held against the exact index, so only keys
that it lacks reach the similarity join, and each distinct key once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def word_grams(key: Column, low: int = 3, high: int = 5) -> Column:
    """n-grams inside each word with a space on both sides; where a word has no n characters it counts once and larger n not at all."""
    words = F.transform(F.filter(F.split(F.lower(key), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(w: Column) -> Column:
        sizes = F.sequence(F.lit(low), F.greatest(F.lit(low), F.least(F.lit(high), F.length(w))))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - n + 1)), lambda i: F.substring(w, i, n))))

    return F.flatten(F.transform(words, of))


def term_counts(df: DataFrame, id_col: str, key_col: str, low: int = 3, high: int = 5) -> DataFrame:
    grams = df.select(F.col(id_col).alias("id"), F.explode(word_grams(F.col(key_col), low, high)).alias("gram"))
    return grams.groupBy("id", "gram").agg(F.count("*").alias("n"))


def inverse_frequency(counts: DataFrame, rows: DataFrame) -> DataFrame:
    """gram, idf = ln((1 + rows) / (1 + df)) + 1."""
    n = rows.agg(F.count("*").alias("rows"))
    return counts.groupBy("gram").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("gram", (F.log((1 + F.col("rows")) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """id, gram, w: (1 + ln n) * idf scaled to unit length over known grams."""
    raw = counts.join(idf, "gram").select("id", "gram", ((1 + F.log("n")) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.select("id", "gram", (F.col("w") / norm).alias("w"))


def best_matches(queries: DataFrame, index: DataFrame, threshold: float) -> DataFrame:
    """query, match, similarity of every index row within 1e-9 of a query's best, where that is the threshold or more."""
    q, x = queries.select(F.col("id").alias("query"), "gram", F.col("w").alias("wq")), index.select(F.col("id").alias("match"), "gram", F.col("w").alias("wx"))
    sims = q.join(x, "gram").groupBy("query", "match").agg(F.sum(F.col("wq") * F.col("wx")).alias("similarity"))
    top = F.max("similarity").over(Window.partitionBy("query"))
    return sims.withColumn("top", top).where((F.col("similarity") >= F.col("top") - 1e-9) & (F.col("top") >= threshold - 1e-9)).drop("top")


def similar_keys(df: DataFrame, id_col: str, key_col: str, threshold: float) -> DataFrame:
    """Best matches of each whole key among all keys of the table, itself included."""
    counts = term_counts(df, id_col, key_col)
    each = weights(counts, inverse_frequency(counts, df))
    return best_matches(each, each, threshold)
