import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, wordless and long texts, repeated rows, rows of one id with other texts, clashing names."""
    long = "lorem ipsum dolor sit amet " * 30_000
    words = " ".join(f"word{i}" for i in range(300))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43), (2, None, "en", None, None), (3, "", None, "a", 0), (4, "   \n\t ", "en", "a", 5),
        (5, words, "en", "b", 1), (6, words + " tail", "en", "b", 1), (6, words + " tail", "en", "b", 1), (None, words, None, None, None), (7, "12 34 --", "de", "a", 8),
        (8, long, "fr", "a", 1), (9, "x" * 700_000, "fr", "a", 1), (10, "Über größe straße köln", "de", "c", 2), (10, "other text of the same id", "en", "c", 2), (11, "\x00 a b 😀 <|endoftext|> <s>", "en", "c", 2),
    ]
    from pyspark.sql import functions as F

    base = spark.createDataFrame(rows, DOCS)
    return base.select("*", F.lit("clash").alias("id"), F.lit(1).alias("score"), F.lit("k").alias("kept"), F.lit("z").alias("lang_pred"), F.lit(0).alias("bands"))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
