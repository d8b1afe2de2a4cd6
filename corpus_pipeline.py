"""A training corpus in five stages, each one operator of ``statuta.llm`` over all that the stage before it kept.

language ID: documents whose language is rejected (no letter, or no text) go.  MinHash near-dedup: of each group linked by
5-word shingles at a similarity of 0.8, the document of least id stays.  Benchmark decontamination: documents that hold 0.8
of a benchmark item's 5-word shingles go.  Secret scans: secrets are masked in the text, n_chars follows.  BPE: ids and
the text decoded from them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm import bpe, decontaminate, langid, near_dup, secret_scan
from statuta.llm._io import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, under a model of the rows that are not held out.

    Null, empty and letterless texts go; very long texts are read whole; repeated rows all stay or all go; an empty table stays
    empty.  All columns are kept, whatever their names and nulls.
    """
    return langid.keep_identified(docs, langid.fit(docs.where(~langid.held_out("doc_id"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least id; rows with a null id stay, as do null and wordless texts.

    Very long texts are compared whole; repeated rows of an id all stay or all go; an empty table stays empty.  All columns are
    kept, whatever their names and nulls.
    """
    return near_dup.keep_one(docs, words=5, threshold=(80, 100))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null, empty and wordless texts hold none, very long ones are searched whole.

    Repeated rows all stay or all go; an empty table stays empty, and without items all rows stay.  All columns are kept, whatever
    their names and nulls.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked and n_chars, where there is one, of the new text; no row goes.

    Null and empty texts stay as they are (n_chars null and 0); very long texts are searched whole; repeated rows get equal texts;
    an empty table stays empty.  Other columns are kept, whatever their names and nulls.
    """
    clean = secret_scan.mask(docs, secret_scan.learn(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, decoded) of each document: the last stage.

    Null and empty texts have no ids and an empty text; very long texts are encoded whole; repeated rows give equal rows; an
    empty table gives none.  Other columns are not read, so their names can't clash.
    """
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_passages),
    ("secret scans", mask_secrets),
    ("BPE encoding and decoding", encode),
]

#: The stages' models and hashes have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
