"""Dictionary audit: names that several laws share, missing ids, coverage of a checklist, format faults."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.functions import text
from statuta.sources.packaging import ship


def shared_names(names: DataFrame, name_col: str = "name", law_col: str = "law_id") -> DataFrame:
    """name, n_laws, laws of names that several laws have, without regard to case, white space, quotes and look-alikes."""
    plain = F.trim(F.regexp_replace(F.lower(text.normalize(F.col(name_col))), r"(?U)\s+", " "))
    low = names.select(plain.alias("name"), F.col(law_col).alias("law"))
    out = low.groupBy("name").agg(F.count_distinct("law").alias("n_laws"), F.array_sort(F.collect_set("law")).alias("laws")).where("n_laws > 1")
    return out.select("name", "n_laws", F.array_join("laws", ",").alias("laws"))


def missing_ids(ids: DataFrame, id_col: str) -> DataFrame:
    """Ids between the least and the greatest that do not occur."""
    lo, hi = ids.agg(F.min(id_col), F.max(id_col)).first()
    whole = ids.sparkSession.range(lo or 0, lo or 0 if hi is None else hi + 1).select(F.col("id").alias(id_col))
    return whole.join(ids.select(id_col).distinct(), id_col, "left_anti")


def coverage(checklist: DataFrame, index: DataFrame, key: str = "key", law: str = "law_id") -> DataFrame:
    """Checklist keys with the laws that have them, joined by commas; none: null."""
    found = index.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.col(law).cast("string"))), ",").alias("laws"))
    return checklist.join(found, key, "left")


def faults(names: DataFrame, name_col: str = "name") -> DataFrame:
    """A row for each fault of a name."""
    return names.select("*", F.explode(text.name_problems(F.col(name_col))).alias("fault"))


def totals(laws: DataFrame, names_col: str = "names") -> DataFrame:
    """laws, names, without_names of a table of laws with their lists of names."""
    n = F.coalesce(F.size(names_col), F.lit(0))
    return laws.agg(F.count("*").alias("laws"), F.coalesce(F.sum(n), F.lit(0)).alias("names"), F.count_if(n == 0).alias("without_names"))


def stem_conflicts(names: DataFrame, name_col: str = "name", law_col: str = "law_id") -> DataFrame:
    """key, n_laws, n_names of different names that fall together once their words are stems, and belong to several laws."""
    ship(names.sparkSession)

    @F.pandas_udf("string")
    def key(column: pd.Series) -> pd.Series:
        from statuta.functions import laws

        return column.map(lambda n: None if n is None else laws.name_key(n))

    keyed = names.select(F.col(name_col).alias("name"), F.col(law_col).alias("law")).distinct().withColumn("key", key("name"))
    out = keyed.where("key <> ''").groupBy("key").agg(F.count_distinct("law").alias("n_laws"), F.count_distinct(F.lower("name")).alias("n_names"))
    return out.where("n_laws > 1 and n_names > 1")


def search(names: DataFrame, part: str, name_col: str = "name", law_col: str = "law_id", most: int = 8) -> DataFrame:
    """The feature is a short list: names that hold a string, without regard to case, by law and name."""
    return names.where(F.lower(F.col(name_col)).contains(part.lower())).select(law_col, name_col).orderBy(law_col, name_col).limit(most)
