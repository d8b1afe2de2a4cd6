"""Sources and sinks: dictionary, gold cases, JSON-lines logs, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINK = "struct<law_id:int,article:string,point_article:string,subpoint_article:string>"
CASES = f"struct<cases:array<struct<id:string,text:string,text_file:string,source:string,notes:array<string>,links:array<{LINK}>>>>"
VOTE = "vote_id string, item_id string, kind string, answer string, voter string, name string, ms long, time string"
ITEM = f"item_id string, kind string, doc_id string, source string, before string, fragment string, after string, claim string, links array<{LINK}>, expected string, pack string, version string"
TASK = "doc_id string, text string, source string, mode string"
ROW = "struct<fragment:string,law_id:int,law_name:string,article:string,point:string,subpoint:string>"
LABEL = f"doc_id string, rows array<{ROW}>, no_links boolean, comment string, difficult boolean, time string"


def dictionary(spark: SparkSession, laws: dict[int, list[str]]) -> DataFrame:
    """(law_id, name) of a dictionary held by the driver."""
    rows = [(law, name) for law, names in laws.items() for name in names]
    return spark.createDataFrame(rows, "law_id int, name string")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(law_id, name) of a JSON map from law id to names."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    laws = whole.select(F.explode("m").alias("law", "names"))
    return laws.select(F.col("law").cast("int").alias("law_id"), F.explode("names").alias("name"))


def collect_dictionary(names: DataFrame, most: int = 500_000) -> dict[int, list[str]]:
    """The dictionary for :class:`statuta.functions.laws.LawIndex`; a larger one than ``most`` names is refused."""
    rows = names.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the dictionary has more than {most} names")
    out: dict[int, list[str]] = {}
    for r in rows:
        out.setdefault(r["law_id"], []).append(r["name"])
    return out


def read_gold(spark: SparkSession, path: str, texts: str | None = None) -> DataFrame:
    """(id, text, links) of gold cases; texts kept in files of their own are joined by name from the folder ``texts``."""
    cases = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", CASES)["cases"]).alias("c")).select("c.*")
    if texts is None:
        return cases.select("id", "text", "links")
    files = spark.read.option("recursiveFileLookup", True).text(texts, wholetext=True).select(F.col("value").alias("file_text"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"))
    named = cases.withColumn("name", F.element_at(F.split(F.coalesce("text_file", F.lit("")), "/"), -1))
    return named.join(files, "name", "left").select("id", F.coalesce("text", "file_text").alias("text"), "links")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a folder of JSON-lines files and the folders in it, with their path and their order in it (line, a struct); broken lines are left out."""
    raw = spark.read.option("recursiveFileLookup", True).text(path)
    line = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    parsed = raw.select(F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"), F.col("_metadata.file_path").alias("path"), line.alias("line"))
    return parsed.where("r is not null and r._broken is null").select("r.*", "path", "line").drop("_broken")


def batch_of(path: Column) -> Column:
    """struct(batch, annotator) of a label file's path: .../<batch>/<annotator>.jsonl."""
    return F.struct(F.regexp_extract(path, r"([^/]+)/[^/]+\.jsonl$", 1).alias("batch"), F.regexp_extract(path, r"([^/]+)\.jsonl$", 1).alias("annotator"))


def last_by(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def repeated_ids(df: DataFrame, key: str) -> DataFrame:
    """Ids that occur more than once; merging packs must give none."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def merged_packs(*packs: DataFrame, key: str = "item_id") -> DataFrame:
    """All packs as one table; refused if they share an id."""
    out = packs[0]
    for p in packs[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    shared = repeated_ids(out, key).orderBy(key).first()
    if shared:
        raise ValueError(f"{key} {shared[key]} is in several packs")
    return out


def append_lines(df: DataFrame, path: str) -> None:
    """Votes, labels or metrics added to a log; each write adds files, so writers don't wait for one another."""
    df.write.mode("append").json(path)


def write_gold(cases: DataFrame, path: str) -> None:
    """Gold cases as JSON lines; a null in a link is written, so that all links have all fields."""
    cases.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def gold_cases(links: DataFrame, by: list[str]) -> DataFrame:
    """One row for each document with its links as an array in order: the shape of gold files."""
    entry = F.struct("chain_ord", "link_ord", F.struct("law_id", "article", "point_article", "subpoint_article").alias("l"))
    return links.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["l"]).alias("links"))


def survey_report(analysis: DataFrame, errors: DataFrame) -> str:
    """Report of a survey in Markdown: precision with its interval, link precision, relative recall, and what was wrong."""
    a = analysis.first()
    share = lambda x: "-" if x is None else f"{x:.3f}"
    lines = [
        f"Decided chains: {a['verify_decided']}, right: {a['verify_right']}", f"Precision: {share(a['precision'])} ({share(a['ci_low'])} to {share(a['ci_high'])})",
        f"Link precision: {share(a['link_precision'])}", f"Missed: {a['missed_yes']} of {a['missed_decided']} ({a['missed_outside']} outside the dictionary)", f"Relative recall: {share(a['relative_recall'])}",
    ]
    return "\n\n".join(["# Survey", *lines, "## Errors", markdown_table(errors.orderBy(F.desc("n"), "decision"))])


def markdown_table(df: DataFrame, most: int = 100) -> str:
    """A small result as a Markdown table; the report's feature is a limit of ``most`` rows."""
    rows = [[str(v) if v is not None else "-" for v in r] for r in df.limit(most).collect()]
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])


