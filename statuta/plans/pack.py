"""Survey packs: what voters are asked about a set of texts, from the extraction to the items.

A verify item shows a chain with the law that was found, a missed item a chain that may cite something and has no law, a
control item a verify item whose answer is known, every second one corrupted.  All steps are expressions and joins over the
extraction's rows; a text's spans stay with its row, so nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions import laws, lexicon, tagging, text
from statuta.operators import context, corpus, display
from statuta.plans import extract as plan

#: Markers inside a span: its words in order, each with the label of its level.
_MARKERS = r"(?iu)(?<![а-яё])(?:" + "|".join([*(f"{s}[а-яё]*" for s in lexicon.MARKER_STEMS), *sorted(lexicon.SHORT_MARKERS, key=len, reverse=True)]) + r")(?![а-яё])"


def marker_labels(span: Column) -> Column:
    """Labels of the marker words in a span, in order."""
    return F.transform(F.regexp_extract_all(span, F.lit(_MARKERS), F.lit(0)), display.marker_label)


def found_spans(docs: DataFrame, index: laws.LawIndex, tagger: tagging.Tagger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chain_ord, start, end, chain, law_id) of each chain, the law's name in the span where there is one."""
    found = plan.chains(docs, tagger, id_col, text_col, index)
    return found.select("doc_id", "chain_ord", F.least("chain.start", "law_start").alias("start"), F.greatest("chain.end", "law_end").alias("end"), "chain", "law_id")


def verify_items(spans: DataFrame, titles: DataFrame) -> DataFrame:
    """Chains with a law: (doc_id, chain_ord, start, end, law_id, article, claim)."""
    named = spans.where("law_id is not null").join(F.broadcast(titles), "law_id", "left")  # titles: a row for each law of the dictionary, which is bounded
    claim = display.reading(F.col("chain.articles"), F.col("chain.points"), F.col("chain.subpoints"), F.coalesce("short", F.col("law_id").cast("string")))
    return named.select("doc_id", "chain_ord", "start", "end", "law_id", F.try_element_at("chain.articles", F.lit(1)).alias("article"), claim.alias("claim"))


def missed_items(spans: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chains without a law that overlap none with one, hold a digit, and name a document: (doc_id, chain_ord, start, end)."""
    bare = spans.where("law_id is null").select("doc_id", "chain_ord", "start", "end")
    free = context.outside(bare, spans.where("law_id is not null").select("doc_id", "start", "end"), ["doc_id"])
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    held = F.substring("_text", F.col("start") + 1, F.col("end") - F.col("start"))
    kept = free.join(texts, "doc_id").where(held.rlike(r"\d") & (display.names_document(F.col("_text"), F.col("end")) | held.rlike(display.DOCUMENT_NEAR)))
    return kept.select("doc_id", "chain_ord", "start", "end")


def items(docs: DataFrame, index: laws.LawIndex, tagger: tagging.Tagger | None = None, id_col: str = "doc_id", text_col: str = "text", chars: int = 150) -> DataFrame:
    """(item_id, kind, doc_id, before, fragment, after, claim, expected, markers) of all three kinds over whole texts.

    Ids are distinct, texts without a chain give no item; a null or empty text has none.  Controls are made of the verify
    items, numbered over all of them; their ids end in "c".
    """
    names = [(law, i, n) for law, ns in index.laws.items() for i, n in enumerate(ns)]
    titles = display.law_titles(docs.sparkSession.createDataFrame(names, "law_id int, ord int, name string"))
    spans = found_spans(docs, index, tagger, id_col, text_col)
    verify = verify_items(spans, titles.select("law_id", "short")).withColumn("kind", F.lit("verify")).withColumn("expected", F.lit(None).cast("string"))
    missed = missed_items(spans, docs, id_col, text_col).withColumn("kind", F.lit("missed"))
    control = corpus.control_items(verify.withColumn("_o", F.struct("doc_id", "chain_ord")), "_o").drop("_o")
    control = control.drop("claim").join(F.broadcast(titles.select("law_id", "short")), "law_id", "left").withColumn("kind", F.lit("control"))
    control = control.withColumn("claim", F.concat(F.coalesce(F.concat(F.lit("ст. "), "article"), F.lit("статья не указана")), F.lit(" — "), F.coalesce("short", F.col("law_id").cast("string")))).drop("short")
    every = verify.unionByName(control).unionByName(missed, allowMissingColumns=True)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    shown = text.context_window(F.col("_text"), F.col("start"), F.col("end"), chars)
    out = every.join(texts, "doc_id").withColumn("_w", shown)
    item_id = F.concat_ws("-", F.col("doc_id").cast("string"), "chain_ord", F.when(F.col("kind") == "control", "c"))
    return out.select(item_id.alias("item_id"), "kind", "doc_id", "_w.before", "_w.fragment", "_w.after", "claim", "expected", marker_labels(F.col("_w.fragment")).alias("markers"))


def control_pool(packs: DataFrame) -> DataFrame:
    """Control items of all packs (item_id, kind, pack, ...), of one id the one of the last pack."""
    last = Window.partitionBy("item_id").orderBy(F.desc("pack"))
    return packs.where("kind = 'control'").withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
