"""What annotators and voters are shown: titles, readings of a chain, highlighted spans, answer choices, checks of a vote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = " · "
# Words that name a document near a number, the suffix of a country, and the joints of an enumeration at its end.
DOCUMENT_NEAR = (
    r"(?iu:кодекс|закон|фз|конституц|положени|правил|приказ|постановлени|договор|контракт|регламент|устав|инструкци|соглашени|коап)|(?<![А-Яа-яЁё])[А-ЯЁ]{2,5}(?![А-Яа-яЁё])"
)
COUNTRY_TAIL = r"(?U)^(\s+(?:РФ|России|Российской\s+Федерации))(?![А-Яа-яЁё])"
ENUMERATION_TAIL = r"(?iuU)((?:[\s,;]|\s(?:и|а также|также|так и|так и по|и по)(?=\s))+)$"
#: An address in a tag, in either quotes or bare.
HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
#: Answers of the second question by item kind, as (code, label).
CHOICES = {
    "verify": (("no_law", "другой закон"), ("no_article", "другая статья"), ("no_part", "другая часть или пункт"), ("no_ref", "это не ссылка")),
    "missed": (("no_ref", "это не ссылка"), ("other_doc", "ссылка на другой документ")),
}


def law_titles(names: DataFrame, law_col: str = "law_id", name_col: str = "name", order_col: str = "ord") -> DataFrame:
    """law, title, short: the first full name with number and quotes, else the first name; the shortest abbreviation with РФ, else the title."""
    n = F.col(name_col)
    full = n.contains("№") & n.contains("«") & ~n.contains(" от ")
    brief = F.trim(n).rlike("^[А-ЯЁа-яё]{2,6} РФ$")
    out = names.groupBy(law_col).agg(
        F.min_by(n, F.struct((~full).alias("a"), F.col(order_col).alias("o"))).alias("title"),
        F.min_by(F.when(brief, F.trim(n)), F.when(brief, F.struct(F.length(F.trim(n)).alias("l"), F.col(order_col).alias("o")))).alias("abbreviation"),
    )
    return out.select(law_col, F.trim("title").alias("title"), F.coalesce("abbreviation", F.trim("title")).alias("short"))


def choice(law: Column, title: Column) -> Column:
    return F.concat(law.cast("string"), F.lit(SEPARATOR), title)


def chosen_law(value: Column) -> Column:
    """Law id of a choice; null if it does not start with a number."""
    head = F.trim(F.split(value, SEPARATOR)[0])
    return F.when(head.rlike("^[0-9]+$"), head.cast("int"))


def reading(articles: Column, points: Column, subpoints: Column, law: Column, point_mark: Column | None = None, sub_mark: Column | None = None) -> Column:
    """A chain as a citation: "п. 6 ч. 1 ст. 24.5 — КоАП РФ"; a level without a marker gets a neutral one."""
    listed = lambda a: F.array_join(F.array_distinct(F.filter(a, lambda v: v.isNotNull())), ", ")
    lead = lambda mark, neutral: F.coalesce(mark if mark is not None else F.lit(None).cast("string"), F.lit(neutral))
    part = lambda mark, neutral, a: F.when(listed(a) != "", F.concat(lead(mark, neutral), F.lit(" "), listed(a)))
    art = F.when(listed(articles) != "", F.concat(F.lit("ст. "), listed(articles))).otherwise("статья не указана")
    return F.concat(F.concat_ws(" ", part(sub_mark, "пп.", subpoints), part(point_mark, "п./ч.", points), art), F.lit(" — "), law)


def marker_label(marker: Column) -> Column:
    low = F.lower(marker)
    return F.when(low.startswith("подп") | (low == "пп"), "пп.").when(low.startswith("п"), "п.").when(low.startswith("ч"), "ч.").otherwise("ст.")


def names_document(text: Column, end: Column, window: int = 80) -> Column:
    """Whether a document is named after a span, before the sentence or bracket ends."""
    tail = F.regexp_replace(F.substring(text, F.lit(1) + end, F.lit(window)), r"^\.", " ")
    clause = F.split(tail, r"(?U)\)|[.;]\s|[.;]$")[0]
    return clause.rlike(DOCUMENT_NEAR)


def display_end(text: Column, start: Column, end: Column, starts: Column) -> Column:
    """End of the highlighted fragment: before the next chain that starts inside the span and the joint to it, else past a country suffix."""
    cut = F.array_min(F.filter(starts, lambda s: (s > start) & (s < end)))
    part = F.substring(text, F.lit(1) + start, cut - start)
    before = start + F.length(F.regexp_replace(part, ENUMERATION_TAIL, ""))
    tail = F.length(F.regexp_extract(F.substring(text, F.lit(1) + end, F.lit(60)), COUNTRY_TAIL, 1))
    return F.when(cut.isNotNull(), before).otherwise(end + tail).cast("int")


def answer_choices(kind: Column) -> Column:
    """Codes of the second question's answers; none for other kinds."""
    out = F.array().cast("array<string>")
    for name, answers in CHOICES.items():
        out = F.when(kind == name, F.array(*[F.lit(code) for code, _ in answers])).otherwise(out)
    return out


def voter_name(raw: Column) -> Column:
    """A nickname with its white space squeezed; null if that leaves less than two or more than forty characters."""
    name = F.trim(F.regexp_replace(raw, r"(?U)\s+", " "))
    return F.when(F.length(name).between(2, 40), name)


def parameters(spec: Column) -> Column:
    """struct(name, options) of "name?k=v&k=v"."""
    has = F.instr(spec, "?") > 0
    empty = F.create_map().cast("map<string,string>")
    options = F.when(has, F.str_to_map(F.substring_index(spec, "?", -1), F.lit("&"), F.lit("="))).otherwise(empty)
    return F.struct(F.substring_index(spec, "?", 1).alias("name"), options.alias("options"))


def page_links(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(href, page): each linked address with the least page that names it first seen."""
    found = pages.select(F.col(id_col).alias("page"), F.explode(F.filter(F.transform(F.regexp_extract_all(html_col, F.lit(HREF), F.lit(0)), lambda m: F.regexp_extract(m, HREF, 1)), lambda h: h != "")).alias("href"))
    return found.groupBy("href").agg(F.min("page").alias("page"))


def new_index_rows(found: DataFrame, done: DataFrame, id_col: str, text_col: str, least: int = 1000) -> DataFrame:
    """Rows to append to a corpus index: not done yet and of ``least`` characters or more."""
    return found.where(F.length(text_col) >= least).join(done.select(id_col).distinct(), id_col, "left_anti").withColumn("chars", F.length(text_col))
