"""Text functions of legal citations as Column expressions: normalisation, tokens, values, windows.

Every function maps one character to one character or carries offsets, so spans found in a normalised text are spans of
the original.  All run inside whole-stage code generation or as higher-order functions; none needs Python on executors.
"""

from __future__ import annotations

import html.entities

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Characters that normalisation replaces, and Latin letters that look like Cyrillic ones.
FOLD_FROM = "«»“”„ёЁ  \t\r\n–—‑"
FOLD_TO = '"""""еЕ     ---'
LATIN_LOOKALIKES = "ABCEHKMOPTXaceopxy"
CYRILLIC_LOOKALIKES = "АВСЕНКМОРТХасеорху"

#: One chain token: a number with dots or a range of them, a run of letters, or any other visible character.
CHAIN_TOKEN = r"\d+(?:\.\d+)*(?:\s*-\s*\d+(?:\.\d+)*)?|[А-Яа-яЁёA-Za-z]+|\S"
NAME_TOKEN = r"[0-9a-zа-я]+(?:[-.][0-9a-zа-я]+)*"
_LETTERS = "[A-Za-zА-Яа-яЁё]+"
ORDINAL_STEMS = ("перв", "втор", "трет", "четверт", "пят", "шест", "седьм", "восьм", "девят", "десят")


def fold_characters(text: Column) -> Column:
    """Quotes, dashes, spaces and ё made uniform; null stays null."""
    return F.translate(text, FOLD_FROM, FOLD_TO)


def fold_lookalikes(word: Column) -> Column:
    """Latin look-alikes made Cyrillic in a word that has letters of both scripts."""
    mixed = word.rlike("[А-Яа-яЁё]") & word.rlike("[A-Za-z]")
    return F.when(mixed, F.translate(word, LATIN_LOOKALIKES, CYRILLIC_LOOKALIKES)).otherwise(word)


def normalize(text: Column) -> Column:
    """Length-preserving normalisation of a text; only texts with both scripts are cut into words."""
    folded = fold_characters(text)
    words = F.transform(F.regexp_extract_all(folded, F.lit(f"({_LETTERS}|[^A-Za-zА-Яа-яЁё]+)"), F.lit(1)), fold_lookalikes)
    return F.when(folded.rlike("[A-Za-z]") & folded.rlike("[А-Яа-яЁё]"), F.array_join(words, "")).otherwise(folded)


def chain_pieces(text: Column) -> Column:
    """All of a text as tokens and white space between them, in order: nothing is lost."""
    return F.regexp_extract_all(text, F.lit(rf"(?U)({CHAIN_TOKEN}|\s+)"), F.lit(1))


def chain_tokens(text: Column) -> Column:
    """Array of struct(text, start, end): chain tokens with code point offsets.  For texts of many thousand tokens take :func:`token_rows`."""
    pieces = chain_pieces(text)
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<text:string,start:int,end:int>>)").alias("out"))

    def step(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece)
        token = F.array(F.struct(piece.alias("text"), state["at"].alias("start"), end.alias("end")))
        blank = piece.rlike(r"(?U)^\s+$")
        return F.struct(end.alias("at"), F.when(blank, state["out"]).otherwise(F.concat(state["out"], token)).alias("out"))

    return F.aggregate(pieces, start, step, lambda s: s["out"])


def token_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, token, start, end): a row for each chain token, offsets as a running sum over the pieces of a text.

    The work grows with the number of tokens; ids must be distinct.  Null and empty texts give no rows.
    """
    rows = docs.select(F.col(id_col), F.posexplode(chain_pieces(F.col(text_col))).alias("pos", "token"))
    end = F.sum(F.length("token")).over(Window.partitionBy(id_col).orderBy("pos")).cast("int")
    return rows.withColumn("end", end).where(~F.col("token").rlike(r"(?U)^\s+$")).select(id_col, "token", (F.col("end") - F.length("token")).alias("start"), "end")


def drop_repeated_dots(tokens: Column) -> Column:
    """Of dots in a row only the first token stays; tokens are those of :func:`chain_tokens`."""
    return F.filter(tokens, lambda t, i: ~((t["text"] == ".") & (i > 0) & (F.get(tokens, i - 1)["text"] == ".")))


def name_tokens(text: Column) -> Column:
    """Words of a law's name, look-alikes folded."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?iu)({NAME_TOKEN})"), F.lit(1)), fold_lookalikes)


def is_short_abbreviation(word: Column) -> Column:
    """Upper case, with a letter, of five characters at most."""
    return (F.length(word) <= 5) & (word == F.upper(word)) & (word != F.lower(word))


def value_text(token: Column) -> Column:
    """Value of a number, range, letter or ordinal word: lower case, without spaces, ordinals as digits."""
    low = F.lower(token)
    out = F.regexp_replace(low, r"(?U)\s+", "")
    for digit, stem in reversed(list(enumerate(ORDINAL_STEMS, 1))):
        out = F.when(low.startswith(stem) & (F.length(low) > len(stem)), F.lit(str(digit))).otherwise(out)
    return out


def split_values(value: Column) -> Column:
    """"1, 2" as ["1", "2"]; nothing as [null]."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda p: F.lower(F.regexp_replace(p, r"(?U)\s+", "")))
    full = F.filter(parts, lambda p: p != "")
    return F.when(F.size(full) > 0, full).otherwise(F.array(F.lit(None).cast("string")))


def clean_lines(text: Column) -> Column:
    """Soft hyphens and carriage returns out, white space in a line made one space, empty lines out."""
    lines = F.split(F.translate(text, "\r­", ""), "\n")
    tidy = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "[ \t ]+", " ")))
    return F.array_join(F.filter(tidy, lambda x: x != ""), "\n")


def unescape(text: Column) -> Column:
    """Named and numeric character references resolved in one pass; what is no reference stays as it is."""
    named = F.create_map(*[F.lit(x) for name, code in sorted(html.entities.name2codepoint.items()) for x in (f"&{name};", chr(code))])
    sign = lambda hex_: F.decode(F.unhex(F.lpad(hex_, 8, "0")), "UTF-32")

    def resolved(piece: Column) -> Column:
        hexadecimal, decimal = F.regexp_extract(piece, "^&#[xX](0*(?:10|[0-9A-Fa-f])?[0-9A-Fa-f]{1,4});$", 1), F.regexp_extract(piece, "^&#([0-9]{1,7});$", 1)
        number = F.when(hexadecimal != "", hexadecimal).when(decimal != "", F.conv(decimal, 10, 16))
        fits = number.isNotNull() & (F.conv(number, 16, 10).cast("int") <= 0x10FFFF) & ~F.conv(number, 16, 10).cast("int").between(0xD800, 0xDFFF)
        return F.when(piece.startswith("&"), F.coalesce(F.try_element_at(named, piece), F.when(fits, sign(number)), piece)).otherwise(piece)

    pieces = F.regexp_extract_all(text, F.lit("(&#?[0-9A-Za-z]{1,31};|[^&]+|&)"), F.lit(1))
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, resolved), "")).otherwise(text)


def html_text(page: Column, start_mark: str | None = None, end_mark: str | None = None) -> Column:
    """Plain text of a page, or of what stands between two marks of it: scripts, styles, comments and tags out, breaks kept, references resolved."""
    body = page if start_mark is None else F.when(F.instr(page, start_mark) > 0, F.substring_index(page, start_mark, -1)).otherwise("")
    body = body if end_mark is None else F.substring_index(body, end_mark, 1)
    for pattern, by in ((r"(?is)<(script|style)\b.*?</\1\s*>", ""), (r"(?s)<!--.*?-->", ""), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</(p|div|h[1-6]|li|tr)\s*>", "\n"), (r"(?s)<[^>]+>", "")):
        body = F.regexp_replace(body, pattern, by)
    body = F.translate(unescape(body), "\u00a0", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(body, r"[ \t]+", " "), r"\n\s*\n+", "\n"))


def strip_footer(text: Column, marks: tuple[str, ...] = ("Суд:", "Судебная практика по:")) -> Column:
    """Text before the first line that starts with one of the marks."""
    any_mark = "|".join(f"\\Q{m}\\E" for m in marks)
    return F.regexp_replace(text, rf"(?s)(^|\n)({any_mark}).*$", "")


def shorten(text: Column, most: int = 90) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def context_window(text: Column, start: Column, end: Column, chars: int = 150) -> Column:
    """struct(before, fragment, after) around a span (0-based, end exclusive), whole words, with ellipses where cut."""
    left = F.greatest(F.lit(0), start - chars)
    head, tail = F.substring(text, F.lit(1), left), F.substring(text, F.lit(1) + left, start - left)
    # a word that the window would cut is shown whole
    whole = F.when((left > 0) & ~tail.rlike(r"(?U)^\s"), F.concat(F.regexp_extract(head, r"(?U)(\S*)$", 1), tail)).otherwise(tail)
    before = F.when(F.length(whole) < start, F.concat(F.lit("… "), F.ltrim(whole))).otherwise(F.substring(text, F.lit(1), start))
    size = F.length(text)
    right = F.least(size, end + chars)
    near, far = F.substring(text, F.lit(1) + end, right - end), F.substring(text, F.lit(1) + right, size - right)
    full = F.when((right < size) & ~near.rlike(r"(?U)\s$"), F.concat(near, F.regexp_extract(far, r"(?U)^(\S*)", 1))).otherwise(near)
    after = F.when(F.length(full) + end < size, F.concat(F.rtrim(full), F.lit(" …"))).otherwise(F.substring(text, F.lit(1) + end, size - end))
    return F.struct(before.alias("before"), F.substring(text, F.lit(1) + start, end - start).alias("fragment"), after.alias("after"))


def _fragment_pattern(fragment: Column) -> Column:
    """Words of a fragment as they are, any white space between them; null without words."""
    words = F.filter(F.split(fragment, r"(?U)\s+"), lambda w: w != "")
    quoted = lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.when(F.size(words) > 0, F.concat(F.lit("(?U)"), F.array_join(F.transform(words, quoted), "\\s+")))


def find_fragments(text: Column, fragment: Column) -> Column:
    """Array of struct(start, end): all places of a fragment that do not overlap, in order; empty if there is none."""
    pattern = F.coalesce(_fragment_pattern(fragment), F.lit("(?!)"))
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    seed = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("out"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

    pairs = F.transform(found, lambda hit, i: F.struct(hit.alias("hit"), F.get(between, i).alias("gap")))
    return F.aggregate(pairs, seed, step, lambda s: s["out"])


def find_fragment(text: Column, fragment: Column) -> Column:
    """struct(start, end) of the first place of a fragment, any white space for its white space; null if there is none."""
    safe = _fragment_pattern(fragment)
    found = F.regexp_substr(text, safe)
    at = F.instr(text, found) - 1
    return F.when(found.isNotNull(), F.struct(at.alias("start"), (at + F.length(found)).alias("end")))


def row_problems(text: Column, row: Column) -> Column:
    """What keeps an annotation row from being added: array of codes, empty if it is fine."""
    fragment = F.trim(F.coalesce(row["fragment"], F.lit("")))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.filter(
        F.array(
            F.when(fragment == "", F.lit("no fragment")),
            F.when((fragment != "") & find_fragment(text, fragment).isNull(), F.lit("fragment not in text")),
            F.when(row["law_id"].isNull() & blank(row["law_name"]), F.lit("no law")),
            F.when(blank(row["article"]) & blank(row["point"]) & blank(row["subpoint"]), F.lit("no number")),
        ),
        lambda p: p.isNotNull(),
    )


def valid_annotator(name: Column) -> Column:
    return F.coalesce(name.rlike(r"(?U)^[\w .-]{2,40}$") & ~name.contains("/"), F.lit(False))


def name_problems(name: Column) -> Column:
    """Format checks of a law's name: spaces, quotes, an edition note, mixed scripts."""
    count = lambda c: F.length(name) - F.length(F.replace(name, F.lit(c), F.lit("")))
    mixed = F.exists(F.regexp_extract_all(name, F.lit(f"({_LETTERS})"), F.lit(1)), lambda w: w.rlike("[А-Яа-яЁё]") & w.rlike("[A-Za-z]"))
    return F.filter(
        F.array(
            F.when((F.trim(name) != name) | name.contains("  "), F.lit("spaces")),
            F.when((count("«") != count("»")) | (count('"') % 2 != 0), F.lit("quotes")),
            F.when(name.contains("(в ред."), F.lit("edition")),
            F.when(mixed, F.lit("scripts")),
        ),
        lambda p: p.isNotNull(),
    )


def generic_quoted(name: Column) -> Column:
    """Whether a name's quoted part has two words at most: too common as plain words."""
    inner = F.regexp_extract(name, "«([^»]*)»", 1)
    return (inner != "") & (F.size(F.regexp_extract_all(inner, F.lit(r"(?U)(\w+)"), F.lit(1))) <= 2)
