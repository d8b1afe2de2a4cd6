"""URL filters with redirect equivalence.

Rules fit a host with its subdomains and a path prefix; the longest wins.  Pages whose redirect (meta refresh) or
canonical link names another url are its aliases: distributed connected components over these links carry the rules'
decisions to aliases that no rule fits.  In a component one explicit allow takes precedence over any block.

Only url columns are shuffled: html is searched where it is read, and only pages with a link give edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import materialize
from .components import connected_components

Rule = tuple[str, str, str]
#: verdict, host, path
RULES: list[Rule] = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# the first tag of each kind, and the url in it
CANONICAL_TAG, CANONICAL_URL = r"""(?is)<link\s[^>]*rel\s*=\s*["']?canonical["'\s/>][^>]*>?""", r"""(?is)\shref\s*=\s*["']?([^"'\s>]+)"""
REFRESH_TAG, REFRESH_URL = r"""(?is)<meta\s[^>]*http-equiv\s*=\s*["']?refresh["'\s/>][^>]*>?""", r"""(?is)url\s*=\s*["']?([^"'\s>;]+)"""


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; without "://": empty."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def with_parts(df: DataFrame, url_col: str) -> DataFrame:
    """``df`` with host and path of ``url_col`` (null or without "://": both empty)."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    return df.withColumns({"host": host_of(url), "path": path_of(url)})


def longest_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """struct(verdict, rule) of the longest rule that fits, or null; of equal length, block first, then by name."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def alias_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, target) of each redirect and canonical link in the pages, the target made absolute.

    The first tag of each kind in a whole page counts.  Null urls, urls without "://" and null or empty pages have no links;
    repeated rows give equal rows, an empty table none.  Other columns are not read.
    """
    html, out = F.coalesce(F.col(html_col), F.lit("")), []
    for tag, inner in ((CANONICAL_TAG, CANONICAL_URL), (REFRESH_TAG, REFRESH_URL)):
        out.append(F.regexp_extract(F.regexp_extract(html, tag, 0), inner, 1))
    base = pages.where(F.col(url_col).isNotNull() & (F.instr(F.lower(html), "canonical") + F.instr(F.lower(html), "refresh") > 0))
    links = base.select(F.col(url_col).alias("url"), F.explode(F.array(*out)).alias("to")).where("to <> '' and instr(url, '://') > 0")
    scheme, origin = F.regexp_extract("url", r"(?s)^(.*?)://", 1), F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    target = (
        F.when(F.instr("to", "://") > 0, F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(scheme, F.lit(":"), F.col("to")))
        .when(F.col("to").startswith("/"), F.concat(origin, F.col("to")))
        .otherwise(F.concat(folder, F.when(folder.endswith("/"), "").otherwise("/"), F.col("to")))
    )
    return links.select("url", target.alias("target"))


def judge(pages: DataFrame, rules: list[Rule] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, host, path, rule, verdict) of each page.

    A page that a rule fits has that rule's verdict.  Any other page has the verdict of its component: allow if a rule
    allows any url of it (pages and link targets alike), else block if a rule blocks any, else allow.  Null urls and urls
    without "://" have an empty host and path, no rule and no alias: allow.  Repeated rows get equal rows.
    """
    links = alias_links(pages, url_col, html_col)
    keyed = links.select(_node("url").alias("a"), _node("target").alias("b"))
    edges = materialize(keyed.where("a is not null and b is not null and a <> b").distinct(), "links")
    comps = materialize(connected_components(edges), "aliases")
    parts = comps.withColumn("_url", F.concat(F.lit("x://"), "node"))
    ruled = with_parts(parts, "_url").select("component", longest_rule(rules, F.col("host"), F.col("path"))["verdict"].alias("v"))
    decided = ruled.where("v is not null").groupBy("component").agg(F.min("v").alias("said"))  # "allow" sorts before "block"
    by_node = comps.join(decided, "component").select(F.col("node").alias("_node"), "said")
    judged = with_parts(pages.select(F.col(id_col), F.col(url_col).alias("_page_url")), "_page_url").withColumn("_r", longest_rule(rules, F.col("host"), F.col("path")))
    judged = judged.withColumn("_node", F.when(F.col("_r").isNull(), _node("_page_url")))
    out = judged.join(by_node, "_node", "left")
    return out.select(id_col, "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", "said", F.lit("allow")).alias("verdict"))


def _node(column: str) -> Column:
    """Node of a url: its host in lower case and the rest, without scheme and fragment; null without "://"."""
    url = F.col(column)
    rest = F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), rest))
