"""Registered queries of the citation engine, each with its SQL where SQL can express it.

Driver tables stand in for the engine's own: order keys make citation texts, events are votes, labels are decisions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuta.functions import citegen, laws, lexicon, noise, synthetic, text
from statuta.operators import annotation, audit, context, corpus, display, evaluation, similarity, survey
from statuta.plans import extract as plan
from statuta.plans import pack
from statuta.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(df: DataFrame, key: str, share: int) -> DataFrame:
    """Rows dealt by a key into parts of about ``share`` bytes as stored, and into no fewer than four a core: a task's work and
    memory follow neither the layout of the files nor their size."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-size // share)), key)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents")


# extraction


def _orders_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of all orders.  A key of a few bytes makes a text that costs a thousand times as much as its scan, so keys are dealt
    over all cores first; splits of the scan follow bytes."""
    keys = _dealt(_read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 1 << 17)
    return citegen.citations(keys, "o_orderkey")


_EXPECTED = citegen.EXPECTED_SQL.format(key="o_orderkey", table="orders")


@query(_EXPECTED)
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to links."""
    return plan.extract(_orders_text(spark, sf_dir)).select("doc_id", "law_id", "article", "point_article", "subpoint_article")


@query(f"SELECT law_id, count(*) AS n_links, count(DISTINCT doc_id) AS n_docs FROM ({_EXPECTED}) GROUP BY law_id")
def links_per_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.extract(_orders_text(spark, sf_dir)).groupBy("law_id").agg(F.count("*").alias("n_links"), F.count_distinct("doc_id").alias("n_docs"))


@query(f"SELECT doc_id, law_id, article, point_article, subpoint_article, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CAST(article AS INT), point_article) - 1 AS INT) AS place FROM ({_EXPECTED})")
def links_in_text_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: links of every text keep its order; the generator's articles of a text ascend."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("chain_ord", "link_ord")) - 1
    links = plan.extract(_orders_text(spark, sf_dir))
    return links.select("doc_id", "law_id", "article", "point_article", "subpoint_article", place.cast("int").alias("place"))


@query(citegen.EXPECTED_SQL.format(key="doc_id", table="documents"))
def extract_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, each with a citation after its text; texts without Cyrillic letters never reach Python."""
    docs = _docs(spark, sf_dir).select("doc_id", F.concat_ws("\n", "text", citegen.citation_text(F.col("doc_id"))).alias("text"))
    return plan.extract(docs).select("doc_id", "law_id", "article", "point_article", "subpoint_article")


@query(_EXPECTED)
def extract_with_many_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same links with a dictionary of 18,724 more names."""
    names = lexicon.SEED_LAWS | citegen.generated_laws(18_724)
    return plan.extract(_orders_text(spark, sf_dir), names).select("doc_id", "law_id", "article", "point_article", "subpoint_article")


@query(
    f"""WITH e AS ({_EXPECTED}), v AS (SELECT o_orderkey AS doc_id, (o_orderkey // 8) % 8 AS v, o_orderkey % 8 IN (5, 7) AS act FROM orders),
k AS (SELECT doc_id, CASE v WHEN 3 THEN 2 WHEN 6 THEN 1 + act::INT WHEN 7 THEN 0 ELSE 1 END AS verify, CASE v WHEN 6 THEN 1 - act::INT WHEN 7 THEN 1 ELSE 0 END AS missed FROM v)
SELECT doc_id, 'verify' AS kind, CAST(verify AS BIGINT) AS n FROM k WHERE verify > 0 UNION ALL SELECT doc_id, 'control', CAST(verify AS BIGINT) FROM k WHERE verify > 0
UNION ALL SELECT doc_id, 'missed', CAST(missed AS BIGINT) FROM k WHERE missed > 0"""
)
def survey_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7, J5, P21-P24, section 2.13: items of all kinds from texts; tests hold their contents against brute force."""
    index = laws.LawIndex(lexicon.extend(lexicon.SEED_LAWS))
    return pack.items(_orders_text(spark, sf_dir), index).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query(f"SELECT 'clean' AS family, count(*) AS tp, CAST(0 AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn, 1.0 AS f1 FROM ({_EXPECTED})")
def evaluate_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset precision and recall of the extraction against the generator's links."""
    spark_expected = _expected(spark, sf_dir)
    found = plan.extract(_orders_text(spark, sf_dir))
    out = evaluation.scores(evaluation.compared(spark_expected, found, ["doc_id"]))
    return out.select(F.lit("clean").alias("family"), "tp", "fp", "fn", "f1")


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _dealt(_read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 1 << 17)
    k = F.col("o_orderkey")
    laws = F.array(*[F.lit(x) for x, _ in citegen.NAMES])
    n = lambda a, b, c=1: (F.pmod(k * a, F.lit(b)) + c).cast("string")
    link = lambda art, pt=None, sub=None: F.struct(art.alias("article"), (F.lit(None).cast("string") if pt is None else pt).alias("point_article"), (F.lit(None).cast("string") if sub is None else sub).alias("subpoint_article"))
    art, oth, pt, sub = n(7, 300), n(7, 300, 11), n(3, 9), n(5, 12)
    v, i = F.pmod(F.floor(k / 8), F.lit(8)), F.pmod(k, F.lit(8)).cast("int")
    rows = (
        F.when(v == 0, F.array(link(art, pt))).when(v == 1, F.array(link(art), link(oth))).when(v == 2, F.array(link(art, pt, sub)))
        .when(v == 3, F.array(link(art, pt), link(oth, F.lit("1")))).when(v == 4, F.array(link(art))).when(v == 5, F.array(link(art, F.lit("2"))))
        .when((v == 6) & i.isin(5, 7), F.array(link(art), link(oth, pt))).when(v == 6, F.array(link(art)))
    )
    return orders.select(k.alias("doc_id"), F.element_at(laws, i + 1).alias("law_id"), F.explode(rows).alias("l")).select("doc_id", "law_id", "l.*")


@query()
def noise_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each noise family over the generator's texts; tagger and index are built once."""
    gold, texts = _expected(spark, sf_dir), _orders_text(spark, sf_dir)
    families = ("clean", "spaces", "dots", "breaks", "glue", "homoglyphs", "case")
    noisy = None
    for f in families:
        one = corpus.perturbed(texts, "text", f).select(F.struct(F.lit(f).alias("family"), "doc_id").alias("doc_id"), "text")
        noisy = one if noisy is None else noisy.unionByName(one)
    found = plan.extract(noisy)
    expected = gold.crossJoin(F.broadcast(spark.createDataFrame([(f,) for f in families], "family string"))).withColumn("doc_id", F.struct("family", "doc_id"))
    counted = evaluation.compared(expected, found, ["doc_id"]).withColumn("family", F.col("doc_id.family"))
    return evaluation.scores(counted, ["family"])


@query()
def noise_robustness_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each noise family, typos and all among them, over five seeds of draws at rate 0.5."""
    families, seeds = ["clean", *noise.FAMILIES, "all"], 5
    gold, texts = _expected(spark, sf_dir), _orders_text(spark, sf_dir)
    key = F.struct("family", "seed", "doc_id")
    found = plan.extract(corpus.drawn_noise(texts, families, seeds).select(key.alias("doc_id"), "text"))
    runs = spark.createDataFrame([(f, s) for f in families for s in range(1 if f == "clean" else seeds)], "family string, seed int")
    expected = gold.crossJoin(F.broadcast(runs)).withColumn("doc_id", key)
    counted = evaluation.compared(expected, found, ["doc_id"]).withColumn("family", F.col("doc_id.family"))
    return evaluation.scores(counted, ["family"])


@query()
def chains_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains with their spans and values, before any law."""
    out = plan.chains(_orders_text(spark, sf_dir))
    return out.select("doc_id", "chain_ord", "chain.start", "chain.end", F.to_json("chain.articles").alias("articles"), F.to_json("chain.points").alias("points"), F.to_json("chain.subpoints").alias("subpoints"))


@query()
def extract_long_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of about 2,500 characters, 30 citations each: back-references now reach over neighbours, so there is no SQL."""
    one = _orders_text(spark, sf_dir).select(F.floor(F.col("doc_id") / 30).alias("g"), "doc_id", "text")
    whole = one.groupBy("g").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return plan.extract(whole, id_col="g").groupBy("doc_id", "law_id").agg(F.count("*").alias("n_links"))


# text functions

_CONV = "SELECT conv_id, turn, {expr} FROM conversations"


@query("SELECT doc_id, translate(text, '«»“”„ёЁ' || chr(160) || chr(8239) || chr(9) || chr(13) || chr(10) || '–—‑', '\"\"\"\"\"еЕ     ---') AS folded FROM documents")
def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One character for one character."""
    return _docs(spark, sf_dir).select("doc_id", text.fold_characters(F.col("text")).alias("folded"))


@query("SELECT p_partkey, concat('с', 'т. ', CAST(p_partkey % 50 AS VARCHAR), ' Latin ', p_name) AS folded FROM part")
def fold_lookalikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only words of both scripts change."""
    raw = F.concat(F.lit("cт. "), (F.col("p_partkey") % 50).cast("string"), F.lit(" Latin "), F.col("p_name"))
    return _read(spark, sf_dir, "part").select("p_partkey", text.normalize(raw).alias("folded"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\d+(?:\.\d+)*(?:\s*-\s*\d+(?:\.\d+)*)?|[А-Яа-яЁёA-Za-z]+|[^\s]')) AS BIGINT) AS n_tokens FROM documents")
def chain_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of whole documents."""
    tokens = F.regexp_extract_all("text", F.lit(f"({text.CHAIN_TOKEN})"), F.lit(1))
    return _docs(spark, sf_dir).select("doc_id", F.size(tokens).cast("long").alias("n_tokens"))


@query(
    r"""WITH t AS (SELECT item_id, regexp_extract_all(text, '\d+(?:\.\d+)*(?:\s*-\s*\d+(?:\.\d+)*)?|[А-Яа-яЁёA-Za-z]+|[^\s]') AS ts FROM (SELECT item_id, text || ' .. end...' AS text FROM benchmark)),
f AS (SELECT item_id, list_filter(ts, lambda x, i: NOT (x = '.' AND i > 1 AND ts[greatest(i - 1, 1)] = '.')) AS ts FROM t)
SELECT item_id, CAST(i - 1 AS INT) AS pos, ts[i] AS token FROM f, unnest(range(1, len(ts) + 1)) AS u(i)"""
)
def chain_tokens_with_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with offsets; each token is the text at its span."""
    b = _read(spark, sf_dir, "benchmark").select("item_id", F.concat("text", F.lit(" .. end...")).alias("text"))
    t = b.select("item_id", "text", F.posexplode(text.drop_repeated_dots(text.chain_tokens(F.col("text")))).alias("pos", "t"))
    return t.select("item_id", "pos", F.expr("substring(text, t.start + 1, t.end - t.start)").alias("token"))


@query("SELECT p_partkey, ['первой', '43.2 - 6', 'Б', 'третьего', '19.5'][p_partkey % 5 + 1] AS token, ['1', '43.2-6', 'б', '3', '19.5'][p_partkey % 5 + 1] AS value FROM part")
def value_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9."""
    token = F.element_at(F.array(*[F.lit(x) for x in ("первой", "43.2 - 6", "Б", "третьего", "19.5")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return _read(spark, sf_dir, "part").select("p_partkey", token.alias("token"), text.value_text(token).alias("value"))


@query("SELECT conv_id, turn, w AS word, length(w) <= 5 AND w = upper(w) AND w <> lower(w) AS short, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '(?i)[0-9a-zа-я]+(?:[-.][0-9a-zа-я]+)*')) AS w FROM conversations) GROUP BY ALL")
def name_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a name, and whether they are short abbreviations."""
    words = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(text.name_tokens(F.col("text"))).alias("word"))
    return words.groupBy("conv_id", "turn", "word").agg(F.count("*").alias("n")).withColumn("short", text.is_short_abbreviation(F.col("word")))


@query(r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(replace(text, chr(13), ''), chr(173), ''), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\x{00a0}]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS clean FROM documents")
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P16."""
    return _docs(spark, sf_dir).select("doc_id", text.clean_lines(F.col("text")).alias("clean"))


@query(
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'),
  '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(?:p|div|h[1-6]|li|tr)\s*>', chr(10), 'g'), '(?s)<[^>]+>', '', 'g'),
  '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t]+', ' ', 'g'), '\n\s*\n+', chr(10), 'g'), ' ') AS plain FROM pages"""
)
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as plain text."""
    return _read(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html")).alias("plain"))


@query("SELECT doc_id, CASE WHEN length(text) > 90 THEN substr(text, 1, 87) || '...' ELSE text END AS short FROM documents")
def shortened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P33."""
    return _docs(spark, sf_dir).select("doc_id", text.shorten(F.col("text")).alias("short"))


@query("SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 4 = 0 THEN [NULL] WHEN o_orderkey % 4 = 1 THEN [CAST(o_orderkey AS VARCHAR)] ELSE [CAST(o_orderkey AS VARCHAR), 'б'] END) AS value FROM orders")
def split_value_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma lists of an annotation row."""
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, "").when(k % 4 == 1, k.cast("string")).otherwise(F.concat(k.cast("string"), F.lit(" , Б ,")))
    return _read(spark, sf_dir, "orders").select("o_orderkey", F.explode(text.split_values(raw)).alias("value"))


_FRAGMENT = r"regexp_replace(substr(text, 11, 20), '^\s+|\s+$', '', 'g')"


@query(f"WITH b AS (SELECT item_id, text, {_FRAGMENT} AS f FROM benchmark) SELECT item_id, CAST(strpos(text, f) - 1 AS INT) AS start, CAST(strpos(text, f) + length(f) - 1 AS INT) AS end FROM b WHERE f <> ''")
def fragment_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first place of a fragment, whatever its white space."""
    b = _read(spark, sf_dir, "benchmark").withColumn("f", F.regexp_replace(F.substring("text", 11, 20), r"^\s+|\s+$", "")).where("f <> ''")
    at = text.find_fragment(F.col("text"), F.replace("f", F.lit(" "), F.lit("  ")))
    return b.select("item_id", at["start"].alias("start"), at["end"].alias("end"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, 'of\\s+the')) AS BIGINT) AS n, CAST(CASE WHEN regexp_matches(text, 'of\\s+the') THEN strpos(text, regexp_extract(text, 'of\\s+the')) - 1 END AS INT) AS first FROM documents")
def all_fragment_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places of a fragment in whole texts."""
    places = text.find_fragments(F.col("text"), F.lit("of the"))
    return _docs(spark, sf_dir).select("doc_id", F.size(places).cast("long").alias("n"), F.get(places, 0)["start"].alias("first"))


@query(
    """SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 7 = 0 THEN 'no fragment' END, CASE WHEN doc_id % 7 = 1 THEN 'fragment not in text' END, CASE WHEN doc_id % 5 = 0 THEN 'no law' END,
 CASE WHEN doc_id % 3 = 0 THEN 'no number' END], lambda x: x IS NOT NULL), ',') AS problems FROM documents"""
)
def row_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20: each of the four problems."""
    d = F.col("doc_id")
    fragment = F.when(d % 7 == 0, " ").when(d % 7 == 1, "no such words \\E here").otherwise("a b\\E")
    row = F.struct(fragment.alias("fragment"), F.when(d % 5 != 0, 15).alias("law_id"), F.lit(" ").alias("law_name"), F.when(d % 3 != 0, "1").alias("article"), F.lit("").alias("point"), F.lit(None).cast("string").alias("subpoint"))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(text.row_problems(F.concat(F.lit("a  b\\E "), F.col("text")), row), ",").alias("problems"))


@query()
def context_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words before and after a span, in texts of any length; a test holds it against brute force."""
    size = F.length("text")
    w = text.context_window(F.col("text"), F.least(F.lit(50), size), F.least(F.lit(70), size), 40)
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", w["before"].alias("before"), w["fragment"].alias("fragment"), w["after"].alias("after"))


@query("SELECT p_partkey, p_brand, p_name IN ('') OR length(p_name) BETWEEN 2 AND 40 AS valid FROM part")
def annotator_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F14."""
    return _read(spark, sf_dir, "part").select("p_partkey", "p_brand", text.valid_annotator(F.col("p_name")).alias("valid"))


# windows and joins over votes

_EVENTS = """WITH ev AS (SELECT event_id, user_id, event_id % 400 AS item_id, event_id AS seq, CAST(value * 1000 AS BIGINT) AS ms,
  CASE WHEN event_id % 400 % 10 = 0 THEN 'control' WHEN event_id % 400 % 10 < 8 THEN 'verify' ELSE 'missed' END AS kind, CASE WHEN event_id % 400 % 20 = 0 THEN 'yes' ELSE 'no' END AS expected, event_type FROM events),
votes AS (SELECT event_id AS vote_id, user_id AS voter, item_id, seq, ms, kind, expected,
  CASE WHEN kind = 'control' AND user_id % 3 = 0 THEN expected WHEN event_type IN ('click', 'purchase') THEN 'yes' WHEN event_type = 'signup' THEN 'no_law' WHEN event_type = 'view' THEN 'no_article' ELSE 'unsure' END AS answer FROM ev),
items AS (SELECT DISTINCT item_id, kind, expected, item_id % 3 + 1 AS n_links, CASE WHEN item_id % 50 = 8 THEN ' Конституции РФ' ELSE ' УК РФ' END AS after, item_id % 4 AS version FROM votes),
screened AS (SELECT voter, count(*) AS answers, count(*) FILTER (kind = 'control' AND answer <> 'unsure') AS controls,
  count(*) FILTER (kind = 'control' AND answer <> 'unsure' AND ((expected = 'yes') = (answer = 'yes'))) AS "right", list_sort(list(ms))[count(*) // 2 + 1] AS median_ms FROM votes GROUP BY voter),
voters AS (SELECT *, CASE WHEN controls > 0 THEN "right" / controls END AS accuracy, controls >= 3 AND coalesce("right" / controls >= 0.75, false) AS kept FROM screened),
kv AS (SELECT v.* FROM votes v JOIN voters s ON s.voter = v.voter AND s.kept WHERE v.kind <> 'control'),
ans AS (SELECT item_id, answer, count(*) AS n, min(seq) AS f FROM kv WHERE answer <> 'unsure' GROUP BY ALL),
tally AS (SELECT item_id, coalesce(sum(n) FILTER (answer = 'yes'), 0) AS yes, coalesce(sum(n) FILTER (answer <> 'yes'), 0) AS no,
  (list(answer ORDER BY n DESC, f) FILTER (answer <> 'yes'))[1] AS reason FROM ans GROUP BY item_id),
dec AS (SELECT DISTINCT k.item_id, CASE WHEN yes > no THEN 'yes' WHEN no > yes THEN reason END AS decision FROM kv k LEFT JOIN tally t USING (item_id)),
di AS (SELECT * FROM dec JOIN items USING (item_id) WHERE decision IS NOT NULL)
"""


def _votes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _read(spark, sf_dir, "events").withColumn("item_id", F.col("event_id") % 400)
    kind = F.when(F.col("item_id") % 10 == 0, "control").when(F.col("item_id") % 10 < 8, "verify").otherwise("missed")
    expected = F.when(F.col("item_id") % 20 == 0, "yes").otherwise("no")
    answer = (
        F.when((kind == "control") & (F.col("user_id") % 3 == 0), expected).when(F.col("event_type").isin("click", "purchase"), "yes")
        .when(F.col("event_type") == "signup", "no_law").when(F.col("event_type") == "view", "no_article").otherwise("unsure")
    )
    votes = e.select(F.col("event_id").alias("vote_id"), F.col("user_id").alias("voter"), "item_id", answer.alias("answer"), F.round(F.col("value") * 1000).cast("long").alias("ms"), F.col("event_id").alias("seq"))
    after = F.when(F.col("item_id") % 50 == 8, " Конституции РФ").otherwise(" УК РФ")
    items = e.select("item_id", kind.alias("kind"), expected.alias("expected"), (F.col("item_id") % 3 + 1).alias("n_links"), after.alias("after"), (F.col("item_id") % 4).alias("version")).distinct()
    return votes, items


@query(_EVENTS + 'SELECT voter, answers, controls, "right", accuracy, kept, median_ms FROM voters')
def survey_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control accuracy of each voter, the screen, the upper median time."""
    return survey.screen(*_votes(spark, sf_dir))


@query(_EVENTS + "SELECT item_id, decision FROM dec")
def survey_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority of screened voters."""
    return survey.decisions(survey.kept_votes(*_votes(spark, sf_dir)))


@query(
    _EVENTS
    + """, a AS (SELECT count(*) FILTER (kind = 'verify') AS vd, count(*) FILTER (kind = 'verify' AND decision = 'yes') AS vr,
  CAST(coalesce(sum(n_links) FILTER (kind = 'verify' AND decision = 'yes'), 0) AS BIGINT) AS lr, CAST(coalesce(sum(n_links) FILTER (kind = 'verify'), 0) AS BIGINT) AS la,
  count(*) FILTER (kind = 'missed') AS md, count(*) FILTER (kind = 'missed' AND decision = 'yes' AND NOT contains(after, 'Конституци')) AS my,
  count(*) FILTER (kind = 'missed' AND decision = 'yes' AND contains(after, 'Конституци')) AS mo FROM di)
SELECT vd AS verify_decided, vr AS verify_right, lr AS links_right, la AS links_all, md AS missed_decided, my AS missed_yes, mo AS missed_outside, vr / vd AS "precision",
 (vr / vd + 3.8416 / (2 * vd)) / (1 + 3.8416 / vd) - 1.96 * sqrt(vr / vd * (1 - vr / vd) / vd + 3.8416 / (4 * vd * vd)) / (1 + 3.8416 / vd) AS ci_low,
 (vr / vd + 3.8416 / (2 * vd)) / (1 + 3.8416 / vd) + 1.96 * sqrt(vr / vd * (1 - vr / vd) / vd + 3.8416 / (4 * vd * vd)) / (1 + 3.8416 / vd) AS ci_high,
 lr / la AS link_precision, vr / (vr + my) AS relative_recall FROM a"""
)
def survey_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision with interval, link precision, relative recall; rounded where sums of floats may differ."""
    out = survey.analyze(*_votes(spark, sf_dir))
    return out.select(*[F.round(c, 12).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(_EVENTS + "SELECT decision, count(*) AS n FROM di WHERE kind = 'verify' AND decision <> 'yes' GROUP BY decision")
def survey_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.error_histogram(*_votes(spark, sf_dir))


@query(
    _EVENTS
    + """, p AS (SELECT a.answer = 'yes' AS x, b.answer = 'yes' AS y FROM kv a JOIN kv b ON a.item_id = b.item_id AND a.vote_id < b.vote_id WHERE a.answer <> 'unsure' AND b.answer <> 'unsure')
SELECT count(*) AS pairs, count(*) FILTER (x = y) AS agreeing, count(*) FILTER (x = y) / count(*) AS agreement FROM p"""
)
def survey_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    return survey.agreement(survey.kept_votes(*_votes(spark, sf_dir)))


@query(_EVENTS + "SELECT voter, count(*) AS answers, CAST(row_number() OVER (ORDER BY count(*) DESC, CAST(voter AS VARCHAR)) AS INT) AS rank FROM votes GROUP BY voter ORDER BY answers DESC, CAST(voter AS VARCHAR) LIMIT 10")
def survey_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is a top ten."""
    return survey.leaderboard(_votes(spark, sf_dir)[0])


@query(
    _EVENTS
    + """, c AS (SELECT i.item_id, i.kind, i.version, count(v.vote_id) AS n FROM items i LEFT JOIN votes v ON i.item_id = v.item_id GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY n >= 2, version DESC, n, md5(CAST(item_id AS VARCHAR)), item_id) AS INT) AS place FROM c"""
)
def survey_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of the next items within a kind, by all votes."""
    votes, items = _votes(spark, sf_dir)
    return survey.queue(items, votes)


@query(_EVENTS + "SELECT rank, voter, answers FROM (SELECT voter, count(*) AS answers, CAST(row_number() OVER (ORDER BY count(*) DESC, CAST(voter AS VARCHAR)) AS INT) AS rank FROM votes GROUP BY voter) WHERE voter = 7")
def survey_own_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One voter's place among all."""
    return survey.place_of(_votes(spark, sf_dir)[0], 7)


@query(_EVENTS + "SELECT DISTINCT voter, item_id FROM votes")
def survey_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each voter has answered."""
    return survey.answered(_votes(spark, sf_dir)[0])


@query(
    _EVENTS
    + """, c AS (SELECT i.item_id, i.kind, i.version, count(v.vote_id) AS n FROM items i LEFT JOIN votes v ON i.item_id = v.item_id GROUP BY ALL)
SELECT * FROM c WHERE item_id NOT IN (SELECT item_id FROM votes WHERE voter = 7) ORDER BY (kind = 'control') <> ((SELECT count(*) FROM votes WHERE voter = 7) % 8 = 7), n >= 2, version DESC, n, md5(CAST(item_id AS VARCHAR)), item_id LIMIT 1"""
)
def survey_next_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is one item: what a voter is asked next, every eighth time a control."""
    votes, items = _votes(spark, sf_dir)
    return survey.next_item(items, votes, 7)


@query("SELECT o_orderkey, kind, unnest(CASE kind WHEN 'verify' THEN ['no_law', 'no_article', 'no_part', 'no_ref'] WHEN 'missed' THEN ['no_ref', 'other_doc'] ELSE CAST([] AS VARCHAR[]) END) AS answer FROM (SELECT o_orderkey, ['verify', 'missed', 'control'][o_orderkey % 3 + 1] AS kind FROM orders)")
def answer_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the second question."""
    kind = F.element_at(F.array(F.lit("verify"), F.lit("missed"), F.lit("control")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"), F.explode(display.answer_choices(kind)).alias("answer"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey AS INT) END AS law FROM part")
def law_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: a law's choice string and back; what doesn't start with a number is no choice."""
    value = F.when(F.col("p_partkey") % 4 != 0, display.choice(F.col("p_partkey"), F.col("p_name"))).otherwise(F.col("p_name"))
    return _read(spark, sf_dir, "part").select("p_partkey", display.chosen_law(value).alias("law"))


@query("SELECT p_partkey, ['пп.', 'п.', 'ч.', 'ст.'][p_partkey % 4 + 1] AS label FROM part")
def marker_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of a marker word."""
    marker = F.element_at(F.array(F.lit("Подпункту"), F.lit("пунктах"), F.lit("ч"), F.lit("статья")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _read(spark, sf_dir, "part").select("p_partkey", display.marker_label(marker).alias("label"))


@query(_EVENTS + "SELECT item_id, count(*) AS n_votes, count(DISTINCT voter) AS n_voters FROM votes GROUP BY item_id")
def survey_votes_per_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19."""
    return survey.votes_per_item(_votes(spark, sf_dir)[0])


@query("SELECT event_id % 500 AS vote_id, min(event_id) AS line FROM events GROUP BY event_id % 500")
def first_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of log lines with one vote id."""
    raw = _read(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("vote_id"), F.lit("votes-1.jsonl").alias("path"), F.col("event_id").alias("line"))
    return survey.first_votes(raw).select("vote_id", "line")


# annotation

_LABELS = """WITH rec AS (SELECT l_orderkey AS doc_id, CASE l_linenumber % 3 WHEN 0 THEN 'ann1' WHEN 1 THEN 'ann2' ELSE 'ann3' END AS annotator, l_linenumber AS seq,
   l_suppkey % 5 AS law_id, CAST(l_partkey % 7 AS VARCHAR) AS article FROM lineitem),
sav AS (SELECT doc_id, annotator, arg_max(law_id, seq) AS law_id, arg_max(article, seq) AS article FROM rec GROUP BY ALL)
"""


def _saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _dealt(_read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"), "l_orderkey", 1 << 18)
    who = F.element_at(F.array(F.lit("ann1"), F.lit("ann2"), F.lit("ann3")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    raw = l.select(
        F.col("l_orderkey").alias("doc_id"), who.alias("annotator"), F.col("l_linenumber").alias("seq"), (F.col("l_suppkey") % 5).alias("law_id"),
        (F.col("l_partkey") % 7).cast("string").alias("article"), F.lit("").alias("point"), F.lit(None).cast("string").alias("subpoint"),
    )
    return annotation.last_saves(raw, ["law_id", "article"])


_SAVED_SQL = _LABELS.replace("FROM lineitem)", "FROM (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey % 5 DESC, CAST(l_partkey % 7 AS VARCHAR) DESC) = 1))")


@query(_SAVED_SQL + "SELECT annotator, doc_id, law_id, article FROM sav")
def annotation_last_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last save of each annotator and document."""
    return _saves(spark, sf_dir).select("annotator", "doc_id", "law_id", "article")


@query(
    _SAVED_SQL
    + """, p AS (SELECT a.annotator AS "first", b.annotator AS "second", a.law_id = b.law_id AND a.article = b.article AS same FROM sav a JOIN sav b ON a.doc_id = b.doc_id AND a.annotator < b.annotator)
SELECT "first", "second", round(2 * count(*) FILTER (same) / (2 * count(*) FILTER (same) + 2 * count(*) FILTER (NOT same)), 12) AS f1, count(*) AS shared FROM p GROUP BY ALL"""
)
def annotation_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of each pair of annotators over shared documents."""
    saved = _saves(spark, sf_dir)
    out = annotation.agreement(annotation.expand_rows(saved, ["annotator", "doc_id"]), saved)
    return out.withColumn("f1", F.round("f1", 12))


@query(_SAVED_SQL + "SELECT doc_id, CASE WHEN count(DISTINCT law_id || ':' || article) = 1 THEN 'unanimous' ELSE 'conflict' END AS outcome, count(*) AS n_annotators FROM sav GROUP BY doc_id")
def annotation_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unanimity and conflicts."""
    saved = _saves(spark, sf_dir)
    return annotation.outcomes(annotation.expand_rows(saved, ["annotator", "doc_id"]), saved)


@query(
    _SAVED_SQL
    + """, j AS (SELECT doc_id, CASE WHEN annotator = 'ann3' AND doc_id % 5 = 0 THEN 'adjudicator' ELSE annotator END AS annotator, law_id, article FROM sav),
o AS (SELECT doc_id, CASE WHEN bool_or(annotator = 'adjudicator') THEN 'adjudicated' WHEN count(DISTINCT law_id || ':' || article) = 1 THEN 'unanimous' END AS outcome,
 CASE WHEN bool_or(annotator = 'adjudicator') THEN 'adjudicator' ELSE min(annotator) END AS annotator FROM j GROUP BY doc_id)
SELECT j.doc_id, j.law_id, j.article, o.outcome FROM j JOIN o USING (doc_id, annotator) WHERE o.outcome IS NOT NULL"""
)
def annotation_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of settled documents, by an adjudicator or by agreement."""
    judge = (F.col("annotator") == "ann3") & (F.col("doc_id") % 5 == 0)
    saved = _saves(spark, sf_dir).withColumn("annotator", F.when(judge, annotation.ADJUDICATOR).otherwise(F.col("annotator")))
    return annotation.gold(annotation.expand_rows(saved, ["annotator", "doc_id"]), saved).select("doc_id", "law_id", "article", "outcome")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 3 = 0 THEN 'rows and no links' WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN 'neither rows nor no links' END AS problem FROM orders")
def annotation_save_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and the mark that there are none exclude each other."""
    k = F.col("o_orderkey")
    rows = F.when(k % 2 == 1, F.array(k)).when(k % 4 == 0, F.array().cast("array<bigint>"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", annotation.save_problem(rows, F.when(k % 3 == 0, True)).alias("problem"))


@query(
    """WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS law_id, CAST(l_linenumber AS VARCHAR) AS article, l_linenumber AS o FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
SELECT doc_id, law_id, array_to_string(list(article ORDER BY o), ', ') AS article, '' AS point_article, '' AS subpoint_article FROM l GROUP BY doc_id, law_id"""
)
def suggestion_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a span merged into one row of comma lists."""
    none = F.lit(None).cast("string")
    l = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("law_id"), F.col("l_linenumber").cast("string").alias("article"), none.alias("point_article"), none.alias("subpoint_article"), F.col("l_linenumber").alias("link_ord")).distinct()
    return annotation.merged_rows(l, ["doc_id"])


@query("WITH s AS (SELECT DISTINCT doc_id FROM labels) SELECT min(d.doc_id) AS doc_id FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id WHERE s.doc_id IS NULL")
def annotation_next_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first task without a record."""
    return annotation.next_document(_docs(spark, sf_dir).select("doc_id", F.col("doc_id").alias("ord")), _read(spark, sf_dir, "labels"))


_SIDE = "(SELECT l_orderkey AS doc_id, l_linenumber % 3 AS law_id, CASE WHEN l_quantity % 2 = 0 THEN l_returnflag END AS article FROM lineitem WHERE l_linenumber {op} 3)"


@query(
    f"""WITH g AS (SELECT doc_id, law_id, article, count(*) AS n FROM {_SIDE.format(op='<=')} GROUP BY ALL), p AS (SELECT doc_id, law_id, article, count(*) AS n FROM {_SIDE.format(op='>=')} GROUP BY ALL),
b AS (SELECT coalesce(g.n, 0) AS g, coalesce(p.n, 0) AS p FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.law_id = p.law_id AND g.article IS NOT DISTINCT FROM p.article),
s AS (SELECT CAST(sum(least(g, p)) AS BIGINT) AS tp, CAST(sum(p - least(g, p)) AS BIGINT) AS fp, CAST(sum(g - least(g, p)) AS BIGINT) AS fn FROM b)
SELECT tp, fp, fn, round(tp / (tp + fp), 12) AS "precision", round(tp / (tp + fn), 12) AS recall, round(2 * tp / (2 * tp + fp + fn), 12) AS f1 FROM s"""
)
def multiset_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 with nulls as values."""
    out = evaluation.scores(evaluation.compared(*_sides(spark, sf_dir), ["doc_id"], ["law_id", "article"]))
    return out.select("tp", "fp", "fn", *[F.round(c, 12).alias(c) for c in ("precision", "recall", "f1")])


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    l = _read(spark, sf_dir, "lineitem")
    side = lambda keep: l.where(keep).select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3).alias("law_id"), F.when(F.col("l_quantity") % 2 == 0, F.col("l_returnflag")).alias("article"))
    return side("l_linenumber <= 3"), side("l_linenumber >= 3")


@query(
    f"""WITH g AS (SELECT doc_id, law_id, article, count(*) AS n FROM {_SIDE.format(op='<=')} GROUP BY ALL), p AS (SELECT doc_id, law_id, article, count(*) AS n FROM {_SIDE.format(op='>=')} GROUP BY ALL)
SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, coalesce(g.law_id, p.law_id) AS law_id, coalesce(g.article, p.article) AS article, CASE WHEN coalesce(p.n, 0) > coalesce(g.n, 0) THEN 'FP' ELSE 'FN' END AS kind, abs(coalesce(p.n, 0) - coalesce(g.n, 0)) AS n
FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.law_id = p.law_id AND g.article IS NOT DISTINCT FROM p.article WHERE coalesce(g.n, 0) <> coalesce(p.n, 0)"""
)
def multiset_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O4, J13."""
    return evaluation.differences(*_sides(spark, sf_dir), ["doc_id"], ["law_id", "article"])


# context steps


@query("SELECT event_id, last_value(CASE WHEN event_id % 5 < 2 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS law FROM events")
def back_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last law of the same kind before a row."""
    e = _read(spark, sf_dir, "events").withColumn("named", F.when(F.col("event_id") % 5 < 2, F.col("event_id")))
    return context.last_of_kind(e, ["user_id"], ["ts", "event_id"], "event_type", "named", "law").select("event_id", "law")


@query(
    """WITH s AS (SELECT *, CASE WHEN lag(l_linenumber % 3 <> 0) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) THEN 0 ELSE 1 END AS new FROM lineitem),
r AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, first_value(CASE WHEN l_partkey % 2 = 0 THEN l_partkey END IGNORE NULLS) OVER (PARTITION BY l_orderkey, run ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS law FROM r"""
)
def enumeration_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of an enumeration takes the law of the next row that has one."""
    l = _read(spark, sf_dir, "lineitem").withColumn("named", F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey"))).withColumn("joined", F.col("l_linenumber") % 3 != 0)
    return context.fill_from_next(l, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "named", "joined", "law").select("l_orderkey", "l_linenumber", "l_partkey", "law")


@query("SELECT event_id, coalesce(max(event_id % 97) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bound FROM events")
def left_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W9."""
    e = _read(spark, sf_dir, "events").withColumn("end", F.col("event_id") % 97)
    return context.running_bound(e, ["user_id"], ["ts", "event_id"], "end", "bound").select("event_id", "bound")


@query(
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 60 AS s, l_partkey % 60 + 5 AS e FROM lineitem), v AS (SELECT o_orderkey, o_custkey % 60 AS s, o_custkey % 60 + 12 AS e FROM orders)
SELECT l_orderkey, l_linenumber, l_partkey FROM c WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.o_orderkey = c.l_orderkey AND c.e > v.s AND c.s < v.e)"""
)
def missed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates outside covered spans."""
    c = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 60).alias("start"), (F.col("l_partkey") % 60 + 5).alias("end"))
    v = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_custkey") % 60).alias("start"), (F.col("o_custkey") % 60 + 12).alias("end"))
    return context.outside(c, v, ["doc"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT item_id, CAST(k AS INT) AS k, array_to_string(ws[1:k], ' ') AS prefix FROM (SELECT item_id, regexp_extract_all(lower(text), '[^\\s]+') AS ws FROM benchmark) t, unnest(range(1, least(len(ws), 20) + 1)) AS u(k)")
def name_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes of 1 to 20 words."""
    b = _read(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit(r"([^\s]+)"), F.lit(1)).alias("ws"))
    return context.prefixes(b, "ws").select("item_id", "k", "prefix")


@query(
    r"""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[^\s]+') AS ws FROM benchmark), a AS (SELECT item_id AS law_id, array_to_string(ws[1:CAST(item_id % 4 + 2 AS INT)], ' ') AS key FROM w),
p AS (SELECT item_id, CAST(k AS INT) AS k, array_to_string(ws[1:k], ' ') AS prefix FROM w, unnest(range(1, least(len(ws), 20) + 1)) AS u(k)), f AS (SELECT p.item_id, p.k, a.law_id FROM p JOIN a ON p.prefix = a.key)
SELECT item_id, k, law_id FROM f QUALIFY k = min(k) OVER (PARTITION BY item_id)"""
)
def shortest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest prefix that is a name, with all laws of that name."""
    b = _read(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit(r"([^\s]+)"), F.lit(1)).alias("ws"))
    names = b.select(F.col("item_id").alias("law_id"), F.array_join(F.slice("ws", F.lit(1), (F.col("item_id") % 4 + 2).cast("int")), " ").alias("alias_key"))
    return context.shortest_exact(context.prefixes(b, "ws"), names, ["item_id"]).select("item_id", "k", "law_id")


_TRI = """WITH t AS (SELECT l_linestatus || l_returnflag AS tag, coalesce(lag(l_linestatus || l_returnflag, 2) OVER w, '^') AS before2, coalesce(lag(l_linestatus || l_returnflag) OVER w, '^') AS before1
 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)), c AS (SELECT before2, before1, tag, count(*) AS n FROM t GROUP BY ALL)
"""


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("o"), F.concat("l_linestatus", "l_returnflag").alias("tag"))


@query(_TRI + "SELECT * FROM c")
def tag_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: role trigram counts."""
    return context.tag_counts(_tagged(spark, sf_dir), "l_orderkey", "o")


@query(
    _TRI
    + """SELECT before2, before1, tag, n, round(ln(0.8 * (n + 0.01) / (sum(n) OVER (PARTITION BY before2, before1) + 0.06) + 0.15 * (sum(n) OVER (PARTITION BY before1, tag) + 0.01) / (sum(n) OVER (PARTITION BY before1) + 0.06)
 + 0.05 * (sum(n) OVER (PARTITION BY tag) + 0.01) / (sum(n) OVER () + 0.06)), 6) AS log_p FROM c"""
)
def smoothed_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: interpolation and add-k smoothing."""
    out = context.smoothed(context.tag_counts(_tagged(spark, sf_dir), "l_orderkey", "o"), 6)
    return out.withColumn("log_p", F.round("log_p", 6))


# similarity

_GRAMS = """g AS (SELECT id, substr(p, i, n) AS gram FROM (SELECT id, ' ' || w || ' ' AS p FROM (SELECT id, unnest(regexp_extract_all(lower(key), '[^\\s]+')) AS w FROM src)) x, unnest(range(3, 6)) AS a(n), unnest(range(1, greatest(2, length(p) - n + 2))) AS b(i) WHERE n = 3 OR n <= length(p)),
tf AS (SELECT id, gram, count(*) AS n FROM g GROUP BY ALL)"""
_NAMES = "SELECT DISTINCT CAST(p_size AS BIGINT) * 1000 + p_partkey % 10 AS id, p_name || ' ' || p_type AS key FROM part WHERE p_partkey < 200"


@query(f"WITH src AS (SELECT item_id AS id, text AS key FROM benchmark), {_GRAMS} SELECT gram, count(*) AS df, round(ln((1 + (SELECT count(*) FROM src)) / (1 + count(*))) + 1, 6) AS idf FROM tf GROUP BY gram")
def gram_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: document frequency and idf."""
    b = _read(spark, sf_dir, "benchmark")
    counts = similarity.term_counts(b, "item_id", "text")
    df = counts.groupBy("gram").agg(F.count("*").alias("df"))
    return df.join(similarity.inverse_frequency(counts, b), "gram").select("gram", "df", F.round("idf", 6).alias("idf"))


@query()
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2, J3, A5, F2 over whole texts; a test holds it against brute force."""
    return similarity.similar_keys(_read(spark, sf_dir, "benchmark"), "item_id", "text", 0.85).withColumn("similarity", F.round("similarity", 6))


# audit and corpus


@query("SELECT lower(trim(p_name)) AS name, count(DISTINCT p_size) AS n_laws, array_to_string(list_sort(list(DISTINCT p_size)), ',') AS laws FROM part GROUP BY lower(trim(p_name)) HAVING count(DISTINCT p_size) > 1")
def audit_shared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14, O3."""
    return audit.shared_names(_read(spark, sf_dir, "part"), "p_name", "p_size")


@query("SELECT CAST(i AS BIGINT) AS doc_id FROM (SELECT unnest(range(min(doc_id), max(doc_id) + 1)) AS i FROM labels) WHERE i NOT IN (SELECT doc_id FROM labels)")
def audit_missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps in ids."""
    return audit.missing_ids(_read(spark, sf_dir, "labels"), "doc_id")


@query("SELECT n_name, array_to_string(list_sort(list(DISTINCT CAST(s_suppkey AS VARCHAR)) FILTER (s_suppkey IS NOT NULL)), ',') AS laws FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def audit_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laws of each checklist name, over all rows."""
    checklist = _read(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").alias("key"))
    index = _read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("law_id"))
    return audit.coverage(checklist, index).select("n_name", "laws")


@query(
    """SELECT p_partkey, unnest(list_filter([CASE WHEN p_partkey % 4 = 0 THEN 'spaces' END, CASE WHEN p_partkey % 3 = 0 THEN 'quotes' END, CASE WHEN p_partkey % 5 = 0 THEN 'edition' END], lambda x: x IS NOT NULL)) AS fault FROM part"""
)
def audit_format_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10."""
    k = F.col("p_partkey")
    name = F.concat(F.col("p_name"), F.when(k % 3 == 0, " «О связи").otherwise(" «О связи»"), F.when(k % 5 == 0, " (в ред. 2020)").otherwise(""), F.when(k % 4 == 0, " ").otherwise(""))
    return audit.faults(_read(spark, sf_dir, "part").select("p_partkey", name.alias("name"))).select("p_partkey", "fault")


@query("SELECT count(*) AS laws, CAST(sum(n) AS BIGINT) AS names, count(*) FILTER (n = 0) AS without_names FROM (SELECT p_size, count(DISTINCT p_name) FILTER (p_partkey % 17 = p_size % 17) AS n FROM part GROUP BY p_size)")
def dictionary_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laws, names, and laws without a name."""
    listed = F.collect_set(F.when(F.col("p_partkey") % 17 == F.col("p_size") % 17, F.col("p_name")))
    return audit.totals(_read(spark, sf_dir, "part").groupBy("p_size").agg(listed.alias("names")))


@query("SELECT p_size AS law_id, p_name AS name FROM part WHERE contains(lower(p_name), 'a') ORDER BY p_size, p_name LIMIT 8")
def audit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: the feature is a list of eight names that hold a string."""
    return audit.search(_read(spark, sf_dir, "part").select(F.col("p_size").alias("law_id"), F.col("p_name").alias("name")), "A")


@query("SELECT 'о договор ' || chr(1072 + CAST(k AS INT)) AS \"key\", CAST(2 AS BIGINT) AS n_laws, CAST(2 AS BIGINT) AS n_names FROM (SELECT DISTINCT p_size % 20 AS k FROM part)")
def audit_stem_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of other laws that differ by endings alone."""
    k = (F.col("p_size") % 20).cast("int")
    letter = F.substring(F.lit("абвгдежзийклмнопрсту"), k + 1, F.lit(1))
    names = _read(spark, sf_dir, "part").select(F.explode(F.array(F.struct(F.concat(F.lit("О договоре "), letter).alias("name"), k.alias("law_id")), F.struct(F.concat(F.lit("о договорах "), letter).alias("name"), (k + 100).alias("law_id")))).alias("n"))
    return audit.stem_conflicts(names.select("n.*"))


@query("SELECT p_partkey FROM part WHERE len(string_split(p_name, ' ')) <= 2")
def audit_generic_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quoted names of two words at most."""
    name = F.concat(F.lit("Закон «"), F.regexp_replace("p_name", r"[^\\w ]", ""), F.lit("»"))
    return _read(spark, sf_dir, "part").where(text.generic_quoted(name)).select("p_partkey")


@query(
    """WITH r AS (SELECT doc_id, source, md5('7:' || doc_id) AS r FROM documents) SELECT doc_id, source FROM r QUALIFY row_number() OVER (PARTITION BY source ORDER BY r, doc_id) <= 5"""
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: the feature is a sample of five of each source."""
    return corpus.stratified_sample(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id", "source", 5, 7)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT conv_id FROM conversations)")
def unused_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in none of the used sets."""
    used = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"))
    return corpus.unused(_docs(spark, sf_dir).select("doc_id"), "doc_id", _read(spark, sf_dir, "labels"), used)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'в отношении ФИО Судья ФИО, ФИО' ELSE 'дело рассмотрено судьей ФИО' END AS masked FROM orders")
def anonymized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and their other forms masked."""
    raw = F.when(F.col("o_orderkey") % 2 == 0, "в отношении Петрова И.И. Судья О.Н. Стасенко, Петровой").otherwise("дело рассмотрено судьей Смирновой А.Б.")
    return _read(spark, sf_dir, "orders").select("o_orderkey", corpus.anonymize(raw).alias("masked"))


@query(
    r"""SELECT doc_id, sentence FROM (SELECT doc_id, trim(unnest(string_split(replace(regexp_replace(text, '([.!?])\s+(\p{Lu})', '\1' || chr(1) || '\2', 'g'), chr(10), chr(1)), chr(1)))) AS sentence FROM documents) WHERE length(sentence) BETWEEN 5 AND 400"""
)
def plain_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of whole texts that are fit for training."""
    return corpus.plain_sentences(_docs(spark, sf_dir), "doc_id", "text")


@query()
def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of lines from a line drawn by hash."""
    return corpus.line_windows(_docs(spark, sf_dir), "doc_id", "text", 1500, 3)


def _control_items(l: DataFrame) -> DataFrame:
    items = l.select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 20).alias("law_id"), F.col("l_partkey").cast("string").alias("article"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("o"))
    out = corpus.control_items(items, "o")
    return out.select("l_orderkey", "l_linenumber", F.col("law_id").cast("long").alias("law_id"), "article", "expected")


@query(
    """WITH n AS (SELECT l_orderkey, l_linenumber, l_suppkey % 20 AS law_id, CAST(l_partkey AS VARCHAR) AS article, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS k FROM lineitem),
m AS (SELECT *, CASE law_id WHEN 5 THEN 13 WHEN 13 THEN 5 WHEN 15 THEN 10 WHEN 10 THEN 15 WHEN 17 THEN 12 WHEN 12 THEN 17 WHEN 0 THEN 6 WHEN 6 THEN 0 WHEN 7 THEN 8 WHEN 8 THEN 7 END AS swap FROM n)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN k % 4 = 1 AND swap IS NOT NULL THEN swap ELSE law_id END AS BIGINT) AS law_id,
 CASE WHEN k % 2 = 1 AND NOT (k % 4 = 1 AND swap IS NOT NULL) THEN CAST(CAST(article AS BIGINT) + [1, 2, 3, 7, 10][k % 5 + 1] AS VARCHAR) ELSE article END AS article, CASE WHEN k % 2 = 1 THEN 'no' ELSE 'yes' END AS expected FROM m"""
)
def control_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section 2.13: corrupted control items, over all rows."""
    return _control_items(_read(spark, sf_dir, "lineitem"))


# what is shown, and small sources


@query("SELECT p_size AS law_id, arg_min(p_name, p_partkey) AS title FROM part GROUP BY p_size")
def display_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: a title for each law: here no name has a number, so the first."""
    names = _read(spark, sf_dir, "part").select(F.col("p_size").alias("law_id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    return display.law_titles(names).select("law_id", "title")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'п./ч. 1 ' WHEN o_orderkey % 3 = 1 THEN 'пп. 2 п./ч. 1 ' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN 'статья не указана' ELSE 'ст. ' || o_orderkey END || ' — УК РФ' AS claim FROM orders")
def display_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as citations."""
    k, none = F.col("o_orderkey"), F.array().cast("array<string>")
    one = lambda when, v: F.when(when, F.array(v)).otherwise(none)
    claim = display.reading(one(k % 5 != 0, k.cast("string")), one(k % 3 != 2, F.lit("1")), one(k % 3 == 1, F.lit("2")), F.lit("УК РФ"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", claim.alias("claim"))


@query("SELECT o_orderkey, o_orderkey % 3 = 1 AS named, CAST(CASE WHEN o_orderkey % 3 = 1 THEN 11 ELSE 5 END AS INT) AS shown_end FROM orders")
def display_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents named after a span, and the end that is highlighted."""
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, "ст. 5). УК РФ").when(k % 3 == 1, "ст. 5 УК РФ и иное").otherwise("ст. 5, ст. 6 УК РФ")
    end = F.when(k % 3 == 0, 5).when(k % 3 == 1, 8).otherwise(18)
    starts = F.when(k % 3 == 2, F.array(F.lit(0), F.lit(7))).otherwise(F.array(F.lit(0)))
    out = _read(spark, sf_dir, "orders").select("o_orderkey", raw.alias("t"), end.alias("e"), starts.alias("s"))
    return out.select("o_orderkey", display.names_document(F.col("t"), F.lit(5)).alias("named"), display.display_end(F.col("t"), F.lit(0), F.col("e"), F.col("s")).alias("shown_end"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE replace(c_name, '#', ' ') END AS nick FROM customer")
def voter_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P27."""
    raw = F.when(F.col("c_custkey") % 4 == 0, " x ").otherwise(F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit("  \t")), F.lit("\n")))
    return _read(spark, sf_dir, "customer").select("c_custkey", display.voter_name(raw).alias("nick"))


@query("SELECT p_partkey, p_brand AS name, CAST(p_size AS VARCHAR) AS k FROM part")
def variant_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R5."""
    spec = F.concat("p_brand", F.lit("?k="), "p_size", F.lit("&z=1"))
    return _read(spark, sf_dir, "part").withColumn("p", display.parameters(spec)).select("p_partkey", "p.name", F.col("p.options")["k"].alias("k"))


@query(r"""SELECT h AS href, min(page_id) AS page FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)) AS h FROM pages) GROUP BY h""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in pages, each once."""
    return display.page_links(_read(spark, sf_dir, "pages"), "page_id", "html")


@query("SELECT doc_id, CAST(length(text) AS INT) AS chars FROM documents WHERE length(text) >= 1000 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def corpus_index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a corpus index lacks, short texts left out."""
    return display.new_index_rows(_docs(spark, sf_dir), _read(spark, sf_dir, "labels"), "doc_id", "text").select("doc_id", "chars")


@query()
def ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of variants of the law steps over the generator's texts."""
    gold, texts = _expected(spark, sf_dir), _orders_text(spark, sf_dir)
    variants = {"full": laws.Settings(), "no anaphora": laws.Settings(anaphora=False), "no naive Bayes": laws.Settings(naive_bayes=False), "threshold 0.95": laws.Settings(threshold=0.95)}
    out = None
    for name, settings in variants.items():
        one = evaluation.scores(evaluation.compared(gold, plan.extract(texts, settings=settings), ["doc_id"])).select(F.lit(name).alias("variant"), "tp", "fp", "fn", "f1")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def synthetic_role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged texts drawn on the executors, one seed for each block, and their role trigrams."""
    from statuta.sources.packaging import ship

    ship(spark)

    def draw(batches):
        import pandas as pd

        for batch in batches:
            for block in batch["id"]:
                for i, (_, roles) in enumerate(synthetic.texts(50, seed=int(block))):
                    yield pd.DataFrame({"text": int(block) * 50 + i, "pos": range(len(roles)), "tag": roles})

    tagged = spark.range(0, 16, 1, 8).mapInPandas(draw, "text long, pos long, tag string")
    return context.tag_counts(tagged, "text", "pos")
