import html
import json
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from statuta.functions import laws, lexicon, noise, tagging, text
from statuta.operators import annotation, context, corpus, evaluation, similarity, survey
from statuta.plans import extract as plan
from statuta.plans import pack
from statuta.sources import tables
from statuta.streaming import votes as stream

LINK = "doc_id string, law_id int, article string, point_article string, subpoint_article string"


def one(df):
    return [tuple(r) for r in df.collect()]


def test_fold_tables():
    assert len(text.FOLD_FROM) == len(text.FOLD_TO)
    assert len(text.LATIN_LOOKALIKES) == len(text.CYRILLIC_LOOKALIKES)


def test_normalize_is_that_of_the_kernel(spark):
    raw = ["cт. 5 УK PФ, Latin", "«Закон» —\tё", "", None, "только кириллица", "𝒳 cт"]
    out = spark.createDataFrame([(r,) for r in raw], "t string").select(text.normalize(F.col("t")))
    assert [r[0] for r in out.collect()] == [None if r is None else tagging.fold(r) for r in raw]


def test_extract_edges(spark):
    rows = [("a", "пп. 1, 2 п. 2 ст. 3 НК РФ", 1), ("b", None, 2), ("c", "", 3), (None, "ст. 5 УК РФ", 4), ("a", "ст. 5 УК РФ", 5), ("d", "no letters", 6)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, law_id int")
    links = plan.extract(docs).orderBy("doc_id", "chain_ord", "link_ord").select("doc_id", "law_id", "article", "point_article", "subpoint_article")
    assert sorted(one(links), key=str) == sorted([("a", 15, "3", "2", "1"), ("a", 15, "3", "2", "2"), ("a", 13, "5", None, None), (None, 13, "5", None, None)], key=str)
    assert plan.extract(docs.limit(0)).count() == 0


def test_scores_of_nothing_and_nulls(spark):
    empty = spark.createDataFrame([], LINK)
    r = evaluation.scores(evaluation.compared(empty, empty, ["doc_id"])).first()
    assert (r["tp"], r["precision"], r["recall"], r["f1"]) == (0, 1.0, 1.0, 1.0)
    some = spark.createDataFrame([("a", 1, None, "2", None), ("a", 1, None, "2", None)], LINK)
    r = evaluation.scores(evaluation.compared(some, some.limit(1), ["doc_id"])).first()
    assert (r["tp"], r["fp"], r["fn"]) == (1, 0, 1)


def test_wilson_and_decide(spark):
    r = spark.range(1).select(survey.wilson(F.lit(0), F.lit(0)).alias("w"), survey.wilson(F.lit(64), F.lit(67)).alias("v")).first()
    assert tuple(r["w"]) == (0.0, 1.0)
    assert [round(x, 3) for x in r["v"]] == [0.876, 0.985]
    votes = spark.createDataFrame([("i", "no_law", 1), ("i", "no_ref", 2), ("i", "yes", 3), ("j", "yes", 4), ("j", "no", 5), ("k", "unsure", 6)], "item_id string, answer string, seq long")
    assert dict(one(survey.decisions(votes))) == {"i": "no_law", "j": None, "k": None}


def test_screen_without_controls(spark):
    votes = spark.createDataFrame([("v", "x", "yes", None)], "voter string, item_id string, answer string, ms long")
    items = spark.createDataFrame([], "item_id string, kind string, expected string")
    r = survey.screen(votes, items).first()
    assert (r["controls"], r["accuracy"], r["kept"], r["median_ms"]) == (0, None, False, 0)


def test_anonymize(spark):
    raw = "в отношении Насртдиновой ДТ. Гражданка Насртдинова Д.Т., ТУРБИНА Виктора Сергеевича, судья О.Н. Стасенко, Гузь А., мировой судья по ст. 12.8 ч. 1 КоАП РФ, Кодекса РФ"
    wanted = "в отношении ФИО ДТ. Гражданка ФИО, ФИО, судья ФИО, ФИО, мировой судья по ст. 12.8 ч. 1 КоАП РФ, Кодекса РФ"
    lines = "Иванов И.И.\nО.А.\nРассмотрев дело"
    out = spark.createDataFrame([(raw,), (lines,), (None,)], "t string").select(corpus.anonymize(F.col("t")))
    assert [r[0] for r in out.collect()] == [wanted, "ФИО\nО.А.\nРассмотрев дело", None]


def test_merged_rows_of_no_product(spark):
    rows = [("a", 1, "1", "1", None, 0), ("a", 1, "2", "2", None, 1)]
    df = spark.createDataFrame(rows, "doc_id string, law_id int, article string, point_article string, subpoint_article string, link_ord int")
    assert len(one(annotation.merged_rows(df, ["doc_id"]))) == 2


def test_outside(spark):
    c = spark.createDataFrame([("a", 0, 5), ("a", 5, 8), ("b", 0, 5)], "doc string, start int, end int")
    v = spark.createDataFrame([("a", 5, 6)], "doc string, start int, end int")
    assert sorted(one(context.outside(c, v, ["doc"]))) == [("a", 0, 5), ("b", 0, 5)]


def test_sources(spark, tmp_path):
    (tmp_path / "laws.json").write_text(json.dumps({"15": ["НК РФ", "НК"], "13": ["УК РФ"]}, ensure_ascii=False), "utf-8")
    found = tables.collect_dictionary(tables.read_dictionary(spark, str(tmp_path / "laws.json")))
    assert sorted(found[15]) == ["НК", "НК РФ"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_text("ст. 5 УК РФ", "utf-8")
    case = {"id": "x", "text_file": "t/x.txt", "notes": [], "links": [{"law_id": 13, "article": "5", "point_article": None, "subpoint_article": None}]}
    (tmp_path / "gold.json").write_text(json.dumps({"cases": [case]}, ensure_ascii=False), "utf-8")
    gold = tables.read_gold(spark, str(tmp_path / "gold.json"), str(tmp_path / "t"))
    r = gold.first()
    assert r["text"] == "ст. 5 УК РФ" and r["links"][0]["article"] == "5"
    assert "| id |" in tables.markdown_table(gold.select("id"))


def test_streamed_votes(spark, tmp_path):
    folder = tmp_path / "votes"
    folder.mkdir()
    line = lambda i, item: json.dumps({"vote_id": f"v{i}", "item_id": item, "answer": "yes", "voter": "a", "time": "2024-01-01T00:00:00Z"})
    (folder / "a.json").write_text("\n".join([line(1, "x"), line(2, "x"), line(1, "x")]))
    q = stream.counts(stream.read_votes(spark, str(folder))).writeStream.format("memory").queryName("vote_counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert one(spark.table("vote_counts")) == [("x", "yes", 2)]


def test_extend_adds_short_names():
    names = lexicon.extend(lexicon.SEED_LAWS)
    assert "КАС РФ" in names[18] and "КоАП" in names[17]
    assert "Федеральный закон №40-ФЗ от 25.04.2002" in names[397]


def test_numbered_rows(spark):
    rows = [((i * 7919) % 5000 // 3, i % 2) for i in range(5000)] + [(None, 1), (-5, 0)] + [(9, 9)] * 300
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", F.struct("a", "b").alias("o")).repartition(7)
    got = sorted((r["n"], r["a"], r["b"]) for r in corpus.numbered_rows(df, "o", "n").collect())
    assert [n for n, _, _ in got] == list(range(len(rows)))
    assert [(a, b) for _, a, b in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert corpus.numbered_rows(df.limit(0), "o", "n").count() == 0


def test_control_items_bring_no_table_into_one_task(spark):
    items = spark.range(10_000).select("id", (F.col("id") % 20).alias("law_id"), F.col("id").cast("string").alias("article"))
    out = corpus.control_items(items.repartition(8), "id")
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "row_number() windowspecdefinition(_range" in plan and "row_number() windowspecdefinition(id" not in plan
    assert sum(r["expected"] == "no" for r in out.collect()) == 5000


def brute_similar(rows, threshold):
    grams = {}
    for i, key in rows:
        words = [f" {w} " for w in key.lower().split()]
        grams[i] = Counter(w[k : k + n] for w in words for n in (3, 4, 5) if n == 3 or n <= len(w) for k in range(max(1, len(w) - n + 1)))
    df = Counter(g for c in grams.values() for g in c)
    w = {i: {g: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[g])) + 1) for g, n in c.items()} for i, c in grams.items()}
    w = {i: {g: x / math.sqrt(sum(y * y for y in v.values())) for g, x in v.items()} for i, v in w.items()}
    sims = {i: {j: sum(x * w[j].get(g, 0) for g, x in w[i].items()) for j in w} for i in w}
    return {(i, j, round(s, 6)) for i, v in sims.items() for j, s in v.items() if max(v.values()) >= threshold and s >= max(v.values()) - 1e-9}


def test_similar_keys_are_compared_whole(spark, sf):
    head = "статья кодекса об административных правонарушениях " * 4
    rows = [(1, head + "первая редакция"), (2, head + "совсем иной конец"), (3, head + "первая редакция"), (4, "short name"), (5, "a bc")]
    got = {tuple(r) for r in similarity.similar_keys(spark.createDataFrame(rows, "item_id long, text string"), "item_id", "text", 0.85).select("query", "match", F.round("similarity", 6)).collect()}
    assert got == brute_similar(rows, 0.85)
    assert {j for i, j, _ in got if i == 1} == {1, 3} and {j for i, j, _ in got if i == 2} == {2}
    some = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").limit(40).collect()]
    assert any(len(t) > 120 for _, t in some)
    got = similarity.similar_keys(spark.createDataFrame(some, "item_id long, text string"), "item_id", "text", 0.85)
    assert {(r["query"], r["match"]) for r in got.collect()} == {(i, j) for i, j, _ in brute_similar(some, 0.85)}


def test_drawn_noise(spark):
    raw = "Руководствуясь частью 1 ст. 5 Кодекса Российской Федерации, ч. 2 ст. 12.8 КоАП РФ"
    docs = spark.createDataFrame([(str(i), raw) for i in range(40)] + [("x", None)], "doc_id string, text string")
    families = ["clean", *noise.FAMILIES, "all"]
    rows = corpus.drawn_noise(docs, families, 3).collect()
    assert len(rows) == 41 * (1 + 3 * 8)
    assert all(r["text"] == (raw if r["family"] == "clean" else noise.noisy(raw, r["doc_id"], r["family"], r["seed"])) for r in rows if r["text"] is not None)
    for f in families[1:]:
        texts = {r["text"] for r in rows if r["family"] == f and r["text"]}
        assert len(texts) > 1, f
        assert all("".join(c for c in t if c.isdigit()) == "152128" for t in texts)
    assert all(noise.noisy(raw, 1, f, 0, 0.0) == raw for f in noise.FAMILIES if f != "case")
    assert all(len(noise.noisy(raw, i, "typos", 0).split()) == len(raw.split()) for i in range(40))


def test_references_are_resolved_as_the_library_does(spark):
    raw = ["a &amp;lt; b &lt;&gt;", "&nbsp;&mdash;&laquo;x&raquo;&hellip;", "&#1071;&#x42F;&#39;&#128512;", "&nosuch; & &; &#; &amp", "no reference", "&#xD800; &#99999999;", None, "&eacute;&Eacute;"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in raw], "t string").coalesce(1).select(text.unescape(F.col("t"))).collect()]
    for r, g in zip(raw, got, strict=True):
        if r and "D800" not in r and "nosuch" not in r:
            assert g == html.unescape(r)
    assert got[3] == raw[3] and got[5] == raw[5] and got[6] is None


def test_pages_and_footers(spark):
    page = "x<body>START<p>a&nbsp; b</p><script>no</script><!-- no -->c<br/>d END tail"
    row = spark.createDataFrame([(page, "Решение\nтекст\nСуд: Тверской районный\nтекст", "нет")], "p string, t string, u string").select(
        text.html_text(F.col("p"), "START", "END"), text.strip_footer(F.col("t")), text.strip_footer(F.col("u"))
    )
    assert tuple(row.first()) == ("a b\nc\nd", "Решение\nтекст", "нет")


def test_all_places_of_a_fragment(spark):
    rows = [("a b a  b\na b", "a b"), ("aaa", "aa"), ("x", "y"), ("x", " "), ("x\\Ey x\\Ey", "x\\Ey"), (None, "x"), ("x", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, f string").coalesce(1).select(text.find_fragments(F.col("t"), F.col("f"))).collect()]
    assert [[tuple(p) for p in r] if r is not None else None for r in got] == [[(0, 3), (4, 8), (9, 12)], [(0, 2)], [], [], [(0, 4), (5, 9)], None, []]


def test_token_offsets(spark):
    wanted = lambda r: [(m[0], m.start(), m.end()) for m in re.finditer(text.CHAIN_TOKEN, r)]
    raw = ["ст. 5, п. 1-2 " * 20, "", " ", None, "a"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in raw], "t string").coalesce(1).select(text.chain_tokens(F.col("t"))).collect()]
    assert [None if g is None else [tuple(t) for t in g] for g in got] == [None if r is None else wanted(r) for r in raw]
    long = [*raw, "ст. 5, п. 1-2 " * 2000]
    rows = text.token_rows(spark.createDataFrame(list(enumerate(long)), "i int, t string"), "i", "t").orderBy("i", "start").collect()
    assert [(r["i"], r["token"], r["start"], r["end"]) for r in rows] == [(i, *t) for i, x in enumerate(long) for t in wanted(x or "")]


def test_pack_contents(spark):
    rows = [
        (1, "Суд применил ч. 2 ст. 5 УК РФ и отказал."), (2, "Срок по п. 3 ст. 8 Положения о комиссии истек."), (3, "Иванов И.И. (часть 4) явился."), (4, None), (5, ""), (6, "На основании ст. 7 ГК РФ и ст. 9 ТК РФ решено."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("clash"))
    got = {r["item_id"]: r for r in pack.items(docs, laws.LawIndex(lexicon.extend(lexicon.SEED_LAWS))).collect()}
    assert {k: r["kind"] for k, r in got.items()} == {"1-0": "verify", "1-0-c": "control", "2-0": "missed", "6-0": "verify", "6-0-c": "control", "6-1": "verify", "6-1-c": "control"}
    assert got["1-0"]["fragment"] == "ч. 2 ст. 5 УК РФ" and got["1-0"]["claim"] == "п./ч. 2 ст. 5 — УК РФ" and got["1-0"]["before"] == "Суд применил " and got["1-0"]["markers"] == ["ч.", "ст."]
    assert got["2-0"]["claim"] is None and got["2-0"]["after"].startswith(" Положения")
    controls = [got[k] for k in ("1-0-c", "6-0-c", "6-1-c")]
    assert [r["expected"] for r in controls] == ["yes", "no", "yes"] and controls[1]["claim"] != "ст. 7 — ГК РФ" and controls[2]["claim"] == "ст. 9 — ТК РФ"
    assert pack.items(docs.limit(0), laws.LawIndex(lexicon.SEED_LAWS)).count() == 0
    packs = spark.createDataFrame([("a", "control", "p1"), ("a", "control", "p2"), ("b", "verify", "p1"), ("c", "control", "p1")], "item_id string, kind string, pack string")
    assert sorted((r["item_id"], r["pack"]) for r in pack.control_pool(packs).collect()) == [("a", "p2"), ("c", "p1")]


def test_logs_end_to_end(spark, tmp_path):
    folder = tmp_path / "votes" / "b"
    folder.mkdir(parents=True)
    vote = lambda i, answer, **more: json.dumps({"vote_id": f"v{i}", "item_id": "x", "answer": answer, "voter": "a"} | more)
    (tmp_path / "votes" / "a.jsonl").write_text("\n".join([vote(1, "yes"), "{broken", "", vote(2, "no"), vote(1, "unsure")]))
    (folder / "c.jsonl").write_text("\n".join([vote(2, "unsure"), vote(3, "yes")]))
    log = tables.read_lines(spark, str(tmp_path / "votes"), tables.VOTE)
    assert log.count() == 5
    assert {r["vote_id"]: r["answer"] for r in survey.first_votes(log).collect()} == {"v1": "yes", "v2": "no", "v3": "yes"}
    assert {r["vote_id"]: r["answer"] for r in tables.last_by(log, "vote_id", "path", "line").collect()} == {"v1": "unsure", "v2": "unsure", "v3": "yes"}
    assert {tuple(r["b"]) for r in log.select(tables.batch_of(F.col("path")).alias("b")).collect()} == {("votes", "a"), ("b", "c")}
    tables.append_lines(spark.createDataFrame([("v9", "x", "yes")], "vote_id string, item_id string, answer string"), str(tmp_path / "log"))
    tables.append_lines(spark.createDataFrame([("v8", "x", "no")], "vote_id string, item_id string, answer string"), str(tmp_path / "log"))
    assert sorted(r["vote_id"] for r in tables.read_lines(spark, str(tmp_path / "log"), tables.VOTE).collect()) == ["v8", "v9"]
    one, two = (spark.createDataFrame(rows, "item_id string, kind string") for rows in ([("a", "verify")], [("b", "missed")]))
    assert sorted(r["item_id"] for r in tables.merged_packs(one, two).collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        tables.merged_packs(one, two, one)


def test_gold_is_written_and_read(spark, tmp_path):
    links = spark.createDataFrame([("d", 0, 1, 13, "5", None, None), ("d", 0, 0, 13, "4", None, None), ("e", 0, 0, 15, None, "1", None)], "id string, chain_ord int, link_ord int, law_id int, article string, point_article string, subpoint_article string")
    tables.write_gold(tables.gold_cases(links, ["id"]), str(tmp_path / "gold"))
    got = {r["id"]: r["links"] for r in spark.read.json(str(tmp_path / "gold")).collect()}
    assert [x["article"] for x in got["d"]] == ["4", "5"] and got["e"][0]["point_article"] == "1"
    raw = "".join(f.read_text("utf-8") for f in (tmp_path / "gold").glob("*.json"))
    assert '"subpoint_article":null' in raw


def test_gold_of_adjudicated_unanimous_and_conflicting_documents(spark):
    rows = [("a", 1, 13, "5"), ("b", 1, 13, "5"), ("a", 2, 13, "5"), ("b", 2, 15, "5"), ("a", 3, 13, "1"), ("b", 3, 13, "2"), ("adjudicator", 3, 13, "3")]
    saved = spark.createDataFrame(rows, "annotator string, doc_id int, law_id int, article string")
    links = saved.withColumn("point_article", F.lit(None).cast("string")).withColumn("subpoint_article", F.lit(None).cast("string"))
    got = sorted((r["doc_id"], r["article"], r["outcome"]) for r in annotation.gold(links, saved).collect())
    assert got == [(1, "5", "unanimous"), (3, "3", "adjudicated")]


def test_reports(spark):
    votes = spark.createDataFrame([], "vote_id string, voter string, item_id string, answer string, ms long, seq long")
    items = spark.createDataFrame([], "item_id string, kind string, expected string, n_links int, after string")
    assert "Precision: -" in tables.survey_report(survey.analyze(votes, items), survey.error_histogram(votes, items))


def test_next_items(spark):
    items = spark.createDataFrame([("a", "verify", 1), ("b", "verify", 2), ("c", "control", 1), ("d", "missed", 2)], "item_id string, kind string, version int")
    votes = lambda n, *more: spark.createDataFrame([("x", f"z{i}") for i in range(n)] + list(more) + [("y", "b")], "voter string, item_id string")
    ask = lambda v: survey.next_item(items, v, "x").first()["item_id"]
    assert ask(votes(0)) == "d" and ask(votes(7)) == "c" and ask(votes(1, ("x", "d"))) == "b"
    assert ask(votes(6, ("x", "c"))) == "d"  # no control is left
    assert survey.next_item(items, votes(0, *[("x", i) for i in "abcd"]), "x").count() == 0
    assert one(survey.place_of(votes(3), "y")) == [(2, "y", 1)] and one(survey.place_of(votes(3), "nobody")) == []


def test_streamed_windows(spark, tmp_path):
    folder = tmp_path / "votes"
    folder.mkdir()
    line = lambda i, minute: json.dumps({"vote_id": f"v{i}", "item_id": "x", "answer": "yes", "voter": "a", "time": f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z"})
    (folder / "a.json").write_text("\n".join([line(1, 1), line(2, 9), line(3, 12), line(1, 1)]))
    q = stream.windowed(stream.read_votes(spark, str(folder))).writeStream.format("memory").queryName("vote_windows").outputMode("append").start()
    q.processAllAvailable()
    (folder / "b.json").write_text(line(4, 200))
    q.processAllAvailable()
    q.stop()
    assert sorted((str(r["start"])[11:16], r["n"]) for r in spark.table("vote_windows").collect()) == [("00:00", 2), ("00:10", 1)]


def test_sentences_keep_their_digits_and_lose_their_spaces(spark):
    text = "12 ab cd. \n\t Ef gh 10\n 1 second 21 \n 2 third 2 . Fourth 33"
    rows = corpus.plain_sentences(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string"), "doc_id", "text").collect()
    assert [r["sentence"] for r in rows] == ["12 ab cd.", "Ef gh 10", "1 second 21", "2 third 2 .", "Fourth 33"]


def test_agreement_and_outcomes_by_brute_force(spark):
    """Odd rows: repeated links, links of a record that is not saved, records without links, an adjudicator, nulls."""
    saved = [("x", 1), ("y", 1), ("x", 2), ("y", 2), ("x", 2), ("z", 2), ("adjudicator", 2), ("x", 3), ("y", 3), ("z", 4), (None, 4)]
    rows = [("x", 1, 7, "1"), ("x", 1, 7, "1"), ("y", 1, 7, "1"), ("x", 2, 7, None), ("y", 2, 7, None), ("y", 2, 8, "2"), ("adjudicator", 2, 9, "9"), ("q", 1, 7, "1"), ("z", 1, 7, "1")]
    links = spark.createDataFrame([(*r, None, None) for r in rows], "annotator string, doc_id int, law_id int, article string, point_article string, subpoint_article string")
    records = spark.createDataFrame(saved, "annotator string, doc_id int")
    of = lambda who, doc: Counter(r[2:] for r in rows if r[:2] == (who, doc))
    wanted = set()
    for a, b in (("x", "y"), ("x", "z"), ("y", "z")):
        docs = {d for w, d in saved if w == a} & {d for w, d in saved if w == b}
        both = sum(sum((of(a, d) & of(b, d)).values()) for d in docs)
        every = sum(sum((of(a, d) + of(b, d)).values()) for d in docs)
        wanted |= {(a, b, 2 * both / every if every else 1.0, len(docs))} if docs else set()
    assert set(one(annotation.agreement(links, records))) == wanted
    assert set(one(annotation.outcomes(links, records))) == {(1, "conflict", 2), (2, "adjudicated", 4), (3, "unanimous", 2), (4, "unanimous", 2)}
    assert [(r["doc_id"], r["annotator"], r["law_id"], r["outcome"]) for r in annotation.gold(links, records).collect()] == [(2, "adjudicator", 9, "adjudicated")]
    assert not {"SortMergeJoin", "Window"} & set(re.findall(r"\w+", annotation.outcomes(links, records)._jdf.queryExecution().executedPlan().toString()))


def test_last_saves_by_seq_and_ties(spark):
    raw = spark.createDataFrame([("x", 1, 1, 5), ("x", 1, 2, 3), ("x", 1, 2, 4), ("y", 1, None, 1), ("y", 1, 0, None)], "annotator string, doc_id int, seq int, law_id int")
    assert set(one(annotation.last_saves(raw, ["law_id"]))) == {("x", 1, 2, 4), ("y", 1, 0, None)}
