import re
import subprocess
import sys
from collections import Counter

import pytest

from statuta import queries
from statuta.plans import extract as plan
from tests.conftest import TOP
from tests.oracle import check, connect


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, sf, duck, name):
    check(queries.QUERIES[name](spark, sf), queries.SQL[name], duck)


def test_noise_keeps_clean_scores(spark, sf):
    rows = {r["family"]: r for r in queries.noise_robustness(spark, sf).collect()}
    assert rows["clean"]["f1"] == 1.0
    assert min(r["f1"] for r in rows.values()) > 0.9


def test_chains_have_spans_inside_texts(spark, sf):
    rows = queries.chains_of_texts(spark, sf).collect()
    assert rows and all(r["start"] < r["end"] for r in rows)


def test_line_windows_are_whole_lines(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.line_windows(spark, sf).collect():
        assert r["window"] == "\n".join(docs[r["doc_id"]].split("\n")[r["first_line"] : r["end_line"]])


def test_no_query_is_empty(spark, sf):
    """An oracle of no rows would prove nothing."""
    for name in ("extract_from_documents", "survey_pack", "audit_stem_conflicts", "audit_generic_names", "audit_search", "annotation_gold", "shortest_names", "all_fragment_spans", "survey_next_item", "survey_own_place", "page_links", "plain_sentences"):
        assert queries.QUERIES[name](spark, sf).count() > 0, name


def test_long_texts_are_those_of_the_kernel(spark, sf):
    from statuta.functions import citegen, laws, lexicon, synthetic, tagging

    rows = sorted((r["doc_id"], r["text"]) for r in citegen.citations(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderkey").collect())
    whole = {}
    for k, t in rows:
        whole.setdefault(k // 30, []).append(t)
    index, tagger, wanted = laws.LawIndex(lexicon.extend(lexicon.SEED_LAWS)), synthetic.default_tagger(), Counter()
    for g, texts in whole.items():
        folded = tagging.fold("\n".join(texts))
        chains = tagging.find_chains(tagger, [folded])[0]
        for c, m in zip(chains, index.mentions(folded, chains), strict=True):
            if m:
                wanted[g, m.law] += max(1, len(c.articles)) * max(1, len(c.points)) * max(1, len(c.subpoints))
    assert {(r["doc_id"], r["law_id"]): r["n_links"] for r in queries.extract_long_texts(spark, sf).collect()} == wanted


def test_ablations_lose_what_they_leave_out(spark, sf):
    rows = {r["variant"]: r for r in queries.ablations(spark, sf).collect()}
    assert rows["full"]["f1"] == 1.0 and rows["no anaphora"]["fn"] > 0 and all(r["tp"] + r["fn"] == rows["full"]["tp"] for r in rows.values())


def test_role_counts_are_those_of_the_generator(spark, sf):
    from statuta.functions import synthetic

    wanted = Counter()
    for block in range(16):
        for _, roles in synthetic.texts(50, seed=block):
            wanted.update(zip(["^", "^", *roles], ["^", *roles], roles, strict=False))
    assert {(r["before2"], r["before1"], r["tag"]): r["n"] for r in queries.synthetic_role_counts(spark, sf).collect()} == wanted


def test_windows_by_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.context_fragments(spark, sf).collect():
        t = docs[r["doc_id"]]
        a, b = min(50, len(t)), min(70, len(t))
        lo, hi = max(0, a - 40), min(len(t), b + 40)
        while lo > 0 and not t[lo].isspace() and not t[lo - 1].isspace() and lo < a:
            lo -= 1
        while hi < len(t) and not t[hi].isspace() and not t[hi - 1].isspace() and hi > b:
            hi += 1
        assert r["fragment"] == t[a:b]
        assert r["before"].removeprefix("… ").strip() == t[lo:a].strip() and r["before"].startswith("… ") == (lo > 0)
        assert r["after"].removesuffix(" …").strip() == t[b:hi].strip() and r["after"].endswith(" …") == (hi < len(t))


def test_frames_of_links_start_no_job(spark, sf):
    """Nothing runs while the plan is built."""
    docs = spark.createDataFrame([(1, "ст. 5 УК РФ")], "doc_id long, text string")
    spark.sparkContext.setJobGroup("build", "building a frame")
    plan.extract(docs)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("build")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_entry_without_a_dependency_of_the_corpus_operators():
    code = "import sys; sys.modules['ahocorasick'] = None\nimport __spark_entry__ as e\nq, s = e.queries(), e.oracle_sql()\nassert 'extract_links' in q and 'extract_links' in s and not any(n.startswith('op') for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=TOP)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_keys_of_texts_are_dealt_over_all_cores(spark, sf):
    """A small file is one split, and was one task of all texts."""
    assert queries._orders_text(spark, sf).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    keys = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey")
    assert queries._dealt(keys, "o_orderkey", 10).rdd.getNumPartitions() > 4 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["evaluate_extraction", "extract_links", "extract_with_many_names", "links_in_text_order"])
def test_the_kernel_gets_texts_of_dealt_keys(spark, sf, name):
    """Its tasks were the splits of the scan, however many keys a split held."""
    below = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[1]
    dealt = re.search(r"Exchange hashpartitioning\(o_orderkey#\d+L, (\d+)\), REPARTITION_BY_NUM", below)
    assert dealt and int(dealt[1]) >= 4 * spark.sparkContext.defaultParallelism
