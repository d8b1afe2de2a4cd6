import hashlib
import zlib

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import corpus_pipeline
from statuta.llm import entry, secret_scan
from tests.llm.test_near_dup import brute
from tests.llm.test_search_and_models import alnum_set, brute_base
from tests.oracle import check, connect


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, sf, name):
    check(entry.queries()[name](spark, sf), entry.oracle_sql()[name], connect(sf))


def test_ten_queries():
    assert [n for i in range(1, 11) for n in entry.queries() if n.startswith(f"op{i}_")] and len(entry.queries()) == 10


def table(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/{name}.parquet")


#: Contract columns that SQL can compute, by query.
PARTS = {
    "op7_prefix_dp_bpe": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
    "op9_ragged_token_counts": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents",
    "op10_avi_motion_jpeg": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes, CAST(greatest(1, (octet_length(encode(coalesce(text, ''))) + 63) // 64) * 64 AS BIGINT) AS payload_bytes FROM documents",
}


@pytest.mark.parametrize("name", sorted(PARTS))
def test_contract_columns_against_sql(spark, sf, name):
    duck = connect(sf)
    check(entry.queries()[name](spark, sf).select(*duck.sql(PARTS[name]).columns), PARTS[name], duck)


ODD = [(1, "abc token=abcdefghijklmnop"), (2, None), (3, ""), (4, "\u00bd \u2167 7"), (5, "deadbeefdeadbeefdeadbeef " * 900), (6, "une \u00e9tude <|endoftext|> \U0001f600"), (6, "une \u00e9tude"), (None, "no id")]


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("odd")
    rows = [(i, t, "fr" if t and "une" in t else "en", "s", None, "x") for i, t in ODD]
    table(spark, where, "documents", rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    table(spark, where, "labels", [(1, 1, 0), (2, 0, 0), (5, 0, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    return f"file://{where}"


def by_row(frame):
    rows = sorted((r.asDict() for r in frame.collect()), key=lambda r: str(r["doc_id"]))
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in ODD)
    return rows


def digest(data):
    return hashlib.sha256(data).hexdigest()


def test_op2_query(spark, odd_tables):
    texts = {i: t for i, t in ODD if i != 6}
    for r in by_row(entry.op2_markov_secrets(spark, odd_tables)):
        if r["doc_id"] in texts:
            base = brute_base(texts[r["doc_id"]])
            assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(k == x[2] for x in base) for k in ("assign", "access", "hex")]
            assert r["base_sha256"] == secret_scan.sha256_of(base)
            spans = [x.split(":") for x in r["spans"].split(",") if x]
            assert {(int(a), int(b), k) for k, a, b in spans} >= set(base) and [int(x[1]) for x in spans] == sorted(int(x[1]) for x in spans)


def test_op5_and_op8_queries(spark, odd_tables):
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    rows = by_row(entry.op5_ftrl_quality(spark, odd_tables))
    assert all(set(r) == {"doc_id", "held_out", "score", "predicted"} and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    langs = by_row(entry.op8_naive_bayes_langid(spark, odd_tables))
    assert all(set(r) == {"doc_id", "held_out", "lang_pred", "score"} and 0 <= r["score"] <= 1 for r in langs)
    assert {r["doc_id"] for r in langs if r["lang_pred"] == "und"} == {2, 3, 4}
    for r in rows + langs:
        assert r["held_out"] == (r["doc_id"] is not None and held(r["doc_id"]))


def test_op7_and_op9_queries(spark, odd_tables):
    library, pieces = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {i: t or "" for i, t in ODD if i != 6}
    for r in by_row(entry.op7_prefix_dp_bpe(spark, odd_tables)):
        if r["doc_id"] in texts:
            ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False)
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(",".join(map(str, ids)).encode()), digest(decoded.encode()))
    for r in by_row(entry.op9_ragged_token_counts(spark, odd_tables)):
        if r["doc_id"] in texts:
            n = len(pieces.encode(texts[r["doc_id"]]))
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 4096)


def test_null_page_id(spark, tmp_path):
    spark.createDataFrame([(1, "u", "x"), (None, "u", "x"), (None, None, None)], "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    rows = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in entry.op1_warc_normaliser(spark, str(tmp_path)).collect()), key=str)
    assert rows == sorted([(1, "response", None), (None, "revisit", 1), (None, "response", None)], key=str)


def test_pipeline_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    items = [alnum_set(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [r for r in rows if any(c.isalpha() for c in r["text"] or "")]
    kept = {i for i, _, _, k in brute([(r["doc_id"], r["text"]) for r in rows], 5, 80, 100) if k}
    rows = [r for r in rows if r["doc_id"] in kept]
    rows = [r for r in rows if not any(q and 100 * len(q & alnum_set(r["text"])) >= 80 * len(q) for q in items)]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == {r["doc_id"] for r in rows}
    for r in rows:
        masked = secret_scan.masked(r["text"], sorted(brute_base(r["text"]), key=secret_scan._order), "[SECRET]")
        if got[r["doc_id"]]["decoded"] != masked:  # the models may mask more, never less
            assert not brute_base(got[r["doc_id"]]["decoded"])
        assert got[r["doc_id"]]["ids"] == library.encode(got[r["doc_id"]]["decoded"], add_special_tokens=False).ids
    assert sum(got[r["doc_id"]]["decoded"] == secret_scan.masked(r["text"], sorted(brute_base(r["text"]), key=secret_scan._order), "[SECRET]") for r in rows) >= 0.95 * len(rows)


def test_stages_keep_columns_and_odd_rows(spark, odd_docs, no_docs, sf):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd_docs, sf).columns == odd_docs.columns, name
        assert stage(spark, no_docs, sf).count() == 0, name
