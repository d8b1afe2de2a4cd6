"""Registered queries opN_<name> of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import avi_clips, bpe, decontaminate, langid, near_dup, quality, secret_scan, token_count, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), words=3, threshold=(85, 100))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
c AS (SELECT list_sort(sh) AS sh, min(doc_id) AS id, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY list_sort(sh), len(sh)),
e AS (SELECT id, n, unnest(sh) AS g FROM c),
p AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.g = b.g AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
      GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(a, b) AS (SELECT id, id FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a, min(b) AS comp FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(k.comp, s.doc_id) AS component_id,
       coalesce(k.comp, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON c.sh = list_sort(s.sh) AND len(s.sh) > 0 LEFT JOIN k ON k.a = c.id
"""


def op1_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(_table(spark, sf_dir, "pages"))
    number = lambda c: F.expr(f"try_cast({c} as bigint)")  # noqa: E731  the record of a null page_id is named None
    return read.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


OP1_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS last FROM p),
d AS (SELECT *, list_aggregate(list_transform(range(0, 8), lambda i: (
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || hex[i * 5 + 1 : i * 5 + 5])::INT >> 15) & 31) + 1] ||
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || hex[i * 5 + 1 : i * 5 + 5])::INT >> 10) & 31) + 1] ||
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || hex[i * 5 + 1 : i * 5 + 5])::INT >> 5) & 31) + 1] ||
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(('0x' || hex[i * 5 + 1 : i * 5 + 5])::INT & 31) + 1])), 'string_agg', '') AS digest FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""


def op2_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    ratio = secret_scan.learn(docs)
    return secret_scan.digest(secret_scan.scan(docs, ratio))


def op4_containment_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH t AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-zA-Z\x{80}-\x{10FFFF}]+') AS ws FROM t),
s AS (
  SELECT kind, id, row_number() OVER () AS r, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i:
      ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4])) END AS sh FROM w),
d AS (SELECT id, r, unnest(sh) AS g FROM s WHERE kind = 0),
q AS (SELECT id, r, len(sh) AS n, unnest(sh) AS g FROM s WHERE kind = 1)
SELECT q.id AS item_id, d.id AS doc_id, CAST(q.n AS BIGINT) AS n_item_shingles, count(*) AS n_common
FROM q JOIN d ON q.g = d.g GROUP BY q.id, q.r, d.id, d.r, q.n HAVING 100 * count(*) >= 80 * q.n
"""


def op5_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    weights = quality.fit(docs, labels.where(~langid.held_out("doc_id")))
    scored = quality.score(docs, weights)
    return scored.select("doc_id", langid.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_redirect_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


OP6_SQL = r"""
WITH RECURSIVE p AS (SELECT page_id, url, coalesce(html, '') AS html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
u AS (SELECT page_id, url, html, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
        translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS node FROM p),
t AS (SELECT url, node, unnest([
        regexp_extract(regexp_extract(html, '<link\s[^>]*rel\s*=\s*["'']?canonical["''\s/>][^>]*>?', 0, 'is'), '\shref\s*=\s*["'']?([^"''\s>]+)', 1, 'is'),
        regexp_extract(regexp_extract(html, '<meta\s[^>]*http-equiv\s*=\s*["'']?refresh["''\s/>][^>]*>?', 0, 'is'), 'url\s*=\s*["'']?([^"''\s>;]+)', 1, 'is')]) AS goal
      FROM u WHERE node IS NOT NULL),
a AS (SELECT node, CASE WHEN contains(goal, '://') THEN goal WHEN starts_with(goal, '//') THEN 'x:' || goal
        WHEN starts_with(goal, '/') THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1) || goal
        ELSE rtrim(regexp_extract(url, '^(.*?://[^/?#]*(?:/[^?#]*/|/)?)', 1), '/') || '/' || goal END AS goal FROM t WHERE goal <> ''),
b AS (SELECT node AS x, translate(regexp_extract(substr(goal, strpos(goal, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
        || regexp_extract(substr(goal, strpos(goal, '://') + 3), '^[^/?#]*([^#]*)', 1) AS y FROM a),
e AS (SELECT x, y FROM b UNION SELECT y, x FROM b),
c(x, y) AS (SELECT x, x FROM e UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x),
n AS (SELECT node AS n, regexp_extract(node, '^([^/?#]*)', 1) AS host, regexp_extract(node, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT DISTINCT x AS node FROM c)),
r(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
nv AS (SELECT n, arg_max(verdict, length(h || p)) AS v FROM n JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n),
cv AS (SELECT c.x AS node, min(nv.v) AS v FROM c JOIN nv ON c.y = nv.n GROUP BY c.x),
f AS (SELECT u.page_id, arg_max(r.verdict, length(h || p)) AS v, arg_max(h || p, length(h || p)) AS rule
      FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY u.page_id)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.v, cv.v, 'allow') AS verdict
FROM u LEFT JOIN f USING (page_id) LEFT JOIN cv ON f.v IS NULL AND u.node = cv.node
"""


def op7_prefix_dp_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_naive_bayes_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out("doc_id")))
    return langid.identify(docs, model).select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op9_ragged_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_count.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op10_avi_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = avi_clips.to_media(_table(spark, sf_dir, "documents"))
    return avi_clips.read_back(media, keep=("n_bytes",)).select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_normaliser": OP1_SQL,
        "op3_minhash_near_dedup": OP3_SQL,
        "op4_containment_decontamination": OP4_SQL,
        "op6_redirect_url_filter": OP6_SQL,
    }
