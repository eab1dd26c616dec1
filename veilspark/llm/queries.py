"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language_id, merkle_manifest, order_minhash, piece_codec, prefix_trie, quality_rules, secret_scan, simhash, substring_dedup, token_store, url_filter, warc_store
from .common import read_table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digest(read_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(read_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(read_table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.thin_pages(pages))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_store.archive_digest(read_table(spark, sf_dir, "pages"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_digest(read_table(spark, sf_dir, "documents"))


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.codec_digest(read_table(spark, sf_dir, "documents"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_digest(read_table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest_digest(read_table(spark, sf_dir, "documents"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_secret_scan,
        op3_language_id,
        op4_decontaminate,
        op5_quality_rules,
        op6_url_filter,
        op7_warc,
        op8_token_store,
        op9_piece_codec,
        op10_order_minhash,
        op11_prefix_trie,
        op12_merkle_manifest,
        op13_simhash,
    )
}

#: crc32 of the decimal text of {0}: eight steps a digit over the reflected polynomial.
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda acc, b: list_reduce(list_concat([xor(acc, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)))"""


def _leaf(text: str) -> str:
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({f}) AS VARCHAR) || ':' || {f}, '-')" for f in fields) + ")"


def _walk(name: str, start: str, siblings: str) -> str:
    """Recursive steps of every leaf to the root of a tree, adding up its proof."""
    return f"""{name}(r, k, lv, i, proof, now) AS ({start} UNION ALL
      SELECT r, w.k, w.lv + 1, w.i // 8, proof || l || g, sha256(l || now || g) FROM {name} w JOIN {siblings} s ON s.k = w.k AND s.lv = w.lv AND s.i = w.i)"""


def _tree(name: str, start: str) -> str:
    """Recursive levels of trees, eight nodes a parent, and each node's siblings on either side."""
    run = "OVER (PARTITION BY k, lv, i // 8 ORDER BY i ROWS BETWEEN"
    return f"""{name}(k, lv, i, n, node) AS ({start} UNION ALL
      SELECT k, lv + 1, i // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY k, lv, n, i // 8),
{name}_sides AS (SELECT k, lv, i, coalesce(string_agg(node, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
      coalesce(string_agg(node, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS g FROM {name} WHERE n > 1)"""


ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
firsts AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
hit AS (SELECT win.doc_id, i FROM win JOIN firsts ON win.k = firsts.k AND m < win.doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hit, range(0, 13) AS r(j)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS t, count(*) AS n
         FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op4_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(len(w), 10) AS z FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, z, array_to_string(list_slice(w, i, i + z - 1), ' ') AS k
       FROM (SELECT item_id, w, z, unnest(range(1, len(w) - z + 2)) AS i FROM bs)),
dz AS (SELECT doc_id, w, z FROM d, (SELECT DISTINCT z FROM bw)),
dw AS (SELECT doc_id, z, i, array_to_string(list_slice(w, i, i + z - 1), ' ') AS k
       FROM (SELECT doc_id, w, z, unnest(range(1, len(w) - z + 2)) AS i FROM dz)),
hit AS (SELECT dw.doc_id, dw.i, dw.z, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.z = bw.z),
own AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hit GROUP BY doc_id),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + z)) AS p FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN own ON d.doc_id = own.doc_id LEFT JOIN pos ON d.doc_id = pos.doc_id""",
    "op6_url_filter": r"""
WITH r AS (SELECT page_id, html, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, html, rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw FROM r),
t AS (SELECT page_id, html, rest, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(coalesce(rest, ''), length(raw) + 1) AS tail FROM h),
p AS (SELECT page_id, html, rest, host, regexp_extract(tail, '^[^?#]*') AS path,
             regexp_replace(regexp_replace(regexp_extract(tail, '^[^?#]*\?([^#]*)', 1), '(^|&)utm_[^&]*', '', 'g'), '^&', '') AS q FROM t),
c AS (SELECT page_id, html, host, path, CASE WHEN rest IS NOT NULL THEN
             regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical FROM p),
listed AS (SELECT DISTINCT canonical FROM c WHERE canonical IS NOT NULL AND coalesce(strlen(html), 0) < 1000),
ruled AS (SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict FROM ruled""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
m AS (SELECT page_id, body, CAST(strlen(body) AS BIGINT) AS n, max(page_id) OVER (PARTITION BY body) AS keeper FROM p)
SELECT page_id, n AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> keeper THEN keeper END AS refers_to FROM m""",
    "op11_prefix_trie": f"""
WITH t AS (SELECT conv_id, turn, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS e, length(coalesce(text, '')) AS n
           FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, e, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, e) AS pos FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC32.format("conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, h, (SELECT count(*) FROM p WHERE p.conv_id = c.base AND pos <= h) AS taken FROM c),
r AS (SELECT c.conv_id, pos AS d, e, n FROM c JOIN p ON p.conv_id = c.base AND pos <= h
      UNION ALL SELECT b.conv_id, pos - h + taken, e, n FROM b JOIN p ON p.conv_id = b.conv_id AND pos > h),
pre AS (SELECT conv_id, d, n, string_agg(e, '') OVER (PARTITION BY conv_id ORDER BY d) AS k FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c),
lens AS (SELECT conv_id, max(d) AS len FROM pre GROUP BY conv_id),
node AS (SELECT d, k, min(pre.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS saved, left(k, CAST(64 * (d - 1) AS BIGINT)) AS up,
                string_agg(CASE WHEN d = len THEN CAST(pre.conv_id AS VARCHAR) END, ',' ORDER BY pre.conv_id) AS ends
         FROM pre JOIN lens ON pre.conv_id = lens.conv_id GROUP BY d, k),
kid AS (SELECT up, count(*) AS m FROM node WHERE d > 0 GROUP BY up),
full_node AS (SELECT node.*, coalesce(m, 0) AS n_children FROM node LEFT JOIN kid ON kid.up = node.k),
below AS (SELECT a.k, sum(x.saved) AS saved_tokens, count(*) FILTER (x.n_children = 0) AS n_leaves FROM full_node a JOIN full_node x ON starts_with(x.k, a.k) GROUP BY a.k)
SELECT CAST(a.conv_id AS BIGINT) AS conv_id, CAST(a.d AS BIGINT) AS depth, CAST(q.conv_id AS BIGINT) AS parent_conv_id, CAST(a.n_convs AS BIGINT) AS n_convs,
       CAST(a.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
FROM full_node a JOIN below ON below.k = a.k LEFT JOIN node q ON a.d > 0 AND q.k = a.up""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS k, {_leaf("text")} AS leaf, {_CRC32.format("coalesce(doc_id, 1)")} % 3 AS c,
                  {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS low FROM documents),
x AS (SELECT doc_id, k, leaf, CASE WHEN c = 0 AND doc_id IS NOT NULL THEN low ELSE leaf END AS now, row_number() OVER (ORDER BY k, doc_id NULLS FIRST, leaf) AS r,
             row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM d),
{_tree("up", "SELECT k, CAST(0 AS BIGINT), i, n, leaf FROM x")},
subs AS (SELECT k, node, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
{_tree("top", "SELECT '', CAST(0 AS BIGINT), i, n, node FROM subs")},
{_walk("own", "SELECT r, k, CAST(0 AS BIGINT), i, '', now FROM x", "up_sides")},
own_end AS (SELECT r, k, arg_max(proof, lv) AS proof, arg_max(now, lv) AS now FROM own GROUP BY r, k),
{_walk("over_all", "SELECT r, '', CAST(0 AS BIGINT), subs.i, proof, now FROM own_end JOIN subs ON subs.k = own_end.k", "top_sides")},
done AS (SELECT r, arg_max(proof, lv) AS proof, arg_max(now, lv) AS now FROM over_all GROUP BY r)
SELECT doc_id, leaf, subs.node AS subroot, top.node AS root, sha256(proof) AS proof_sha256, done.now AS folded_root, done.now = top.node AS verified
FROM x JOIN subs ON subs.k = x.k JOIN done ON done.r = x.r JOIN top ON top.n = 1""",
}
