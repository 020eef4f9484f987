"""The queries of the corpus operators and the SQL that states their results where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import nearest
from .decontaminate import contaminations
from .license_scan import license_scan
from .mixing import mix_report
from .near_dup import near_duplicates
from .quality import graded, trained
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .tables import table
from .token_counts import token_counts
from .url_filter import url_verdicts


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return url_verdicts(table(spark, sf_dir, "pages"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle count, near-duplicate component and whether it stays."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes and tokens, and whether it is over 512 tokens."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license labels; its detections are left to the operator."""
    return license_scan(table(spark, sf_dir, "documents")).drop("detections")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, expected grade, probability of the highest grade and whether it stays."""
    docs = table(spark, sf_dir, "documents")
    return graded(docs, trained(docs, table(spark, sf_dir, "labels")))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items of which they hold three quarters of the shingles."""
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, how many go, and a digest of those kept."""
    return substring_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("kept", "kept_sha256")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes, how many go in how many runs, and a digest of those kept."""
    return suffix_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("kept", "kept_sha256")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's size and target, and the words the mix takes of it."""
    return mix_report(table(spark, sf_dir, "documents"))


def op10_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return SQL


_COMPONENTS = """
reach(id, component) AS (
  SELECT doc_id, doc_id FROM sized UNION SELECT l.y, r.component FROM reach r JOIN links l ON l.x = r.id)
"""

SQL = {
    "op1_url_filters": r"""
WITH RECURSIVE rules(verdict, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE contains(url, '://')),
targets AS (
  SELECT url, CASE WHEN regexp_matches(tag, '(?is)^<link\b') AND regexp_matches(tag, '(?is)\brel\s*=\s*["'']?canonical["''\s/>]')
    THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''>\s]+)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta\b') THEN regexp_extract(tag, '(?is)http-equiv\s*=\s*["'']?refresh["''\s][^>]*?url\s*=\s*["'']?([^"''>\s]+)', 1) END AS t FROM tags),
full_targets AS (
  SELECT url, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || t
    WHEN starts_with(t, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || t END AS t FROM targets WHERE t <> ''),
urls AS (SELECT DISTINCT url AS u FROM pages WHERE contains(url, '://') UNION SELECT t FROM full_targets WHERE t IS NOT NULL),
named AS (
  SELECT u, translate(regexp_extract(u, '(?s)^(.*?://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS head,
    split_part(u, '#', 1) AS whole FROM urls),
nodes AS (SELECT u, head || substr(whole, length(head) + 1) AS node FROM named),
edges AS (
  SELECT DISTINCT a.node AS a, b.node AS b FROM full_targets f JOIN nodes a ON a.u = f.url JOIN nodes b ON b.u = f.t WHERE a.node <> b.node),
links AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(id, other) AS (SELECT DISTINCT node, node FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
parts AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
fits AS (
  SELECT DISTINCT s.host, s.path, h || p AS rule, verdict, length(h || p) AS n
  FROM (SELECT host, path FROM parts UNION SELECT regexp_extract(node, '(?s)^.*?://([^/?#]*)', 1), regexp_extract(node, '(?s)^.*?://[^/?#]*([^?#]*)', 1) FROM nodes) s
  JOIN rules ON (s.host = h OR ends_with(s.host, '.' || h)) AND starts_with(s.path, p)),
best AS (SELECT host, path, arg_max(rule, n) AS rule, arg_max(verdict, n) AS verdict FROM fits GROUP BY ALL),
spread AS (
  SELECT id, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' WHEN bool_or(verdict = 'block') THEN 'block' END AS v
  FROM reach JOIN best ON host = regexp_extract(other, '(?s)^.*?://([^/?#]*)', 1) AND path = regexp_extract(other, '(?s)^.*?://[^/?#]*([^?#]*)', 1) GROUP BY id)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, v, 'allow') AS verdict
FROM parts p LEFT JOIN best USING (host, path) LEFT JOIN nodes ON u = url LEFT JOIN spread ON id = node
""",
    "op2_minhash_near_dedup": r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM split),
counts AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
sized AS (SELECT d.doc_id, coalesce(n, 0) AS n FROM documents d LEFT JOIN counts USING (doc_id)),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN counts p ON p.doc_id = x JOIN counts q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
""" + _COMPONENTS + """
SELECT s.doc_id, any_value(n) AS n_shingles, min(component) AS component_id, s.doc_id = min(component) AS kept
FROM sized s JOIN reach ON id = s.doc_id GROUP BY s.doc_id
""",
    "op6_benchmark_decontamination": r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
split AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM texts),
sets AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM split),
sizes AS (SELECT id, count(*) AS n FROM sets WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, n AS n_item, count(*) AS n_shared, count(*)::double / n AS containment
FROM sets d JOIN sets i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' JOIN sizes z ON z.id = i.id
GROUP BY d.id, i.id, n HAVING 100 * count(*) >= 75 * n
""",
    "op7_substring_dedup": r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS h
  FROM split WHERE len(w) >= 50),
least AS (SELECT h, min(doc_id) AS m FROM windows GROUP BY h),
hits AS (SELECT DISTINCT doc_id, i FROM windows JOIN least USING (h) WHERE doc_id > m),
places AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM split),
judged AS (
  SELECT p.doc_id, p.p, word, (SELECT count(*) > 0 FROM hits h WHERE h.doc_id = p.doc_id AND h.i BETWEEN p.p - 49 AND p.p) AS gone FROM places p)
SELECT s.doc_id, len(any_value(w))::bigint AS n_words, count(*) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM split s LEFT JOIN judged USING (doc_id) GROUP BY s.doc_id
""",
    "op9_mixing": r"""
WITH held AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size FROM documents),
classed AS (
  SELECT *, CASE WHEN size < 16 THEN size ELSE length(bin(size)) * 16 + (size >> (length(bin(size)) - 4)) END AS class FROM held),
salted AS (
  SELECT *, ('0x' || substr(md5(coalesce(doc_id::varchar, text, '')), 1, 8))::bigint % (count(*) OVER (PARTITION BY source, class) // 500 + 1) AS salt FROM classed),
sizes AS (
  SELECT source, sum(size)::double AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM held GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][((place - 1) % 3 + 1)::int]::double AS weight, source_size * 2 AS cap FROM sizes),
filled AS (
  SELECT *, (sum(source_size) OVER () * 1.5::double - coalesce(sum(cap) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS share
  FROM weighed WINDOW f AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, place, source_size, coalesce(least(cap, weight * (
    SELECT arg_min(g.share, (g.cap / g.weight, g.place)) FROM filled g WHERE g.share < g.cap / g.weight)), cap) AS target FROM filled),
numbered AS (
  SELECT c.doc_id, c.size, t.source_size, t.target, ('0x' || substr(md5('0:' || t.place), 1, 8))::bigint / 4294967296::double AS u,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS e,
    (row_number() OVER (PARTITION BY c.source ORDER BY class, salt, size, doc_id))::double AS r
  FROM salted c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::bigint AS source_size, target, (floor(u + e * r) - floor(u + e * (r - 1)))::bigint * size AS taken
FROM numbered
""",
}
