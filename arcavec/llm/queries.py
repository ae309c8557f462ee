"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcavec.llm import bpe, decontaminate, language_id, license_scan, ngram_join, pivot_dedup, quality, suffix_dedup, toxicity, warc

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(path: str | None = None) -> dict[bytes, int]:
    """The ranks of the vocabulary file, by default that of the installed public tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return bpe.load_ranks(path)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.find_licenses(_table(spark, sf_dir, "documents"))


def op3_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, which know strings of 400 bytes only, and how much of each text stands in runs of over 50 words that other documents hold."""
    found = suffix_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), words=51, cut_words=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(), keep_ids=False)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.predict(docs.select("doc_id", "text"), model).drop("text")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out())
    model = language_id.fit(docs.where("not held_out and doc_id is not null"))
    return language_id.identify(docs.select("doc_id", "text", "held_out"), model)


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.records_of_pages(_table(spark, sf_dir, "pages")))
    return found.withColumn("headers", F.array_join("headers", "; "))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.predict(docs.select("doc_id", "text"), model).drop("text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = globals()
    return {name: own[name] for name in sorted(own, key=lambda n: int(n[2:].split("_")[0]) if n.startswith("op") and n[2:3].isdigit() else 99) if name.startswith("op") and name[2:3].isdigit()}


#: DuckDB SQL of the queries that it can express.
ORACLE = {
    "op6_ngram_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 2), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, both_ways.y FROM reach JOIN both_ways ON reach.r = both_ways.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)""",
    "op1_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, p, p + least(len(w), 13) - 1), ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
g AS (
  SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
m AS (SELECT doc_id, n, p, item FROM g JOIN win USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op3_pivot_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, links.y FROM reach JOIN links ON reach.r = links.x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) n ON n.x = e.vec_id
JOIN (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id) c ON c.vec_id = e.vec_id""",
    "op9_warc_revisits": r"""
WITH p AS (
  SELECT page_id AS p, url, '"' || md5(coalesce(html, '')) || '"' AS tag, sha256(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS VARCHAR) AS size FROM pages),
r AS (
  SELECT 2 * p AS id, url, p * 10 AS ts, tag, 'day ' || CAST(p % 97 AS VARCHAR) AS lm, size, digest FROM p),
q AS (
  SELECT 2 * p + 1 AS id, p * 10 + 5 + (p % 5) * 1000 AS ts,
    CASE WHEN p % 3 = 0 THEN regexp_replace(url, '^https?://', 'HTTP://') || CASE WHEN contains(url, '#') THEN '' ELSE '#top' END ELSE url END AS url,
    CASE WHEN p % 7 = 0 THEN NULL WHEN p % 7 = 1 THEN '"other"' ELSE tag END AS tag,
    CASE WHEN p % 14 = 0 THEN 'day ' || CAST(p % 97 AS VARCHAR) WHEN p % 7 = 0 THEN 'day x' END AS lm FROM p),
both_kinds AS (SELECT 'r' AS kind, id, url FROM r UNION ALL SELECT 'q', id, url FROM q),
parts AS (
  SELECT kind, id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&') AS query FROM both_kinds),
c AS (SELECT kind, id, CASE WHEN host <> '' THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS u FROM parts),
m AS (
  SELECT q.id, cq.u, q.ts AS q_ts, q.tag AS q_tag, q.lm AS q_lm, r.*  EXCLUDE (url)
  FROM q JOIN c cq ON cq.kind = 'q' AND cq.id = q.id LEFT JOIN (r JOIN (SELECT id AS cid, u AS ru FROM c WHERE kind = 'r') cr ON cr.cid = r.id) ON ru = cq.u AND (r.ts < q.ts OR (r.ts = q.ts AND r.id < q.id))
  QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY r.ts DESC NULLS LAST, r.id DESC NULLS LAST) = 1),
o AS (
  SELECT m.id AS record_id, u AS canonical_url, m.id_1 AS rid, q_ts, ts, size, digest,
    CASE WHEN u IS NULL THEN 'no url' WHEN m.id_1 IS NULL THEN 'no earlier response' WHEN q_tag IS NOT NULL AND q_tag IS DISTINCT FROM tag THEN 'validator differs'
      WHEN q_tag IS NULL AND q_lm IS NOT NULL AND q_lm IS DISTINCT FROM lm THEN 'validator differs' ELSE 'resolved' END AS outcome FROM m)
SELECT record_id, canonical_url, CASE WHEN outcome = 'resolved' THEN rid END AS response_id, outcome,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=60; content-length: ' || size || '; content-type: text/html; date: ' || CAST(q_ts AS VARCHAR) || '; server: second' END AS headers,
  CASE WHEN outcome = 'resolved' THEN digest END AS payload_digest
FROM o""",
}
