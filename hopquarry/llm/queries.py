"""The subpackage's queries, each over its whole intended table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe,
    embedding_dedup,
    html_extract,
    importance,
    jaccard_join,
    license_scan,
    packing,
    substring_dedup,
    token_alignment,
    toxicity,
    url_filter,
    warc,
    winnowing,
)
from .support import table


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprint_documents(table(spark, sf_dir, "documents"))


#: (action, host, path)
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


OP1_SQL = """
WITH parsed AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(action, rule_host, rule_path) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fits AS (
  SELECT host, path, rule_host || rule_path AS rule, action,
         row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
  FROM (SELECT DISTINCT host, path FROM parsed) JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM parsed p LEFT JOIN fits f ON f.host = p.host AND f.path = p.path AND f.place = 1
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.archive_and_reassemble(spark, table(spark, sf_dir, "pages"))
    return captures.select(
        "metadata.page_id",
        "response.payload_bytes",
        "response.payload_digest",
        "response.record_type",
        F.col("metadata.refers_to").cast("long").alias("refers_to"),
    )


OP3_SQL = """
WITH payloads AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), marked AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS keeper
  FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM marked
"""


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH table_256 AS (
  SELECT list(entry ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(0, 8), lambda c, step: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS entry
    FROM range(0, 256) AS r(i))
), texts AS (
  SELECT text, any_value(k) AS k, sum(n_docs) AS n_docs, sum(n_target) AS n_target, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM (SELECT text, 1 AS n_docs, 0 AS n_target, 0 AS k FROM documents UNION ALL SELECT text, 0, 1, 0 FROM benchmark) GROUP BY text
), features AS (
  SELECT text, n_docs, n_target, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature
  FROM texts
), counted AS (
  SELECT text, feature, n_docs, n_target, count(*) AS times FROM features GROUP BY ALL
), hashed AS (
  SELECT feature, xor(list_reduce(
    list_transform(range(1, len(hex(encode(feature))), 2), lambda i: ('0x' || substr(hex(encode(feature)), i, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM counted), table_256
), bucketed AS (
  SELECT text, bucket, times, times * n_docs AS in_docs, times * n_target AS in_target FROM counted JOIN hashed USING (feature)
), sizes AS (
  SELECT bucket, sum(in_docs) AS s, sum(in_target) AS t, sum(sum(in_docs)) OVER () AS s_all, sum(sum(in_target)) OVER () AS t_all
  FROM bucketed GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM sizes
), weights AS (
  SELECT text, sum(times)::BIGINT AS n_features, floor(sum(times * gain)::DOUBLE / sum(times)::DOUBLE)::BIGINT AS weight
  FROM bucketed JOIN gains USING (bucket) GROUP BY text
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN weights USING (text)
), ranked AS (
  -- of n words come 2 n - 1 features: twenty words or more are 39 features or more
  SELECT *, row_number() OVER (PARTITION BY n_features >= 39 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 39) OVER () * 25 // 100 AS drawn
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 39 AND place <= drawn THEN place END AS rank FROM ranked
"""


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.align_documents(table(spark, sf_dir, "documents"), a, b)


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_toxicity": op2_toxicity,
    "op3_warc": op3_warc,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_fingerprints": op9_fingerprints,
    "op10_html_extraction": op10_html_extraction,
    "op11_license_scan": op11_license_scan,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE_SQL = {"op1_url_filters": OP1_SQL, "op3_warc": OP3_SQL, "op12_importance_resampling": OP12_SQL}
