"""The corpus operators as registered queries, and the SQL for those SQL can state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import (
    cover_tree,
    decontamination,
    language_id,
    licenses,
    line_dedup,
    merkle,
    mixing,
    near_dedup,
    oracle_sql,
    prefix_trie,
    revisits,
    scoring,
    token_counts,
    topk,
)
from ledgerline.llm.common import shared_folder, ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def _near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def _token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # A new cache each time, so that a run does not depend on earlier ones. It is
    # filled by one half of the documents and met by the other.
    cache = f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}"
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    docs = _table(spark, sf_dir, "documents")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    first, second = (token_counts.count_cached(docs.where(half == k), cache, vocabulary) for k in (0, 1))
    return first.union(second)


def _scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(_table(spark, sf_dir, "documents"))


def _decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )


def _revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = revisits.resolve(revisits.crawl_log(_table(spark, sf_dir, "pages")))
    return resolved.withColumn("payload", F.md5("payload"))


def _topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def _licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def _line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents"), **line_dedup.WHOLE)


def _language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_languages(_table(spark, sf_dir, "documents"))


def _cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_vectors(_table(spark, sf_dir, "embeddings"))


def _merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(merkle.manifest(_table(spark, sf_dir, "documents")))


def _prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_pareto_mixing": _mixing,
    "op2_bbit_minhash": _near_dedup,
    "op3_token_cache": _token_counts,
    "op4_backoff_automaton": _scoring,
    "op5_wu_manber": _decontamination,
    "op6_revisits": _revisits,
    "op7_branch_and_bound": _topk,
    "op8_license_scan": _licenses,
    "op9_pattern_tree": _line_dedup,
    "op10_nearest_centroid": _language_id,
    "op11_cover_tree": _cover_tree,
    "op12_merkle_manifest": _merkle,
    "op13_prefix_trie": _prefix_trie,
}

ORACLE_SQL = {
    "op2_bbit_minhash": oracle_sql.NEAR_DEDUP,
    "op5_wu_manber": oracle_sql.DECONTAMINATION,
    "op7_branch_and_bound": oracle_sql.TOP_K,
    "op11_cover_tree": oracle_sql.NEAR_VECTORS,
    "op12_merkle_manifest": oracle_sql.MERKLE,
    "op13_prefix_trie": oracle_sql.PREFIX_TRIE,
    "op6_revisits": """
        WITH page AS (
            SELECT CAST(page_id AS BIGINT) AS page,
                   CASE WHEN page_id % 4 = 1 THEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')
                        ELSE url END AS url,
                   CASE WHEN page_id % 7 <> 3 THEN '"' || md5(html) || '"' END AS tag,
                   CASE WHEN page_id % 2 = 0 THEN 'day ' || CAST(page_id // 40 AS VARCHAR) END AS modified,
                   md5(html) AS body, CAST(strlen(html) AS VARCHAR) AS size
            FROM pages
        ),
        record AS (
            SELECT 4 * page AS record_id, url, 4 * page AS captured, true AS is_full, body, tag, modified, size
            FROM page
            UNION ALL
            SELECT 4 * page + 2, url || '#seen', 4 * page + 2, false, NULL,
                   'W/' || CASE WHEN tag IS NOT NULL AND page % 3 = 0 THEN '"stale"' ELSE tag END, modified, NULL
            FROM page
            UNION ALL
            SELECT 4 * page + 1, url, 4 * page - 999, false, NULL,
                   CASE WHEN page % 2 = 1 THEN tag END, modified, NULL
            FROM page WHERE page % 5 = 0
        ),
        part AS (
            SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
            FROM record
        ),
        named AS (
            SELECT *,
                   regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), ':(80|443)$', '')
                   || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '')
                   || regexp_replace(regexp_replace(regexp_replace(
                          regexp_extract(bare, '\\?.*$'), '[?&]utm_[^&]*', '&', 'g'),
                          '^[?&]+', '?'), '[?&]+$', '') AS canonical_url
            FROM part
        ),
        met AS (
            SELECT n.*, f.record_id AS found_id, f.tag AS found_tag, f.modified AS found_modified,
                   f.body AS found_body, f.size AS found_size
            FROM named n ASOF LEFT JOIN (SELECT * FROM named WHERE is_full) f
              ON n.canonical_url = f.canonical_url AND n.captured > f.captured
        ),
        checked AS (
            SELECT *, regexp_replace(tag, '^W/', '') = regexp_replace(found_tag, '^W/', '') AS same_tag,
                   modified = found_modified AS same_time
            FROM met
        ),
        judged AS (
            SELECT *, CASE WHEN is_full THEN 'full'
                           WHEN found_id IS NULL THEN 'orphan'
                           WHEN same_tag IS NULL AND same_time IS NULL THEN 'unvalidated'
                           WHEN coalesce(same_tag, true) AND coalesce(same_time, true) THEN 'resolved'
                           ELSE 'mismatch' END AS status
            FROM checked
        ),
        headed AS (
            SELECT *,
                   CASE WHEN status = 'resolved' THEN coalesce(tag, found_tag) ELSE tag END AS kept_tag,
                   CASE WHEN status = 'resolved' THEN coalesce(modified, found_modified) ELSE modified END AS kept_time
            FROM judged
        )
        SELECT record_id, canonical_url, status,
               CASE WHEN NOT is_full THEN found_id END AS response_id,
               CASE status WHEN 'resolved' THEN found_body WHEN 'full' THEN body END AS payload,
               'cache-control: max-age=' || CASE WHEN is_full THEN '60' ELSE '120' END
               || chr(10) || 'content-length: '
               || CASE status WHEN 'full' THEN size WHEN 'resolved' THEN found_size ELSE '0' END
               || CASE WHEN status IN ('full', 'resolved') THEN chr(10) || 'content-type: text/html' ELSE '' END
               || chr(10) || 'date: day ' || CAST(captured AS VARCHAR)
               || CASE WHEN kept_tag IS NULL THEN '' ELSE chr(10) || 'etag: ' || kept_tag END
               || CASE WHEN kept_time IS NULL THEN '' ELSE chr(10) || 'last-modified: ' || kept_time END AS headers
        FROM headed
    """,
}
