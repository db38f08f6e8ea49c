"""The queries op1 to op10 and the pipeline, for the registry at the repository's top."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import leaks_sql
from .bpe import token_digests
from .chat import format_chats
from .common import table
from .decontam import contamination_report
from .media import media_features
from .quality import quality
from .sharding import assign_shards
from .simhash import near_duplicates
from .token_output import token_output
from .toxicity import toxicity
from .urls import judge_urls

#: The vocabulary file of the token operators.
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path() -> str:
    return public_tokenizers.path(VOCABULARY)


#: The listed rules of op7: verdict, host, start of path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

Query = Callable[[SparkSession, str], DataFrame]


def op1_bounded_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 24 shards whose counts differ by one at most."""
    return assign_shards(table(spark, sf_dir, "documents"), 24).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def op2_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return token_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op4_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents in wavelet-matrix shards, read back."""
    return token_output(table(spark, sf_dir, "documents"), vocabulary_path())


def op5_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a field fitted on the rows that are not held out."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with repaired roles, rendered."""
    return format_chats(table(spark, sf_dir, "conversations"))


def op7_boosted_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL by rules, else by trees fitted on the URLs that rules decide."""
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


def op8_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a machine fitted on the rows that are not held out."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as an MPEG transport stream, read back."""
    return media_features(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "packets", "cc_errors")


def op10_prefix_filtered_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a benchmark window, and the items found."""
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# Parts of the results above that SQL can express


def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and slots of every shard of op1: counts that differ by one at most, slots without gaps."""
    placed = op1_bounded_ring_shards(spark, sf_dir).groupBy("shard")
    return placed.agg(F.count("*").alias("rows"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count_distinct("slot").alias("slots"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and listed rule of every page of op7."""
    judged = op7_boosted_url_filter(spark, sf_dir)
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and digests of the payloads that op9 reads back."""
    return op9_transport_stream(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


QUERIES: dict[str, Query] = {
    "op1_bounded_ring_shards": op1_bounded_ring_shards,
    "op2_simhash_covering": op2_simhash_covering,
    "op3_transducer_bpe": op3_transducer_bpe,
    "op4_wavelet_tokens": op4_wavelet_tokens,
    "op5_crf_quality": op5_crf_quality,
    "op6_role_repair": op6_role_repair,
    "op7_boosted_url_filter": op7_boosted_url_filter,
    "op8_string_kernel_toxicity": op8_string_kernel_toxicity,
    "op9_transport_stream": op9_transport_stream,
    "op10_prefix_filtered_leaks": op10_prefix_filtered_leaks,
    "shard_counts": shard_counts,
    "url_rules": url_rules,
    "media_payloads": media_payloads,
}

_LISTED = ", ".join(f"('{verdict}', '{host}', '{start}')" for verdict, host, start in RULES)

#: The other results of rings, fingerprints, merges, models, streams and repairs have no form in DuckDB SQL; tests hold
#: each of them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op10_prefix_filtered_leaks": leaks_sql.REPORT,
    "shard_counts": """
WITH n AS (SELECT count(*) AS n FROM documents)
SELECT s::INTEGER AS shard, n // 24 + (s < n % 24)::INTEGER AS rows, 0::BIGINT AS first_slot, n // 24 + (s < n % 24)::INTEGER - 1 AS last_slot,
  n // 24 + (s < n % 24)::INTEGER AS slots
FROM n, range(24) r(s) WHERE n // 24 + (s < n % 24)::INTEGER > 0""",
    "url_rules": f"""
WITH rule(verdict, rule_host, start) AS (VALUES {_LISTED}),
rest AS (SELECT page_id, row_number() OVER () AS row, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (
  SELECT page_id, row, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM rest)
SELECT page_id, host, path, max_by(rule_host || start, length(rule_host || start)) AS rule, max_by(verdict, length(rule_host || start)) AS ruled
FROM cut LEFT JOIN rule ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, start)
GROUP BY page_id, row, host, path""",
    "media_payloads": """
WITH text AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
size AS (SELECT doc_id, t, strlen(t) AS n, greatest(1, (strlen(t) + 191) // 192) * 192 AS padded FROM text)
SELECT doc_id, n AS n_bytes, padded AS payload_bytes, sha256(t || repeat(' ', padded - n)) AS payload_sha256 FROM size""",
}
