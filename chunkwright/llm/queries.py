"""The queries of the text operators: production parameters, whole tables, whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, fingerprint, language, license_scan, near_dedup, packing, pii, secret_scan, sentence_pieces, substring_dedup, topk


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(common.table(spark, sf_dir, "documents"))


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encoded(common.table(spark, sf_dir, "documents"), with_ids=False)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(common.table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.substring_dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.array_join(F.transform("__llm_removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return rows.select("doc_id", F.col("__llm_before").alias("n_chars"), F.col("__llm_removed_chars").alias("removed_chars"), removed.alias("removed"), "text")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(common.table(spark, sf_dir, "documents"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.embeddings_top_k(common.table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(common.table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.against_edit(common.table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(common.table(spark, sf_dir, "documents")).drop("key")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(common.table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_sentence_pieces, op3_pii, op4_substring_dedup, op5_secrets, op6_top_k, op7_packing, op8_fingerprints, op9_near_dedup, op10_language)}


def oracle_sql() -> dict[str, str]:
    """Tokenizers, hash functions and models have no SQL; those queries are tested against brute force."""
    return {"op1_license_scan": license_scan.oracle(), "op6_top_k": TOP_K}


TOP_K = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""
