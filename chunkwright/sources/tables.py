"""The driver's tables as relations of a content store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_path() -> Column:
    return F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path``, ``doc_id``, ``source``, ``text``, ``size`` (bytes) of each document."""
    return table(spark, sf_dir, "documents").select(doc_path().alias("path"), "doc_id", "source", "text", F.octet_length("text").cast("long").alias("size"))


def snapshot(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Snapshot A (ids not divisible by 7) or B (not by 11; every fifth text is a second version): ``path``, ``doc_id``, ``text``, ``size``, ``file_digest``."""
    rows = blobs(spark, sf_dir)
    if name == "a":
        rows = rows.where("doc_id % 7 <> 0")
    else:
        rows = rows.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" v2"))).otherwise(F.col("text")))
    return rows.select("path", "doc_id", "text", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("file_digest"))


#: The same as DuckDB SQL, to be put before a query.
SQL = """
WITH RECURSIVE blobs AS (
  SELECT lang || '/' || source || '/' || doc_id || '.txt' AS path, doc_id, source, text, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents),
snap_a AS (SELECT path, doc_id, text, size, sha256(text) AS file_digest FROM blobs WHERE doc_id % 7 <> 0),
second AS (SELECT path, doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' v2' ELSE text END AS text FROM blobs WHERE doc_id % 11 <> 0),
snap_b AS (SELECT path, doc_id, text, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS file_digest FROM second),
index_a AS (
  SELECT path, CASE doc_id % 4 WHEN 0 THEN 'Virtual' WHEN 1 THEN 'Hydrated' WHEN 2 THEN 'Dirty' ELSE 'NotInView' END AS state, 'A' AS commit_id, file_digest, size FROM snap_a),
visible_b AS (SELECT * FROM snap_b WHERE (path LIKE 'en/%' OR path LIKE 'fr/%') AND NOT path LIKE 'en/src0/%'),
disk AS (SELECT path FROM blobs WHERE doc_id % 3 <> 0)
"""


def index_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot A opened; states go round by the id."""
    state = F.element_at(F.array(*map(F.lit, ("Virtual", "Hydrated", "Dirty", "NotInView"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return snapshot(spark, sf_dir, "a").select("path", state.alias("state"), F.lit("A").alias("commit_id"), "file_digest", "size")


def disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs(spark, sf_dir).where("doc_id % 3 <> 0").select("path")


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits' files, lines as chunk references: ``path`` (order), ``id`` (part), ``len`` (quantity), and what gives them an order."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_partkey").cast("string").alias("id"), F.col("l_quantity").cast("long").alias("len"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("tie"))
