"""Checks: chunks that are missing, files whose bytes have changed, chunks that don't tile their file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tiling(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """``path``, ``n_chunks``, ``total``, ``tiles`` for ``files`` (``path``, ``size``): offsets go on from 0 to the size without a gap."""
    order = Window.partitionBy("path").orderBy("offset", "len")
    rows = chunks.select("path", "offset", "len", F.coalesce(F.lag(F.col("offset") + F.col("len")).over(order), F.lit(0)).alias("expected"))
    sums = rows.groupBy("path").agg(F.count("*").alias("n_chunks"), F.sum("len").alias("total"), F.bool_and(F.col("offset") == F.col("expected")).alias("even"))
    return files.join(sums, "path", "left").select("path", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("total", F.lit(0)).alias("total"), (F.coalesce("even", F.lit(False)) & (F.col("total") == F.col("size"))).alias("tiles"))


def missing_chunks(refs: DataFrame, store: DataFrame) -> DataFrame:
    """Quick check: references (with ``id``) that the store lacks; empty if all is well."""
    return refs.join(store.select("id").distinct(), "id", "left_anti")


def reassembled(refs: DataFrame, store: DataFrame) -> DataFrame:
    """``path``, ``content``: the chunks of each file put together in order. A file with a missing chunk is left out."""
    rows = refs.join(store.select("id", "data"), "id", "left")
    whole = F.bool_and(F.col("data").isNotNull()).alias("whole")
    return rows.groupBy("path").agg(F.expr("listagg(data, X'') WITHIN GROUP (ORDER BY offset)").alias("content"), whole).where("whole").select("path", F.coalesce("content", F.lit("").cast("binary")).alias("content"))


def wrong_files(files: DataFrame, refs: DataFrame, store: DataFrame) -> DataFrame:
    """Deep check: ``path``, ``file_digest`` of files (each digest once) whose bytes don't have their digest."""
    once = files.groupBy("file_digest").agg(F.min("path").alias("path"))
    content = reassembled(refs.join(once.select("path"), "path", "left_semi"), store)
    return once.join(content, "path", "left").where(F.coalesce(F.sha2("content", 256) != F.col("file_digest"), F.lit(True))).select("path", "file_digest")
