"""Moving commits and chunks between two roots. What is moved is found by anti-joins; a head moves last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import history, patterns, store


def wanted_chunks(files: DataFrame, paths: tuple[str, ...] = (), default_only: bool = False) -> DataFrame:
    """Distinct ids of the chunks of files to fetch."""
    rows = files.where(patterns.to_fetch(F.col("path"), F.col("size"), paths, default_only))
    return rows.select(F.explode("chunks.id").alias("id")).distinct()


def to_fetch(files: DataFrame, local: DataFrame, paths: tuple[str, ...] = (), default_only: bool = False) -> DataFrame:
    return store.missing(wanted_chunks(files, paths, default_only), local)


def push_chunks(files: DataFrame, chain: DataFrame, remote: DataFrame) -> DataFrame:
    """Chunks of the commits in ``chain`` that the remote lacks, each once."""
    ids = files.join(chain.select(F.col("id").alias("commit_id")), "commit_id", "left_semi").select(F.explode("chunks.id").alias("id"))
    return store.missing(ids, remote)


def push_report(chain: DataFrame, chunks: DataFrame, head: str) -> DataFrame:
    return chain.agg(F.count("*").alias("commit_count")).crossJoin(chunks.agg(F.count("*").alias("chunk_count"))).select(F.lit(head).alias("new_head"), "commit_count", "chunk_count")  # single rows


def fast_forward(commits: DataFrame, local_head: str | None, remote_head: str | None) -> bool:
    """Whether moving from ``local_head`` to ``remote_head`` loses nothing."""
    if local_head is None or local_head == remote_head:
        return True
    return remote_head is not None and history.is_ancestor(commits, local_head, remote_head).first()["answer"] == "yes"


def metadata_only(commits: DataFrame) -> DataFrame:
    """Commits without their files, as history is kept of those that aren't open."""
    return commits.drop("files").withColumn("files_omitted", F.lit(True))


def visible_manifest(files: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), hot_only: bool = False) -> DataFrame:
    """The remote's answer for a commit's files: in view by its own dialect, or the hot ones of them."""
    keep = patterns.in_view(F.col("path"), include, exclude, "remote")
    return files.where(keep & patterns.is_hot(F.col("path"), F.col("size")) if hot_only else keep)
