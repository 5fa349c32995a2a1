"""Taking in files: what has changed, what is known already, and what has to be read and chunked."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas

#: How a file was dealt with, in the order that the ways are tried.
UNCHANGED, SAME_CONTENT, CACHED, BOUNDARIES, SMALL, CHUNKED = WAYS = ("unchanged", "same_content", "cache_hit", "boundary_reuse", "small", "chunked")


def upsert(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """The rows of ``new`` and those of ``old`` whose key isn't in it."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def candidates(files: DataFrame) -> DataFrame:
    """One row a path, whichever of equal ones; control files of a repository aside."""
    return files.where(~F.col("path").rlike(r"(^|/)\.chunkwright(/|$)")).dropDuplicates(["path"])


def unchanged(size: Column, modified: Column, old_size: Column, old_modified: Column) -> Column:
    return size.eqNullSafe(old_size) & modified.eqNullSafe(old_modified)


def split_unchanged(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``files`` (``path``, ``size``, ``modified``) with ``known`` (digest, if size and time are as in the manifest). It asks for no content, so none is read."""
    old = manifest.select("path", F.col("size").alias("old_size"), F.col("modified").alias("old_modified"), F.col("file_digest").alias("old_digest"))
    rows = files.join(old, "path", "left")
    same = F.col("old_digest").isNotNull() & unchanged(F.col("size"), F.col("modified"), F.col("old_size"), F.col("old_modified"))
    return rows.withColumn("known", F.when(same, F.col("old_digest"))).drop("old_size", "old_modified")


def routed(files: DataFrame, manifest: DataFrame, cache: DataFrame, small: int = schemas.SMALL_FILE, large: int = schemas.LARGE_FILE) -> DataFrame:
    """``files`` (``path``, ``size``, ``modified``, ``file_digest``) with ``way``, the first way that applies.

    ``cache`` has the digests (``file_digest``) whose chunks are known. Of files of one digest that is nowhere known the first
    path is chunked and the others are cache hits, as the digest is known by then.
    """
    rows = split_unchanged(files, manifest).join(cache.select("file_digest").distinct().withColumn("cached", F.lit(True)), "file_digest", "left")
    is_small = F.col("size") <= small
    way = (
        F.when(F.col("known").isNotNull(), UNCHANGED)
        .when(F.col("old_digest") == F.col("file_digest"), SAME_CONTENT)
        .when(is_small, SMALL)
        .when(F.col("cached"), CACHED)
        .when(F.col("old_digest").isNotNull() & (F.col("size") >= large), BOUNDARIES)
        .otherwise(CHUNKED)
    )
    rows = rows.withColumn("way", way)
    first = rows.where(F.col("way") == CHUNKED).groupBy("file_digest").agg(F.min("path").alias("first"))
    rows = rows.join(first, "file_digest", "left")
    late = (F.col("way") == CHUNKED) & (F.col("path") != F.col("first"))
    return rows.withColumn("way", F.when(late, CACHED).otherwise(F.col("way"))).drop("known", "old_digest", "cached", "first")


def trace(routes: DataFrame) -> DataFrame:
    """One row: how many files went each way, and how many were new."""
    counts = [F.count_if(F.col("way") == w).alias(w) for w in WAYS]
    return routes.agg(F.count("*").alias("files"), *counts, F.count_if(F.col("way").isin(SMALL, CHUNKED, BOUNDARIES)).alias("new_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def commit_ids(files: DataFrame) -> DataFrame:
    """``commit``, ``id`` of commits given by their files (``commit``, ``parent``, ``message``, ``timestamp``, ``path``, ``file_digest``, ``size``).

    It is the digest of ``functions.commit_id``, but the files, sorted, pass through a task as a stream, so a commit may have any number of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if digest is None or row["commit"] != now:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now = row["commit"]
                    digest = hashlib.sha256(f"{'root' if row['parent'] is None else row['parent']}{row['message']}{row['timestamp']}".encode())
                digest.update(f"{row['path']}{row['file_digest']}{row['size']}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], ["commit", "id"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([digest.hexdigest()], pa.string())], ["commit", "id"])

    rows = files.select("commit", "parent", "message", "timestamp", "path", "file_digest", "size")
    return rows.repartition("commit").sortWithinPartitions("commit", "path").mapInArrow(run, "commit string, id string")
