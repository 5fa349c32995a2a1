"""States of a workspace's files, and how opening, hydrating, dehydrating and committing change them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..schemas import DIRTY, HYDRATED, NOT_IN_VIEW, PENDING, VIRTUAL
from ..sources.shared import cut_lineage
from .ingest import unchanged, upsert


def refreshed(index: DataFrame, disk: DataFrame, manifest: DataFrame) -> DataFrame:
    """The index with states as the disk says: of files that were hydrated or dirty one that has gone is virtual, one whose bytes (or size
    and time, where the manifest has the digest) are the committed ones is hydrated, another is dirty.

    ``disk`` has ``path``, ``size``, ``modified`` and ``digest`` of what is there.
    """
    there = disk.select("path", F.col("size").alias("d_size"), F.col("modified").alias("d_time"), F.col("digest").alias("d_digest"), F.lit(True).alias("there"))
    known = manifest.select("path", F.col("size").alias("m_size"), F.col("modified").alias("m_time"), F.col("file_digest").alias("m_digest"))
    rows = index.join(there, "path", "left").join(known, "path", "left")
    fast = F.col("m_digest").isNotNull() & unchanged(F.col("d_size"), F.col("d_time"), F.col("m_size"), F.col("m_time")) & (F.col("m_digest") == F.col("file_digest"))
    clean = F.coalesce(fast | (F.col("d_digest") == F.col("file_digest")), F.lit(False))
    state = F.when(~F.col("state").isin(HYDRATED, DIRTY), F.col("state")).when(F.col("there").isNull(), VIRTUAL).when(clean, HYDRATED).otherwise(DIRTY)
    return rows.withColumn("state", state).select(*index.columns)


def _with_targets(index: DataFrame, target: DataFrame, visible: DataFrame, disk: DataFrame) -> DataFrame:
    """A full join by path of the index, the files to be opened, those in view and those on disk."""
    rows = index.select("path", "state", F.col("file_digest").alias("old_digest")).join(target.select("path", F.col("file_digest").alias("new_digest"), F.col("size").alias("new_size"), F.lit(True).alias("wanted")), "path", "full")
    rows = rows.join(visible.select("path").distinct().withColumn("seen", F.lit(True)), "path", "left").join(disk.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
    keep = (F.col("state") == HYDRATED) & (F.col("old_digest") == F.col("new_digest")) & F.col("there")
    return rows.withColumn("keep", F.coalesce(keep, F.lit(False))).withColumn("seen", F.coalesce("seen", F.lit(False))).withColumn("wanted", F.coalesce("wanted", F.lit(False)))


def cleanup_paths(index: DataFrame, target: DataFrame, visible: DataFrame, disk: DataFrame) -> DataFrame:
    """Paths to delete before a commit is opened: hydrated ones that it lacks, has otherwise or has out of view, and its own that can't be kept as they are."""
    rows = _with_targets(index, target, visible, disk)
    gone = (F.col("state") == HYDRATED) & (~F.col("wanted") | ~F.col("seen") | (F.col("old_digest") != F.col("new_digest")))
    return rows.where(F.coalesce(gone, F.lit(False)) | F.col("wanted") & (~F.col("seen") | ~F.col("keep"))).select("path").distinct()


def opened(index: DataFrame, target: DataFrame, visible: DataFrame, disk: DataFrame, commit_id: Column) -> DataFrame:
    """The index once a commit is open."""
    rows = _with_targets(index, target, visible, disk).where("wanted")
    state = F.when(~F.col("seen"), NOT_IN_VIEW).when(F.col("keep"), HYDRATED).otherwise(VIRTUAL)
    return rows.select("path", state.alias("state"), commit_id.alias("commit_id"), F.col("new_digest").alias("file_digest"), F.col("new_size").alias("size"))


def to_hydrate(files: DataFrame, index: DataFrame, asked: Column) -> DataFrame:
    """Files of the workspace that were asked for and are neither hydrated nor out of view. One that the index lacks isn't taken."""
    states = index.select("path", "state").where(~F.col("state").isin(NOT_IN_VIEW, HYDRATED))
    return files.where(asked).join(states.select("path"), "path", "left_semi")


def hydrate_plan(files: DataFrame, index: DataFrame, asked: Column) -> DataFrame:
    """``path``, ``file_digest``, ``size``, ``n_chunks``, largest first: what is written in that order ends evenly."""
    return to_hydrate(files, index, asked).select("path", "file_digest", "size", F.size("chunks").alias("n_chunks")).orderBy(F.desc("size"), "path")


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """``rows`` with their number (from 1) by ``order``. Ranges are numbered side by side, and each goes on where those before it end: no task has all rows."""
    ranged = cut_lineage(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")  # a row a range
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn(name, inside).join(F.broadcast(before), "__range").withColumn(name, (F.col(name) + F.col("__before")).cast("int")).drop("__range", "__before")


def hydrated(index: DataFrame, written: DataFrame) -> DataFrame:
    rows = index.join(written.select("path").distinct().withColumn("__w", F.lit(True)), "path", "left")
    return rows.withColumn("state", F.when(F.col("__w"), HYDRATED).otherwise(F.col("state"))).select(*index.columns)


def hydrated_count(index: DataFrame) -> DataFrame:
    """What hydrating reports: all hydrated files afterwards, not those just written."""
    return index.agg(F.count_if(F.col("state") == HYDRATED).alias("hydrated"))


def dehydrate_paths(index: DataFrame, asked: Column) -> DataFrame:
    """Hydrated files that were asked for. A dirty one among those asked for is found first, by ``dirty``: nothing is done then."""
    return index.where(asked & (F.col("state") == HYDRATED)).select("path")


def dirty(index: DataFrame, asked: Column | None = None) -> DataFrame:
    rows = index.where(F.col("state") == DIRTY)
    return (rows.where(asked) if asked is not None else rows).select("path")


def dehydrated(index: DataFrame, asked: Column) -> DataFrame:
    return index.withColumn("state", F.when(asked & (F.col("state") == HYDRATED), VIRTUAL).otherwise(F.col("state")))


def after_commit(index: DataFrame, files: DataFrame, seen: Column, disk: DataFrame, commit_id: Column) -> DataFrame:
    """The index after a commit of ``files``: theirs are new, others stay."""
    rows = files.join(disk.select("path").distinct().withColumn("__there", F.lit(True)), "path", "left")
    state = F.when(~seen, NOT_IN_VIEW).when(F.col("__there"), HYDRATED).otherwise(VIRTUAL)
    return upsert(index, rows.select("path", state.alias("state"), commit_id.alias("commit_id"), "file_digest", "size"))


def status(index: DataFrame, sample: int = schemas.SAMPLE) -> DataFrame:
    """One row: a count for each state and the first paths of three of them, comma-joined.

    Samples are the least paths of each task and of those the least: no task holds more than ``sample`` of each state.
    """
    counts = [F.count_if(F.col("state") == s).alias(n) for s, n in ((VIRTUAL, "virtual"), (HYDRATED, "hydrated"), (DIRTY, "dirty"), (PENDING, "pending"), (NOT_IN_VIEW, "not_in_view"))]
    row = index.agg(*counts)
    for state, name in ((DIRTY, "dirty_paths"), (PENDING, "pending_paths"), (NOT_IN_VIEW, "not_in_view_paths")):
        first = index.where(F.col("state") == state).select("path").orderBy("path").limit(sample)
        row = row.crossJoin(first.agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias(name)))  # single rows
    return row


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path``, ``change`` (added, removed, changed, same) between two snapshots (``path``, ``file_digest``)."""
    rows = before.select("path", F.col("file_digest").alias("a")).join(after.select("path", F.col("file_digest").alias("b")), "path", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return rows.select("path", change.alias("change"), F.col("a").alias("before"), F.col("b").alias("after"))
