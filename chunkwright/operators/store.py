"""The chunk store as relations: what it lacks, what it takes in, how chunks are packed into segments and rows into pages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas


def missing(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """Ids asked for that the store lacks, each once."""
    return wanted.select("id").distinct().join(store.select("id"), "id", "left_anti")


def present(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """Ids asked for that the store has, each once."""
    return wanted.select("id").distinct().join(store.select("id"), "id", "left_semi")


def put_results(batch: DataFrame, store: DataFrame) -> DataFrame:
    """``id``, ``raw_len``, ``was_new`` of each distinct chunk of a batch (``id``, ``raw_len``)."""
    have = store.select("id").distinct().withColumn("have", F.lit(True))
    return batch.groupBy("id").agg(F.min("raw_len").alias("raw_len")).join(have, "id", "left").select("id", "raw_len", F.col("have").isNull().alias("was_new"))


def new_chunks(batch: DataFrame, store: DataFrame) -> DataFrame:
    """The rows to append: one for each id that the store lacks. Ids are compared before any bytes are moved."""
    return batch.join(missing(batch, store), "id", "left_semi").dropDuplicates(["id"])


def sorted_by_id(chunks: DataFrame) -> DataFrame:
    """Dealt by ranges of the id and sorted, so that a file's statistics say which ids it may have."""
    return chunks.repartitionByRange("id").sortWithinPartitions("id")


def get(store: DataFrame, ids: list[str]) -> DataFrame:
    """The chunks of a few ids, each once: a filter for the scan, not a join."""
    return store.where(F.col("id").isin(ids)).dropDuplicates(["id"])


def resolve(refs: DataFrame, store: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
    """``refs`` with ``source`` (segment, legacy or missing) and ``place`` of each chunk."""
    rows = refs.join(store.groupBy("id").agg(F.min(F.struct("segment_id", "offset")).alias("s")), "id", "left")
    old = legacy.groupBy("id").agg(F.min("path").alias("legacy_path")) if legacy is not None else None
    rows = rows.join(old, "id", "left") if old is not None else rows.withColumn("legacy_path", F.lit(None).cast("string"))
    source = F.when(F.col("s").isNotNull(), "segment").when(F.col("legacy_path").isNotNull(), "legacy").otherwise("missing")
    place = F.when(F.col("s").isNotNull(), F.format_string("%08d.seg:%d", F.col("s.segment_id"), F.col("s.offset"))).otherwise(F.col("legacy_path"))
    return rows.withColumn("source", source).withColumn("place", place).drop("s", "legacy_path")


def checked(resolved: DataFrame) -> DataFrame:
    """The same rows; one whose chunk is missing is an error when it is read."""
    return resolved.withColumn("source", F.when(F.col("source") == "missing", F.raise_error(F.concat(F.lit("object not found: "), F.col("id")))).otherwise(F.col("source")))


def first_missing(wanted: DataFrame, got: DataFrame) -> DataFrame:
    """The least id asked for that hasn't come, if any: a fetch is whole if this is empty."""
    return missing(wanted, got).orderBy("id").limit(1)


def stats(store: DataFrame) -> DataFrame:
    return store.agg(F.count("*").alias("object_count"), F.coalesce(F.sum("stored_len"), F.lit(0)).alias("object_bytes"))


def last_segment(store: DataFrame) -> DataFrame:
    return store.agg(F.coalesce(F.max("segment_id"), F.lit(1)).alias("segment_id"))


def packed_in_order(rows: DataFrame, group: list[str], order: list[str], size: Column, most: int, name: str) -> DataFrame:
    """Greedy packing of each group's rows, in order: a row that would bring a page over ``most`` begins the next one.

    Adds ``name`` (from 0) and ``place``, the sum of the sizes before the row in its page. The fold starts anew at each overflow, so it
    isn't a windowed sum. A group's rows are sorted (spilling if they must) and pass through one task as a
    stream, which holds one batch and two numbers.
    """
    columns = rows.columns
    rows = rows.withColumn("__size", size.cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__size") + f", `{name}` long, place long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, page, used, empty = None, 0, 0, True
        for batch in batches:
            pages, places = [], []
            keys = list(zip(*(batch.column(g).to_pylist() for g in group), strict=True)) if group else [()] * batch.num_rows
            for own, n in zip(keys, batch.column("__size").to_pylist(), strict=True):
                if own != key:
                    key, page, used, empty = own, 0, 0, True
                if not empty and used + n > most:
                    page, used = page + 1, 0
                pages.append(page)
                places.append(used)
                used, empty = used + n, False
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(pages, pa.int64()), pa.array(places, pa.int64())], [*columns, name, "place"])

    dealt = rows.repartition(*group) if group else rows.repartition(1)
    return dealt.sortWithinPartitions(*group, *order).mapInArrow(run, schema)


def segments(chunks: DataFrame, most: int = schemas.SEGMENT, shards: int = 256) -> DataFrame:
    """``id``, ``stored_len``, ``shard``, ``segment``, ``place`` for new chunks. Shards, by the id's first digits, fill segments of their own side by side."""
    rows = chunks.select("id", "stored_len").withColumn("shard", F.conv(F.substring("id", 1, 2), 16, 10).cast("int") % shards)
    return packed_in_order(rows, ["shard"], ["id"], F.col("stored_len"), most, "segment")


def entry_bytes(path: Column, digest: Column, n_chunks: Column) -> Column:
    """What a manifest entry takes in a page, about."""
    return F.octet_length(path) + F.octet_length(digest) + n_chunks * 104 + 64


def manifest_pages(files: DataFrame, most: int = schemas.PAGE) -> DataFrame:
    """``commit_id``, ``path``, ``entry_bytes``, ``page`` for files (``commit_id``, ``path``, ``file_digest``, ``n_chunks``)."""
    rows = files.select("commit_id", "path", entry_bytes(F.col("path"), F.col("file_digest"), F.col("n_chunks")).cast("long").alias("entry_bytes"))
    return packed_in_order(rows, ["commit_id"], ["path"], F.col("entry_bytes"), most, "page").drop("place")


def page_at(files: DataFrame, offset: int, most: int = schemas.PAGE) -> DataFrame:
    """The page that starts at row ``offset`` by path, with ``next_offset`` and ``has_more``: as a client asks for one after the other."""
    order = Window.partitionBy("commit_id").orderBy("path")
    rows = files.withColumn("n", F.row_number().over(order) - 1).where(F.col("n") >= offset)
    size = entry_bytes(F.col("path"), F.col("file_digest"), F.col("n_chunks"))
    # from a given start the first page is the rows whose running sum fits, and at least one
    rows = rows.withColumn("sum", F.sum(size).over(order)).withColumn("last", F.max("n").over(Window.partitionBy("commit_id")))
    page = rows.where((F.col("sum") <= most) | (F.col("n") == offset))
    return page.withColumn("next_offset", F.max("n").over(Window.partitionBy("commit_id")) + 1).withColumn("has_more", F.col("next_offset") <= F.col("last")).drop("n", "sum", "last")


def batches(ids: DataFrame, size: int = schemas.BATCH) -> DataFrame:
    """``batch``, ``ids``: ids by 64. Ids are put in buckets by hash, each small enough to be numbered in one task."""
    rows = ids.select("id").distinct().withColumn("bucket", F.substring("id", 1, 2))
    rows = rows.withColumn("n", F.floor((F.row_number().over(Window.partitionBy("bucket").orderBy("id")) - 1) / size))
    return rows.groupBy("bucket", "n").agg(F.array_sort(F.collect_list("id")).alias("ids"))
