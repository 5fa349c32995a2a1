"""The query catalogue: each operator applied to the driver's tables, beside DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as fn
from .. import streaming
from ..operators import chunking, history, ingest, integrity, locks, patterns, reporting, store, sync, workspace
from ..sources import files, tables
from ..sources.shared import cut_lineage, shared_folder
from ..sources.tables import SQL, blobs, snapshot, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
INCLUDE, EXCLUDE = ("en/...", "fr/src1/..."), ("en/src0/...", "*.bin")


def query(sql: str | None, head: str = SQL) -> Callable:
    def kept(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = head + sql if head else sql
        return f

    return kept


# Blobs and chunks


@query("SELECT path, size, sha256(text) AS file_digest, CASE WHEN size <= 4096 THEN 'small' ELSE 'large' END AS size_class FROM blobs")
def blob_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs(spark, sf_dir).select("path", "size", fn.blob_id(F.col("text")).alias("file_digest"), F.when(F.col("size") <= 4096, "small").otherwise("large").alias("size_class"))


@query("""SELECT path, CAST(n // 4096 AS INTEGER) AS ordinal, n AS "offset", CAST(octet_length(part) AS BIGINT) AS len, sha256(part) AS id
FROM (SELECT path, n, encode(text)[n + 1:n + 4096] AS part FROM blobs, range(0, greatest(size, 1), 4096) t(n))""")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, not characters, are cut."""
    return chunking.fixed_chunks(blobs(spark, sf_dir).select("path", F.col("text").cast("binary").alias("content")), 4096)


LINES = """, parts AS (SELECT path, source, doc_id, string_split(text, chr(10)) AS p FROM blobs),
lines AS (SELECT path, source, doc_id, CAST(i - 1 AS INTEGER) AS ordinal, p[i] AS line, sha256(p[i]) AS id, CAST(octet_length(encode(p[i])) AS BIGINT) AS len,
  CAST(list_sum(list_transform(p[1:i-1], lambda x: octet_length(encode(x)) + 1)) AS BIGINT) AS before FROM parts, range(1, 100000) t(i) WHERE i <= len(p))
"""


@query(LINES + 'SELECT path, ordinal, coalesce(before, 0) AS "offset", len, id FROM lines')
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.line_chunks(blobs(spark, sf_dir)).drop("line")


def _put_together(blobs_: DataFrame, chunks: DataFrame) -> DataFrame:
    """``path``, ``file_digest`` of the bytes that the chunks (``path``, ``offset``, ``len``, ``id``) have, looked up by id and put together in order."""
    data = F.substring(F.col("content"), (F.col("offset") + 1).cast("int"), F.col("len").cast("int"))
    held = chunks.join(blobs_.select("path", "content"), "path").select("id", data.alias("data")).dropDuplicates(["id"])
    return integrity.reassembled(chunks.select("path", "id", "offset"), held).select("path", F.sha2("content", 256).alias("file_digest"))


@query("SELECT path, size, CAST(ceil(greatest(size, 1) / 4096.0) AS BIGINT) AS least_chunks, TRUE AS sizes_hold, sha256(text) AS file_digest FROM blobs")
def cdc_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-defined chunks, looked up by id, give each blob's bytes again; they keep to their least and most (but the last), and are enough."""
    rows = blobs(spark, sf_dir).select("path", F.col("text").cast("binary").alias("content"), "size")
    chunks = cut_lineage(chunking.content_chunks(rows, chunking.Sizes(256, 1024, 4096), small=0))
    order = Window.partitionBy("path").orderBy(F.desc("offset"))
    holds = chunks.withColumn("last", F.row_number().over(order) == 1).groupBy("path").agg(F.bool_and((F.col("len") <= 4096) & (F.col("last") | (F.col("len") >= 256))).alias("sizes_hold"), F.sum("len").alias("total"), F.count("*").alias("n"))
    least = F.ceil(F.greatest("total", F.lit(1)) / 4096)
    out = holds.select("path", F.col("total").alias("size"), F.when(F.col("n") >= least, least).alias("least_chunks"), "sizes_hold")
    return out.join(_put_together(rows, chunks), "path")


REPORT = "CAST(count(*) AS BIGINT) AS total_chunks, CAST(count(DISTINCT id) AS BIGINT) AS distinct_chunks, CAST(sum(len) AS BIGINT) AS total_bytes"


@query(LINES + f"SELECT r.*, u.unique_bytes FROM (SELECT {REPORT} FROM lines) r, (SELECT CAST(sum(len) AS BIGINT) AS unique_bytes FROM (SELECT DISTINCT id, len FROM lines)) u")
def dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has to be stored once lines that occur again are gone: counts are added up for each id before any global sum."""
    ids = chunking.line_chunks(blobs(spark, sf_dir)).groupBy("id").agg(F.count("*").alias("n"), F.max("len").alias("len"))
    return ids.agg(F.sum("n").alias("total_chunks"), F.count("*").alias("distinct_chunks"), F.sum(F.col("n") * F.col("len")).alias("total_bytes"), F.sum("len").alias("unique_bytes"))


@query(LINES + f"SELECT source, {REPORT} FROM lines GROUP BY source")
def dedup_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blobs(spark, sf_dir)
    ids = chunking.line_chunks(rows.withColumn("path", F.col("source"))).groupBy(F.col("path").alias("source"), "id").agg(F.count("*").alias("n"), F.max("len").alias("len"))
    return ids.groupBy("source").agg(F.sum("n").alias("total_chunks"), F.count("*").alias("distinct_chunks"), F.sum(F.col("n") * F.col("len")).alias("total_bytes"))


@query("""SELECT path, CAST(size // 64 * 64 AS BIGINT) AS kept, CAST(len(range(0, size // 64 * 64, 64)) AS BIGINT) AS n_kept, sha256(text) AS file_digest FROM blobs""")
def boundary_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blob whose end was taken off keeps the boundaries (each 64 bytes here) within its new size; the rest is chunked anew."""
    rows = blobs(spark, sf_dir).select("path", "size", F.col("text").cast("binary").alias("content"))
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") + 64, F.lit(64).cast("long"))
    previous = rows.select("path", F.transform(starts, lambda at: F.struct(F.lit("").alias("id"), at.alias("offset"), F.lit(64).cast("long").alias("len"))).alias("chunks"))
    new = cut_lineage(chunking.boundary_reuse(rows.select("path", "content"), previous, chunking.Sizes(16, 32, 64)))
    kept = previous.join(rows.select("path", "size"), "path").select("path", chunking.resume_offset(F.col("chunks"), F.col("size")).alias("kept"), F.size(chunking.reused_prefix(F.col("chunks"), F.col("size"))).cast("long").alias("n_kept"))
    whole = _put_together(rows, new).join(rows.where("size = 0").select("path"), "path", "left_anti")
    return kept.join(whole.unionByName(rows.where("size = 0").select("path", F.sha2("content", 256).alias("file_digest"))), "path")


# Filters


def _filtered(spark: SparkSession, sf_dir: str, keep: Callable) -> DataFrame:
    return blobs(spark, sf_dir).where(keep(F.col("path"))).select("path", "size")


@query("SELECT path, size FROM blobs WHERE (path LIKE 'en/%' OR path LIKE 'fr/src1/%') AND NOT path LIKE 'en/src0/%'")
def view_filter_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, lambda p: patterns.in_view(p, INCLUDE, EXCLUDE))


@query("SELECT path, size FROM blobs WHERE (path LIKE '%.txt' AND path LIKE 'de/%') OR path LIKE 'es/src2/%'")
def view_filter_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, lambda p: patterns.in_view(p, (" de/*.txt", "es/src2/", "*.tar.gz", "src*"), ()))


@query("SELECT path, size FROM blobs WHERE path LIKE 'en/%'")
def view_filter_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare folders and globs match nothing here."""
    return _filtered(spark, sf_dir, lambda p: patterns.in_view(p, ("en/...", "fr", "*.txt"), ("en/src0",), "remote"))


@query("SELECT path, size FROM blobs WHERE (path LIKE 'en/%' OR path LIKE 'fr/src1/%') AND NOT path LIKE 'en/src0/%'")
def view_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("include", p) for p in INCLUDE] + [("exclude", "en/src0/...")], "kind string, pattern string")
    return patterns.view_by_rules(blobs(spark, sf_dir).select("path", "size"), rules)


@query("SELECT path, size FROM blobs WHERE size <= 2000 AND (path LIKE 'en/%' OR path LIKE 'de/src1/%')")
def hot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs(spark, sf_dir).where(patterns.is_hot(F.col("path"), F.col("size"), ("en/...", "de/src1"), 2000)).select("path", "size")


@query("SELECT path, size FROM blobs WHERE path LIKE 'en/src1/%' OR path LIKE 'fr/%'")
def path_args_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, lambda p: patterns.in_paths(p, ("en\\src1/", "fr", "e")))


@query("SELECT path, size FROM blobs WHERE path LIKE 'fr/%'")
def path_args_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, lambda p: patterns.in_paths(p, ("en/src1/", ".", "fr"), "remote"))


@query("SELECT DISTINCT regexp_extract(path, '^(.*)/', 1) || tail AS pattern FROM blobs, (VALUES (''), ('/...')) t(tail)")
def include_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder that is asked for stands for itself and for what is below it, whichever way it is written."""
    folder = F.regexp_extract("path", "^(.*)/", 1)
    asked = blobs(spark, sf_dir).select(F.explode(F.array(folder, F.concat(F.lit("./"), F.translate(folder, "/", "\\"), F.lit("/")))).alias("path"))
    return patterns.include_patterns(asked.unionByName(spark.createDataFrame([(".",)], "path string")))


# Ingest

PREVIOUS = """, manifest AS (SELECT path, size, doc_id % 2 AS modified, file_digest FROM snap_a),
cache AS (SELECT DISTINCT file_digest FROM snap_a WHERE doc_id % 3 = 0),
files AS (SELECT path, size, doc_id % 2 + CAST(doc_id % 13 = 0 AS INTEGER) AS modified, file_digest FROM snap_b),
tried AS (SELECT f.path, f.size, f.file_digest,
  CASE WHEN m.file_digest IS NOT NULL AND f.size = m.size AND f.modified = m.modified THEN 'unchanged'
       WHEN m.file_digest = f.file_digest THEN 'same_content'
       WHEN f.size <= 1000 THEN 'small'
       WHEN c.file_digest IS NOT NULL THEN 'cache_hit'
       WHEN m.file_digest IS NOT NULL AND f.size >= 10000 THEN 'boundary_reuse' ELSE 'chunked' END AS way
  FROM files f LEFT JOIN manifest m USING (path) LEFT JOIN cache c ON c.file_digest = f.file_digest),
routes AS (SELECT t.path, t.size, t.file_digest, CASE WHEN way = 'chunked' AND path <> least_path THEN 'cache_hit' ELSE way END AS way
  FROM tried t LEFT JOIN (SELECT file_digest, min(path) AS least_path FROM tried WHERE way = 'chunked' GROUP BY file_digest) USING (file_digest))
"""


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = snapshot(spark, sf_dir, "a"), snapshot(spark, sf_dir, "b")
    manifest = a.select("path", "size", (F.col("doc_id") % 2).alias("modified"), "file_digest")
    files = b.select("path", "size", (F.col("doc_id") % 2 + (F.col("doc_id") % 13 == 0).cast("int")).alias("modified"), "file_digest")
    return ingest.routed(files, manifest, a.where("doc_id % 3 = 0").select("file_digest"), small=1000, large=10000)


@query(PREVIOUS + "SELECT path, size, file_digest, way FROM routes")
def ingest_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routes(spark, sf_dir).select("path", "size", "file_digest", "way")


WAYS = ", ".join(f"CAST(count(*) FILTER (way = '{w}') AS BIGINT) AS {w}" for w in ingest.WAYS)


@query(PREVIOUS + f"SELECT CAST(count(*) AS BIGINT) AS files, {WAYS}, CAST(count(*) FILTER (way IN ('small', 'chunked', 'boundary_reuse')) AS BIGINT) AS new_files, CAST(sum(size) AS BIGINT) AS bytes FROM routes")
def add_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.trace(_routes(spark, sf_dir))


@query("SELECT path, size, file_digest FROM snap_b UNION ALL SELECT path, size, file_digest FROM snap_a WHERE path NOT IN (SELECT path FROM snap_b)")
def staging_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [snapshot(spark, sf_dir, s).select("path", "size", "file_digest") for s in "ab"]
    return ingest.upsert(*rows)


@query("SELECT path, min(size) AS size FROM blobs GROUP BY path")
def candidate_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blobs(spark, sf_dir).select("path", "size")
    return ingest.candidates(rows.unionByName(rows).unionByName(spark.createDataFrame([("a/.chunkwright/config", 1)], "path string, size long")))


# Store

#: All chunks are asked for; the other side has those of snapshot A.
IDS = LINES + ", have AS (SELECT DISTINCT id, len FROM lines WHERE path IN (SELECT path FROM snap_a)), want AS (SELECT DISTINCT id, len FROM lines)\n"


def _want(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.line_chunks(blobs(spark, sf_dir)).select("id", F.col("len").alias("raw_len"))


def _have(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.line_chunks(snapshot(spark, sf_dir, "a")).select("id", F.col("len").alias("raw_len"))


@query(IDS + "SELECT id FROM want WHERE id NOT IN (SELECT id FROM have)")
def missing_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.missing(_want(spark, sf_dir), _have(spark, sf_dir))


@query(IDS + "SELECT id FROM want WHERE id IN (SELECT id FROM have)")
def has_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.present(_want(spark, sf_dir), _have(spark, sf_dir))


@query(IDS + "SELECT id, len AS raw_len, id NOT IN (SELECT id FROM have) AS was_new FROM want")
def put_was_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.put_results(_want(spark, sf_dir), _have(spark, sf_dir))


@query("SELECT DISTINCT sha256(text) AS id, size FROM blobs WHERE sha256(text) IN (SELECT file_digest FROM snap_a WHERE path = (SELECT min(path) FROM snap_a) OR path = (SELECT max(path) FROM snap_a))")
def get_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two chunks by id from a store sorted by id, which the scan finds by its statistics."""
    rows = blobs(spark, sf_dir).select(fn.blob_id(F.col("text")).alias("id"), "size", F.col("text").cast("binary").alias("data")).dropDuplicates(["id"])
    folder = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    store.sorted_by_id(rows).write.parquet(folder)
    a = snapshot(spark, sf_dir, "a")
    ends = a.agg(F.min_by("file_digest", "path"), F.max_by("file_digest", "path")).first()
    return store.get(spark.read.parquet(folder), list(ends)).select("id", "size")


@query(IDS + "SELECT min(id) AS id FROM want WHERE id NOT IN (SELECT id FROM have)")
def fetch_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.first_missing(_want(spark, sf_dir), _have(spark, sf_dir))


@query("""SELECT id, source, CASE source WHEN 'segment' THEN printf('%08d.seg:%d', segment_id, o) WHEN 'legacy' THEN 'objects/' || id END AS place FROM (
SELECT id, segment_id, o, CASE WHEN segment_id IS NOT NULL THEN 'segment' WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'legacy' ELSE 'missing' END AS source
FROM (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS id FROM lineitem) LEFT JOIN (SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_size AS BIGINT) AS segment_id, p_partkey * 10 AS o FROM part WHERE p_partkey % 2 = 0) USING (id))""", "")
def resolve_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = tables.manifests(spark, sf_dir).select("id").distinct()
    kept = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_size").cast("long").alias("segment_id"), (F.col("p_partkey") * 10).alias("offset"))
    legacy = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("objects/"), F.col("p_partkey").cast("string")).alias("path"))
    return store.resolve(refs, kept, legacy)


@query(IDS + "SELECT CAST(count(*) AS BIGINT) AS object_count, CAST(sum(len) AS BIGINT) AS object_bytes FROM want")
def storage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stats(_want(spark, sf_dir).distinct().withColumnRenamed("raw_len", "stored_len"))


PAGING = """, rows AS (SELECT {group} AS grp, {key} AS k, {size} AS n, row_number() OVER (PARTITION BY {group} ORDER BY {key}) AS i FROM {table}),
steps AS (
  SELECT grp, k, n, i, CAST(0 AS BIGINT) AS page, n AS used FROM rows WHERE i = 1
  UNION ALL
  SELECT r.grp, r.k, r.n, r.i, CASE WHEN s.used + r.n > {most} THEN s.page + 1 ELSE s.page END, CASE WHEN s.used + r.n > {most} THEN r.n ELSE s.used + r.n END
  FROM steps s JOIN rows r ON r.grp = s.grp AND r.i = s.i + 1)
"""
FILES = ", files AS (SELECT path, CAST(octet_length(encode(path)) + 64 + 104 * len(string_split(text, chr(10))) + 64 AS BIGINT) AS entry_bytes, split_part(path, '/', 2) AS commit_id FROM blobs)"


@query(FILES + PAGING.format(group="commit_id", key="path", size="entry_bytes", table="files", most=16384) + "SELECT grp AS commit_id, k AS path, n AS entry_bytes, page FROM steps")
def manifest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = blobs(spark, sf_dir).select(F.col("source").alias("commit_id"), "path", fn.blob_id(F.col("text")).alias("file_digest"), F.size(F.split("text", "\n")).alias("n_chunks"))
    return store.manifest_pages(files, 16384)


@query(", packs AS (SELECT sha256(text) AS id, min(size) AS stored_len FROM blobs GROUP BY 1), shards AS (SELECT id, stored_len, CAST(('0x' || substr(id, 1, 2))::INTEGER % 8 AS INTEGER) AS shard FROM packs)" + PAGING.format(group="shard", key="id", size="stored_len", table="shards", most=65536) + "SELECT k AS id, n AS stored_len, grp AS shard, page AS segment, used - n AS place FROM steps")
def segment_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blobs(spark, sf_dir).groupBy(fn.blob_id(F.col("text")).alias("id")).agg(F.min("size").alias("stored_len"))
    return store.segments(rows, 65536, 8)


@query(FILES + """, numbered AS (SELECT path, entry_bytes, row_number() OVER (ORDER BY path) - 1 AS i FROM files),
page AS (SELECT path, i, sum(entry_bytes) OVER (ORDER BY path) AS used FROM numbered WHERE i >= 10)
SELECT path, (SELECT max(i) FROM page WHERE used <= 65536 OR i = 10) < (SELECT max(i) FROM numbered) AS has_more, CAST((SELECT max(i) + 1 FROM page WHERE used <= 65536 OR i = 10) AS INTEGER) AS next_offset
FROM page WHERE used <= 65536 OR i = 10""")
def manifest_page_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = blobs(spark, sf_dir).select(F.lit("c").alias("commit_id"), "path", fn.blob_id(F.col("text")).alias("file_digest"), F.size(F.split("text", "\n")).alias("n_chunks"))
    return store.page_at(files, 10, 65536).select("path", "has_more", "next_offset")


@query("SELECT DISTINCT sha256(text) AS id FROM blobs")
def id_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No batch has more than 64 ids and none is lost."""
    rows = store.batches(blobs(spark, sf_dir).select(fn.blob_id(F.col("text")).alias("id")))
    return rows.select(F.explode(F.when(F.size("ids") <= 64, F.col("ids"))).alias("id"))


@query("""SELECT path, n, id, len, CAST(coalesce(sum(len) OVER (PARTITION BY path ORDER BY n, id, len, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
FROM (SELECT CAST(l_orderkey AS VARCHAR) AS path, CAST(l_partkey AS VARCHAR) AS id, CAST(l_quantity AS BIGINT) AS len, l_linenumber AS n, l_suppkey AS tie FROM lineitem)""", "")
def prefix_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refs(spark, sf_dir)


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("path").orderBy("n", "id", "len", "tie").rowsBetween(Window.unboundedPreceding, -1)
    return tables.manifests(spark, sf_dir).withColumn("offset", F.coalesce(F.sum("len").over(order), F.lit(0))).drop("tie")


# Workspace


def _opening(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    b = snapshot(spark, sf_dir, "b")
    return tables.index_a(spark, sf_dir), b, b.where(patterns.in_view(F.col("path"), ("en/...", "fr/..."), ("en/src0/...",))), tables.disk(spark, sf_dir)


KEEP = """, joined AS (
  SELECT coalesce(i.path, t.path) AS path, i.state, i.file_digest AS old, t.file_digest AS new, t.size, t.path IS NOT NULL AS wanted,
    coalesce(i.path, t.path) IN (SELECT path FROM visible_b) AS seen,
    coalesce(i.state = 'Hydrated' AND i.file_digest = t.file_digest AND coalesce(i.path, t.path) IN (SELECT path FROM disk), FALSE) AS keep
  FROM index_a i FULL JOIN snap_b t ON i.path = t.path)
"""


@query(KEEP + "SELECT path FROM joined WHERE (state = 'Hydrated' AND (NOT wanted OR NOT seen OR old <> new)) OR (wanted AND (NOT seen OR NOT keep))")
def cleanup_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.cleanup_paths(*_opening(spark, sf_dir))


@query(KEEP + "SELECT path, CASE WHEN NOT seen THEN 'NotInView' WHEN keep THEN 'Hydrated' ELSE 'Virtual' END AS state, 'B' AS commit_id, new AS file_digest, size FROM joined WHERE wanted")
def open_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.opened(*_opening(spark, sf_dir), F.lit("B"))


@query("""SELECT i.path, CASE WHEN i.state NOT IN ('Hydrated', 'Dirty') THEN i.state WHEN b.path IS NULL THEN 'Virtual' WHEN b.file_digest = i.file_digest THEN 'Hydrated' ELSE 'Dirty' END AS state, i.commit_id, i.file_digest, i.size
FROM index_a i LEFT JOIN snap_b b USING (path)""")
def dirty_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    disk = snapshot(spark, sf_dir, "b").select("path", "size", F.lit(1).alias("modified"), F.col("file_digest").alias("digest"))
    manifest = snapshot(spark, sf_dir, "a").select("path", "size", F.lit(2).alias("modified"), "file_digest")
    return workspace.refreshed(tables.index_a(spark, sf_dir), disk, manifest)


@query("""SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.file_digest <> b.file_digest THEN 'changed' ELSE 'same' END AS change, a.file_digest AS before, b.file_digest AS after
FROM snap_a a FULL JOIN snap_b b ON a.path = b.path""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.difference(snapshot(spark, sf_dir, "a"), snapshot(spark, sf_dir, "b"))


COUNTS = ", ".join(f"CAST(count(*) FILTER (state = '{s}') AS BIGINT) AS {n}" for s, n in (("Virtual", "virtual"), ("Hydrated", "hydrated"), ("Dirty", "dirty"), ("Pending", "pending"), ("NotInView", "not_in_view")))
SAMPLES = ", ".join(f"coalesce((SELECT string_agg(path, ',' ORDER BY path) FROM (SELECT path FROM index_a WHERE state = '{s}' ORDER BY path LIMIT 10)), '') AS {n}_paths" for s, n in (("Dirty", "dirty"), ("Pending", "pending"), ("NotInView", "not_in_view")))


@query(f"SELECT {COUNTS}, {SAMPLES} FROM index_a")
def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.status(tables.index_a(spark, sf_dir))


@query("""SELECT CAST(row_number() OVER (ORDER BY b.size DESC, b.path) AS INTEGER) AS place, b.path, b.size FROM snap_b b JOIN index_a i USING (path) WHERE i.state NOT IN ('NotInView', 'Hydrated') AND (b.path LIKE 'en/%' OR b.path LIKE 'de/src3/%')""")
def hydrate_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What hydrating en and de/src3 would write, numbered from the largest."""
    files = snapshot(spark, sf_dir, "b").withColumn("chunks", F.array())
    plan = workspace.hydrate_plan(files, tables.index_a(spark, sf_dir), patterns.in_paths(F.col("path"), ("en", "de/src3/")))
    return workspace.numbered(plan.select("path", "size"), "place", F.desc("size"), F.col("path")).select("place", "path", "size")


@query("SELECT CAST(count(*) AS BIGINT) AS hydrated FROM index_a WHERE state = 'Hydrated' OR (state NOT IN ('NotInView') AND path LIKE 'en/%' AND path IN (SELECT path FROM snap_b))")
def hydrate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = tables.index_a(spark, sf_dir)
    return workspace.hydrated_count(workspace.hydrated(index, workspace.to_hydrate(snapshot(spark, sf_dir, "b"), index, patterns.in_paths(F.col("path"), ("en",)))))


@query("SELECT path, CASE WHEN state = 'Hydrated' AND path LIKE 'fr/%' THEN 'Virtual' ELSE state END AS state, commit_id, file_digest, size FROM index_a")
def dehydrate_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.dehydrated(tables.index_a(spark, sf_dir), patterns.in_paths(F.col("path"), ("fr",)))


@query("SELECT path FROM index_a WHERE state = 'Dirty' AND path LIKE 'fr/%'")
def dehydrate_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.dirty(tables.index_a(spark, sf_dir), patterns.in_paths(F.col("path"), ("fr",)))


@query("""SELECT path, CASE WHEN NOT (path LIKE 'en/%') THEN 'NotInView' WHEN path IN (SELECT path FROM disk) THEN 'Hydrated' ELSE 'Virtual' END AS state, 'C' AS commit_id, file_digest, size FROM snap_b
UNION ALL SELECT path, state, commit_id, file_digest, size FROM index_a WHERE path NOT IN (SELECT path FROM snap_b)""")
def materialized_after_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.after_commit(tables.index_a(spark, sf_dir), snapshot(spark, sf_dir, "b"), patterns.in_view(F.col("path"), ("en",)), tables.disk(spark, sf_dir), F.lit("C"))


@query("SELECT DISTINCT regexp_extract(path, '^(.*)/', 1) AS folder FROM snap_b")
def checkout_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.folders(snapshot(spark, sf_dir, "b")).orderBy("folder")


# Integrity


@query("SELECT path, sha256(text) AS file_digest, size FROM blobs")
def reassemble_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files put together again from a store of line chunks, with their line ends."""
    rows = blobs(spark, sf_dir)
    lines = chunking.line_chunks(rows)
    last = lines.groupBy("path").agg(F.max("ordinal").alias("last"))
    parts = lines.join(last, "path").withColumn("data", F.when(F.col("ordinal") < F.col("last"), F.concat("line", F.lit("\n"))).otherwise(F.col("line")).cast("binary")).withColumn("id", F.sha2("data", 256))
    held = parts.groupBy("id").agg(F.first("data").alias("data"))
    return integrity.reassembled(parts.select("path", "id", "offset"), held).select("path", F.sha2("content", 256).alias("file_digest"), F.octet_length("content").cast("long").alias("size"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS path, CAST(l_partkey AS VARCHAR) AS id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)", "")
def fsck_quick(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").cast("string").alias("id"))
    return integrity.missing_chunks(tables.manifests(spark, sf_dir).select("path", "id"), held).select("path", "id")


@query("SELECT min(path) AS path, file_digest FROM snap_a WHERE file_digest IN (SELECT file_digest FROM snap_a WHERE doc_id % 10 = 0) GROUP BY file_digest")
def fsck_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored blob of snapshot A is hashed; those of each tenth document have a character too many: their digests, once each, are wrong."""
    a = snapshot(spark, sf_dir, "a")
    bad = a.where("doc_id % 10 = 0").select("file_digest").distinct().withColumn("bad", F.lit(True))
    held = a.dropDuplicates(["file_digest"]).join(bad, "file_digest", "left").select(F.col("file_digest").alias("id"), F.when(F.col("bad"), F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary").alias("data"))
    refs = a.select("path", F.col("file_digest").alias("id"), F.lit(0).cast("long").alias("offset"))
    return integrity.wrong_files(a, refs, held)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS path, CAST(count(l.l_orderkey) AS BIGINT) AS n_chunks, CAST(coalesce(sum(l_quantity), 0) AS BIGINT) AS total, count(l.l_orderkey) > 0 AS tiles
FROM orders LEFT JOIN lineitem l ON l_orderkey = o_orderkey GROUP BY o_orderkey""", "")
def tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _refs(spark, sf_dir)
    sizes = refs.groupBy("path").agg(F.sum("len").alias("s"))
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path")).join(sizes, "path", "left").select("path", F.coalesce("s", F.lit(-1)).alias("size"))
    return integrity.tiling(refs, files)


# History

COMMITS = """WITH RECURSIVE days AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events),
commits AS (SELECT strftime(d, '%Y-%m-%d') AS id, strftime(lag(d) OVER (ORDER BY d), '%Y-%m-%d') AS parent FROM days),
chain AS (SELECT id, parent, 0 AS depth FROM commits WHERE id = (SELECT max(id) FROM commits)
  UNION ALL SELECT c.id, c.parent, depth + 1 FROM chain JOIN commits c ON c.id = chain.parent)
"""


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("id")).distinct()
    return days.select("id", F.lag("id").over(Window.orderBy("id")).alias("parent"))  # a row a day


def _head(spark: SparkSession, sf_dir: str, back: int = 0) -> str:
    days = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("id")).distinct().orderBy(F.desc("id")).limit(back + 1)
    return min(r["id"] for r in days.collect())


@query(COMMITS + "SELECT id, parent, depth FROM chain", "")
def commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.log(_commits(spark, sf_dir), _head(spark, sf_dir))


@query(COMMITS + "SELECT id, parent, depth FROM chain WHERE depth < 5", "")
def commits_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the head to a known commit, which is left out."""
    return history.log(_commits(spark, sf_dir), _head(spark, sf_dir), stop=_head(spark, sf_dir, 5), most=32)


@query(COMMITS + """, ends AS (SELECT (SELECT id FROM chain WHERE depth = 0) AS new, (SELECT id FROM chain WHERE depth <= 5 ORDER BY depth DESC LIMIT 1) AS old, (SELECT id FROM chain WHERE depth <= 3 ORDER BY depth DESC LIMIT 1) AS gone),
older AS (SELECT c.id FROM chain c, chain o, ends WHERE o.id = ends.old AND c.depth >= o.depth)
SELECT CASE WHEN EXISTS (SELECT 1 FROM chain, ends WHERE chain.id = ends.old) THEN 'yes' ELSE 'no' END AS back, CASE WHEN (SELECT new FROM ends) IN (SELECT id FROM older) THEN 'yes' ELSE 'no' END AS forth,
CASE WHEN EXISTS (SELECT 1 FROM chain g, chain o, ends WHERE g.id = ends.gone AND o.id = ends.old AND g.depth < o.depth) THEN 'unknown' ELSE 'yes' END AS cut""", "")
def is_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the head and the fifth commit before it, both ways; and where a commit between them isn't there."""
    commits, new, old = _commits(spark, sf_dir), _head(spark, sf_dir), _head(spark, sf_dir, 5)
    cut = commits.where(F.col("id") != _head(spark, sf_dir, 3))
    a, b, c = (history.is_ancestor(x, y, z).select(F.col("answer").alias(n)) for x, y, z, n in ((commits, old, new, "back"), (commits, new, old, "forth"), (cut, old, new, "cut")))
    return a.crossJoin(b).crossJoin(c)  # single rows


@query(COMMITS + "SELECT id, parent, depth FROM chain WHERE depth BETWEEN 2 AND 5", "")
def first_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The local side has the two latest commits and those before the sixth."""
    remote, head = _commits(spark, sf_dir), _head(spark, sf_dir)
    local = remote.where((F.col("id") > _head(spark, sf_dir, 2)) | (F.col("id") < _head(spark, sf_dir, 5)))
    return history.first_missing(remote, local, head, 32)


@query("""SELECT source, sha256(coalesce(CASE WHEN source = 'src1' THEN NULL ELSE 'src1' END, 'root') || 'message ' || source || '1700000000' || string_agg(path || sha256(text) || size, '' ORDER BY path)) AS commit_id FROM blobs GROUP BY source""")
def commit_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = F.when(F.col("source") != "src1", F.lit("src1"))
    files = blobs(spark, sf_dir).select(F.col("source").alias("commit"), parent.alias("parent"), F.concat(F.lit("message "), "source").alias("message"), F.lit(1700000000).alias("timestamp"), "path", F.sha2("text", 256).alias("file_digest"), "size")
    return ingest.commit_ids(files).select(F.col("commit").alias("source"), F.col("id").alias("commit_id"))


# Sync


@query(IDS + "SELECT 'h' AS new_head, CAST(1 AS BIGINT) AS commit_count, CAST(count(*) AS BIGINT) AS chunk_count FROM want WHERE id NOT IN (SELECT id FROM have)")
def push_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = chunking.line_chunks(blobs(spark, sf_dir))
    files = lines.groupBy("path").agg(F.collect_list(F.struct("id")).alias("chunks")).withColumn("commit_id", F.lit("h"))
    chain = spark.createDataFrame([("h",)], "id string")
    return sync.push_report(chain, sync.push_chunks(files, chain, _have(spark, sf_dir)), "h")


@query(IDS + "SELECT DISTINCT id FROM lines WHERE (path LIKE 'en/%' OR path LIKE 'fr/src1/%') AND id NOT IN (SELECT id FROM have)")
def pull_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = chunking.line_chunks(blobs(spark, sf_dir))
    files = lines.groupBy("path").agg(F.collect_list(F.struct("id")).alias("chunks"), F.sum("len").alias("size"))
    return sync.to_fetch(files, _have(spark, sf_dir), ("en", "fr/src1"))


@query("SELECT path, size FROM (SELECT regexp_replace(regexp_replace(path, '^en/src1', 'code/x'), '^en/', 'config/') AS path, size FROM snap_b) WHERE (path LIKE 'code/%' OR (path LIKE 'config/%' AND NOT path LIKE 'config/src2/%')) AND size <= 262144")
def remote_manifest_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hot files are code and config: here the English documents."""
    files = snapshot(spark, sf_dir, "b").withColumn("path", F.regexp_replace(F.regexp_replace("path", "^en/src1", "code/x"), "^en/", "config/"))
    return sync.visible_manifest(files, ("code/...", "config/...", "de/..."), ("config/src2/...",), hot_only=True).select("path", "size")


# Locks and access

OPS = """WITH RECURSIVE ops AS (SELECT 'p' || CAST(user_id % 50 AS VARCHAR) AS path, 'u' || CAST(user_id AS VARCHAR) AS owner,
  CASE WHEN event_type IN ('purchase', 'error') THEN 'unlock' ELSE 'lock' END AS op, event_id AS seq FROM events WHERE event_type <> 'view'),
numbered AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq, owner, op) AS i FROM ops),
steps AS (
  SELECT path, seq, op, owner, i, CASE WHEN op = 'lock' THEN 'ok' ELSE 'mismatch' END AS outcome, CASE WHEN op = 'lock' THEN owner END AS holder FROM numbered WHERE i = 1
  UNION ALL
  SELECT n.path, n.seq, n.op, n.owner, n.i,
    CASE WHEN n.op = 'lock' THEN CASE WHEN s.holder IS NULL OR s.holder = n.owner THEN 'ok' ELSE 'conflict' END WHEN s.holder = n.owner THEN 'ok' ELSE 'mismatch' END,
    CASE WHEN n.op = 'lock' THEN coalesce(s.holder, n.owner) WHEN s.holder = n.owner THEN NULL ELSE s.holder END
  FROM steps s JOIN numbered n ON n.path = s.path AND n.i = s.i + 1)
"""


def lock_ops(events: DataFrame) -> DataFrame:
    op = F.when(F.col("event_type").isin("purchase", "error"), locks.UNLOCK).otherwise(locks.LOCK)
    rows = events.where("event_type <> 'view'")
    return rows.select(F.concat(F.lit("p"), (F.col("user_id") % 50).cast("string")).alias("path"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("owner"), op.alias("op"), F.col("event_id").alias("seq"))


@query(OPS + "SELECT path, seq, op, owner, outcome, holder FROM steps", "")
def lock_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locks.replay(lock_ops(table(spark, sf_dir, "events")))


@query(OPS + "SELECT path, holder AS owner FROM steps QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1 AND holder IS NOT NULL AND path LIKE 'p1%'", "")
def list_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locks.listed(locks.held(locks.replay(lock_ops(table(spark, sf_dir, "events")))), "p1")


@query("""WITH RECURSIVE tries AS (SELECT 'r' || CAST(user_id % 10 AS VARCHAR) AS repo, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS expected, event_type AS new FROM events),
numbered AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY seq) AS i FROM tries),
steps AS (SELECT repo, seq, expected, new, i, expected = '' AS ok, CASE WHEN expected = '' THEN new ELSE '' END AS head FROM numbered WHERE i = 1
  UNION ALL SELECT n.repo, n.seq, n.expected, n.new, n.i, s.head = n.expected, CASE WHEN s.head = n.expected THEN n.new ELSE s.head END FROM steps s JOIN numbered n ON n.repo = s.repo AND n.i = s.i + 1)
SELECT repo, seq, expected, new, ok, head FROM steps""", "")
def head_cas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return locks.compare_and_set(rows.select(F.concat(F.lit("r"), (F.col("user_id") % 10).cast("string")).alias("repo"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")).alias("expected"), F.col("event_type").alias("new")))


PEOPLE = """WITH identities AS (SELECT 't' || c_custkey AS token, c_name AS identity FROM customer WHERE c_custkey % 4 <> 0),
acl AS (SELECT n_name AS repo, c_name AS identity, CASE c_custkey % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'write' ELSE 'admin' END AS access FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0)
"""


def _people(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    who = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    identities = who.where("c_custkey % 4 <> 0").select(F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("token"), F.col("c_name").alias("identity"))
    access = F.element_at(F.array(*map(F.lit, ("read", "write", "admin"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    acl = who.where("c_acctbal > 0").select(F.col("n_name").alias("repo"), F.col("c_name").alias("identity"), access.alias("access"))
    asks = who.select(F.col("n_name").alias("repo"), F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("token"), F.when(F.col("c_custkey") % 2 == 0, "read").otherwise("write").alias("asked"))
    return identities, acl, asks


@query(PEOPLE + """SELECT r.repo, r.token, r.asked, i.identity, CASE WHEN i.identity IS NULL THEN 'unauthenticated' WHEN a.access IN ('admin', 'write') OR (a.access = 'read' AND r.asked = 'read') THEN 'ok' ELSE 'denied' END AS verdict
FROM (SELECT n_name AS repo, 't' || c_custkey AS token, CASE WHEN c_custkey % 2 = 0 THEN 'read' ELSE 'write' END AS asked FROM customer JOIN nation ON n_nationkey = c_nationkey) r
LEFT JOIN identities i USING (token) LEFT JOIN acl a ON a.repo = r.repo AND a.identity = i.identity""", "")
def authorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    identities, acl, asks = _people(spark, sf_dir)
    return locks.authorized(asks.withColumnRenamed("asked", "access"), identities, acl).withColumnRenamed("access", "asked").select("repo", "token", "asked", "identity", "verdict")


@query(PEOPLE + "SELECT 'unknown user' AS problem, identity AS subject FROM acl WHERE identity NOT IN (SELECT identity FROM identities) UNION ALL SELECT 'duplicate token', token FROM (SELECT token FROM identities UNION ALL SELECT 't1') GROUP BY token HAVING count(*) > 1", "")
def acl_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    identities, acl, _ = _people(spark, sf_dir)
    return locks.problems(identities.unionByName(spark.createDataFrame([("t1", "again")], "token string, identity string")), acl)


@query(PEOPLE + """SELECT c.c_custkey, i.token, i.identity FROM customer c LEFT JOIN identities i ON c.c_custkey % 3 > 0 AND i.token = 't' || c.c_custkey""", "")
def whoami(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who asks, by the token in a header; every third header is of another kind."""
    identities, _, _ = _people(spark, sf_dir)
    n = F.col("c_custkey")
    asks = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.when(n % 3 > 0, "Bearer ").otherwise("Basic "), F.lit("t"), n.cast("string")).alias("header"))
    return locks.whoami(asks, identities).select("c_custkey", F.when(F.col("identity").isNotNull(), F.col("token")).alias("token"), "identity")


@query("""SELECT n_name AS endpoint, CASE WHEN n_nationkey % 2 = 0 THEN 'c' || n_nationkey ELSE 'any' END AS credential FROM nation""", "")
def credentials_by_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    kept = nations.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("endpoint"), F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("credential"))
    return locks.with_credentials(nations.select(F.col("n_name").alias("endpoint")), kept.unionByName(spark.createDataFrame([(None, "any")], "endpoint string, credential string")))


@query("""SELECT path AS asked, CASE WHEN doc_id % 4 = 1 THEN NULL WHEN doc_id % 4 = 3 AND n > 1 THEN NULL ELSE repo END AS repo,
CASE WHEN doc_id % 4 = 1 THEN 'the path leads out of the root: ' || path WHEN doc_id % 4 = 3 AND n > 1 THEN 'no such repository: ' || base END AS error
FROM (SELECT doc_id, repo, base, n, CASE doc_id % 4 WHEN 0 THEN '/' || repo || '//' WHEN 1 THEN repo || '/../x' WHEN 2 THEN replace(repo, '/', chr(92)) ELSE base END AS path
  FROM (SELECT doc_id, lang || '/' || source || CASE WHEN doc_id % 8 = 7 THEN '' ELSE '/' || doc_id END AS repo, CASE WHEN doc_id % 8 = 7 THEN source ELSE CAST(doc_id AS VARCHAR) END AS base FROM documents)
  JOIN (SELECT base, count(DISTINCT repo) AS n FROM (SELECT lang || '/' || source || CASE WHEN doc_id % 8 = 7 THEN '' ELSE '/' || doc_id END AS repo, CASE WHEN doc_id % 8 = 7 THEN source ELSE CAST(doc_id AS VARCHAR) END AS base FROM documents) GROUP BY base) USING (base))""", "")
def served_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a server finds for the path a client asks by: in full, with turned slashes, out of the root, or by the last name alone, which more than one may have."""
    n = F.col("doc_id") % 8
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat("lang", F.lit("/"), "source", F.when(n == 7, F.lit("")).otherwise(F.concat(F.lit("/"), F.col("doc_id").cast("string")))).alias("r"))
    asked = F.when(n % 4 == 0, F.concat(F.lit("/"), "r", F.lit("//"))).when(n % 4 == 1, F.concat("r", F.lit("/../x"))).when(n % 4 == 2, F.translate("r", "/", "\\")).otherwise(F.substring_index("r", "/", -1))
    return locks.served(rows.select(asked.alias("asked")), rows.select(F.col("r").alias("repo")))


# Scalars


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name || ':t' || c_custkey END AS line FROM customer""", "")
def credential_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.when(F.col("c_custkey") % 7 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" t"), F.col("c_custkey").cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", fn.credential_line(F.col("c_name"), token).alias("line"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 5 = 1 AND trim(c_name) = '' THEN NULL ELSE c_name END AS identity, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 't' || c_custkey END AS token FROM customer""", "")
def token_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit(": "))).otherwise(F.concat(F.lit(" "), "c_name", F.lit(" : t"), F.col("c_custkey").cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", fn.token_pair(text).alias("p")).select("c_custkey", "p.identity", "p.token")


@query("""SELECT url, CASE WHEN u LIKE 'cws%' THEN 'https' WHEN u LIKE 'https%' THEN 'https' WHEN u LIKE 'ftp%' THEN NULL ELSE 'http' END || '://' || split_part(u[strpos(u, '://') + 3:], '/', 1) AS endpoint,
CASE WHEN u LIKE 'ftp%' THEN NULL ELSE trim(u[strpos(u, '://') + 3 + strpos(u[strpos(u, '://') + 3:], '/'):], '/') END AS repo, CASE WHEN u LIKE 'ftp%' THEN 'no way to reach scheme ftp' END AS error
FROM (SELECT url, CASE page_id % 3 WHEN 0 THEN 'cws' || regexp_replace(url, '^[a-z]+', '') WHEN 1 THEN 'ftp' || regexp_replace(url, '^[a-z]+', '') ELSE url END AS u FROM pages)""", "")
def parse_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.regexp_replace("url", "^[a-z]+", "")
    source = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("cws"), rest)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("ftp"), rest)).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("url", fn.remote_parts(source).alias("p")).select("url", "p.endpoint", "p.repo", "p.error")


@query("""SELECT path, substr(sha256(text), 1, 12) AS short, regexp_extract(path, '[^/]*$') AS base, 'txt' AS suffix, path || ' has ' || CASE WHEN size = 1 THEN '1 byte' ELSE size || ' bytes' END AS said, regexp_extract(path, '[^/]*$') AS clone FROM blobs""")
def path_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return blobs(spark, sf_dir).select("path", fn.short_id(fn.blob_id(F.col("text"))).alias("short"), patterns.basename(path).alias("base"), fn.last_suffix(patterns.basename(path)).alias("suffix"), F.concat(path, F.lit(" has "), fn.plural(F.col("size"), "byte")).alias("said"), fn.clone_name(F.concat(F.lit("file:///x/"), path, F.lit("/"))).alias("clone"))


@query("SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'remote' ELSE 'local' END AS kind, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '/' || path ELSE path END AS local FROM blobs")
def classify_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    way = F.col("doc_id") % 3
    source = F.when(way == 0, F.concat(F.lit("cw://host/"), "path")).when(way == 1, F.concat(F.lit("file:///"), "path")).otherwise(F.col("path"))
    return blobs(spark, sf_dir).select("path", fn.source_kind(source).alias("kind"), fn.local_path(source).alias("local"))


# Reports


@query("SELECT count(*) FILTER (state = 'Virtual') || ' virtual, ' || count(*) FILTER (state = 'Hydrated') || ' hydrated, ' || count(*) FILTER (state = 'Dirty') || ' changed, 0 pending, ' || count(*) FILTER (state = 'NotInView') || ' outside the view' AS text FROM index_a")
def show_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.status_counts(workspace.status(tables.index_a(spark, sf_dir)))


@query(COMMITS + "SELECT depth, id || CASE WHEN depth = 0 THEN ' (head)' ELSE '' END AS line FROM chain", "")
def show_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = _head(spark, sf_dir)
    return reporting.log_lines(history.log(_commits(spark, sf_dir), head), head)


@query(LINES + """, n AS (SELECT CAST(count(DISTINCT id) AS BIGINT) AS c, (SELECT CAST(sum(len) AS BIGINT) FROM (SELECT DISTINCT id, len FROM lines)) AS b, (SELECT count(*) FROM documents) AS d FROM lines)
SELECT c || ' chunks, ' || b || ' bytes stored, ' || CAST(round(b / c) AS BIGINT) || ' bytes a chunk, 0 bytes on disk' || chr(10) || d || ' commits, 0 without files' AS text FROM n""")
def show_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = store.stats(_want(spark, sf_dir).distinct().withColumnRenamed("raw_len", "stored_len"))
    commits = table(spark, sf_dir, "documents").agg(F.count("*").alias("commits"))
    return reporting.stats_text(stats.crossJoin(commits).withColumn("metadata_only", F.lit(0)).withColumn("disk_bytes", F.lit(0).cast("long")))  # single rows


@query("""SELECT CASE WHEN count(*) = 0 THEN 'nothing is wrong' ELSE count(*) || CASE WHEN count(*) = 1 THEN ' problem' ELSE ' problems' END || ', first ' || min(path) || ': ' || min_by(id, (path, id)) END AS text
FROM (SELECT CAST(l_orderkey AS VARCHAR) AS path, CAST(l_partkey AS VARCHAR) AS id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5))""", "")
def show_fsck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.fsck_text(fsck_quick(spark, sf_dir).withColumnRenamed("id", "subject"))


@query("SELECT 'commit A' || chr(10) || 'in view: en/... fr/src1/..., but for *.bin' || chr(10) || count(*) FILTER (state = 'Virtual') || ' virtual, ' || count(*) FILTER (state = 'Hydrated') || ' hydrated, ' || count(*) FILTER (state = 'Dirty') || ' changed'"
       " || chr(10) || 'changed:' || chr(10) || '  ' || (SELECT string_agg(path, chr(10) || '  ' ORDER BY path) FROM (SELECT path FROM index_a WHERE state = 'Dirty' ORDER BY path LIMIT 10)) || CASE WHEN count(*) FILTER (state = 'Dirty') > 10 THEN chr(10) || '  and ' || (count(*) FILTER (state = 'Dirty') - 10) || ' more' ELSE '' END"
       " || chr(10) || 'outside the view:' || chr(10) || '  ' || (SELECT string_agg(path, chr(10) || '  ' ORDER BY path) FROM (SELECT path FROM index_a WHERE state = 'NotInView' ORDER BY path LIMIT 10)) || CASE WHEN count(*) FILTER (state = 'NotInView') > 10 THEN chr(10) || '  and ' || (count(*) FILTER (state = 'NotInView') - 10) || ' more' ELSE '' END AS text FROM index_a")  # fmt: skip
def show_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.status_text(workspace.status(tables.index_a(spark, sf_dir)).withColumn("commit_id", F.lit("A")), ("en/...", "fr/src1/..."), ("*.bin",))


@query("""SELECT l_returnflag, list_sort(list(CAST(l_quantity AS BIGINT)))[CAST(count(*) // 2 + 1 AS INTEGER)] AS median FROM lineitem GROUP BY l_returnflag""", "")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.upper_median(table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("value")), "l_returnflag")


# Streams


@query(OPS + "SELECT path, seq, op, owner, outcome, holder FROM steps", "")
def lock_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same outcomes as of lock_replay, from a stream over the table's files."""
    return streaming.drained(streaming.lock_outcomes(lock_ops(streaming.stream(spark, f"{sf_dir}/events.parquet"))), shared_folder(spark))


@query(LINES + "SELECT DISTINCT id, len AS raw_len FROM lines")
def chunk_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = streaming.stream(spark, f"{sf_dir}/documents.parquet").select(tables.doc_path().alias("path"), "text")
    return streaming.new_chunks(texts, shared_folder(spark)).select("id", "raw_len")


# What is left of the scalars and small aggregates


@query("""SELECT path, 'x/' || path AS below, CASE WHEN doc_id % 2 = 0 THEN path END AS head, doc_id % 3 = 0 AS is_head, CASE WHEN doc_id % 5 = 0 THEN 't' || doc_id END AS token, printf('%08d.seg', doc_id) AS segment,
CAST(greatest(doc_id * 1000 - 5000, 0) AS BIGINT) AS seconds FROM blobs""")
def file_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths below a root with slashes turned, trimmed heads, the head's alias, bearer tokens, segment names and times in seconds."""
    path, n = F.col("path"), F.col("doc_id")
    return blobs(spark, sf_dir).select(
        "path",
        fn.relative(F.concat(F.lit("\\srv\\work\\x\\"), F.translate(path, "/", "\\")), "/srv/work/").alias("below"),
        fn.nonblank(F.when(n % 2 == 0, F.concat(F.lit(" "), path, F.lit(" "))).otherwise("  ")).alias("head"),
        fn.is_head(F.when(n % 3 == 0, "HeAd").otherwise(path)).alias("is_head"),
        fn.bearer(F.concat(F.when(n % 5 == 0, "Bearer ").otherwise("Basic "), F.lit("t"), n.cast("string"))).alias("token"),
        fn.segment_name(n).alias("segment"),
        fn.modified_seconds(F.timestamp_seconds(n * 1000 - 5000)).alias("seconds"),
    )


@query(COMMITS + "SELECT id, parent, TRUE AS files_omitted FROM commits", "")
def commit_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits as they are kept of history: without their files."""
    rows = _commits(spark, sf_dir).withColumn("files", F.array(F.lit("a"))).withColumn("files_omitted", F.lit(False))
    return sync.metadata_only(rows)


@query("SELECT CAST(count(*) AS BIGINT) AS commits, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS metadata_only, CAST(count(*) FILTER (o_orderstatus <> 'O') AS BIGINT) AS complete FROM orders", "")
def commit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "O").alias("files_omitted"))
    return rows.agg(F.count("*").alias("commits"), F.count_if("files_omitted").alias("metadata_only"), F.count_if(~F.col("files_omitted")).alias("complete"))


@query("SELECT CAST(max(p_size) AS BIGINT) AS segment_id FROM part", "")
def last_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.last_segment(table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("segment_id")))


@query("SELECT path, size FROM blobs WHERE path LIKE 'en/%' AND NOT path LIKE 'en/src3/%'")
def remote_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A remote's files in view."""
    return sync.visible_manifest(blobs(spark, sf_dir), ("en/...",), ("en/src3/...",)).select("path", "size")


@query(LINES + "SELECT path, CAST(count(*) AS BIGINT) AS n_chunks, CAST(sum(len) AS BIGINT) AS raw_len, string_agg(substr(id, 1, 4), '' ORDER BY ordinal) AS marks FROM lines GROUP BY path")
def chunk_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's references in order, as a commit keeps them."""
    refs = chunking.refs(chunking.line_chunks(blobs(spark, sf_dir)))
    total = F.aggregate("chunks", F.lit(0).cast("long"), lambda n, c: n + c["raw_len"])
    return refs.select("path", F.size("chunks").cast("long").alias("n_chunks"), total.alias("raw_len"), F.array_join(F.transform("chunks", lambda c: F.substring(c["id"], 1, 4)), "").alias("marks"))
