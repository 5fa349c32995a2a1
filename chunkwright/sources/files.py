"""Files of a working tree, in a POSIX folder that driver and executors share: scans, readers and sinks.

Files of any size are read and written piece by piece; no row holds more than a chunk.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import ingest
from ..operators.chunking import Chunker
from .shared import bounded_batches

CONTROL = ".chunkwright"
#: Bytes that are read at once where a file is only hashed.
PIECE = 1 << 22
#: Bytes of chunks that go to Spark at once.
BATCH_BYTES = 1 << 26
PIECES = "path string, ordinal int, offset long, len long, id string, stored_len long, compressed boolean, data binary"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """``path`` below ``root``, ``size``, ``modified`` of each file, empty ones too, but of those of a repository itself. Files aren't read, only listed.

    The driver lists two levels; each folder of the second is walked in a task.
    """
    kinds = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC"))])

    def entries(folder: str) -> Iterator[os.DirEntry]:
        with os.scandir(folder) as found:
            yield from (e for e in found if e.name != CONTROL)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top, deep in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folders, out = [top], []
                while folders:
                    for e in entries(folders.pop()):
                        if e.is_dir(follow_symlinks=False):
                            folders += [e.path] * deep
                        elif e.is_file():
                            out.append((os.path.relpath(e.path, root), e.stat().st_size, e.stat().st_mtime_ns // 1000))
                    if out and (len(out) >= 10_000 or not folders):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds, strict=True)], schema=kinds)
                        out = []

    root = os.path.abspath(root)
    first = [e.path for e in entries(root) if e.is_dir(follow_symlinks=False)]
    second = [e.path for folder in first for e in entries(folder) if e.is_dir(follow_symlinks=False)]
    tasks = [(root, False), *((folder, False) for folder in first), *((folder, True) for folder in second)]
    folders = spark.createDataFrame(tasks, "folder string, deep boolean").repartition(min(len(tasks), 4 * spark.sparkContext.defaultParallelism))
    return folders.mapInArrow(listed, "path string, size long, modified timestamp")


def digests(files: DataFrame, root: str) -> DataFrame:
    """``path``, ``file_digest`` of files (``path``) below ``root``, each read once, a piece at a time. One that is gone has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, found = batch.column(0).to_pylist(), []
            for path in paths:
                digest = hashlib.sha256()
                try:
                    with open(os.path.join(root, path), "rb") as file:
                        while piece := file.read(PIECE):
                            digest.update(piece)
                    found.append(digest.hexdigest())
                except FileNotFoundError:
                    found.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(found, pa.string())], ["path", "file_digest"])

    return files.select("path").mapInArrow(run, "path string, file_digest string")


def packed(data: bytes, level: int = 1) -> tuple[bool, bytes]:
    """Whether compression makes ``data`` shorter, and what is stored; level 0 doesn't compress."""
    import zstandard

    small = zstandard.ZstdCompressor(level=level).compress(data) if level else data
    return (True, small) if len(small) < len(data) else (False, data)


def unpacked(data: bytes, compressed: bool) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data) if compressed else data


def plain_chunks(chunks: DataFrame) -> DataFrame:
    """``id``, ``data`` of stored chunks (``id``, ``data``, ``compressed``) as they were before compression."""
    bounded_batches(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = [unpacked(x, c) for x, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plain, pa.binary())], ["id", "data"])

    return chunks.select("id", "data", "compressed").mapInArrow(run, "id string, data binary")


def cut_files(files: DataFrame, root: str, chunker: Chunker, large: int = schemas.LARGE_FILE, window: int = schemas.LARGE_WINDOW, level: int = 1) -> DataFrame:
    """Chunks, with what is to be stored of them, of files (``path``, ``size``, ``way``, ``file_digest`` and ``chunks``, their former references), each read once.

    A small file is one chunk. By former boundaries chunks are cut as they were as far as they end within the file, and the rest by
    ``chunker``. From ``large`` bytes on a file is read and cut ``window`` by ``window``. One that has changed since it was hashed is an error.
    """
    bounded_batches(files.sparkSession)
    kinds = pa.schema([("path", pa.string()), ("ordinal", pa.int32()), ("offset", pa.int64()), ("len", pa.int64()), ("id", pa.string()), ("stored_len", pa.int64()), ("compressed", pa.bool_()), ("data", pa.binary())])

    def pieces(file, size: int, way: str, former: list) -> Iterator[bytes]:  # noqa: ANN001
        at = 0
        if way == ingest.SMALL:
            yield file.read()
            return
        for c in former if way == ingest.BOUNDARIES else ():
            if c["offset"] != at or at + c["len"] > size:
                break
            yield file.read(c["len"])
            at += c["len"]
        step = window if size >= large else size
        while at < size or not size:
            data = file.read(min(step, size - at))
            for start, end in zip([0, *(ends := chunker.ends(data))], ends):
                yield data[start:end]
            at += len(data)
            if not data:
                break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for row in batch.to_pylist():
                digest, at = hashlib.sha256(), 0
                with open(os.path.join(root, row["path"]), "rb") as file:
                    for n, data in enumerate(pieces(file, row["size"], row["way"], row["chunks"] or [])):
                        digest.update(data)
                        compressed, stored = packed(data, level)
                        out.append((row["path"], n, at, len(data), hashlib.sha256(data).hexdigest(), len(stored), compressed, stored))
                        at, held = at + len(data), held + len(stored)
                        if held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds, strict=True)], schema=kinds)
                            out, held = [], 0
                if digest.hexdigest() != row["file_digest"]:
                    raise ValueError(f"changed while it was read: {row['path']}")
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds, strict=True)], schema=kinds)

    return files.select("path", "size", "way", "file_digest", "chunks").mapInArrow(run, PIECES)


def _streams(parts: DataFrame) -> DataFrame:
    """Chunks dealt by file, the largest file first, each file's in order."""
    bounded_batches(parts.sparkSession)
    return parts.select("path", "size", "file_digest", "offset", "data", "compressed").repartition("path").sortWithinPartitions(F.desc("size"), "path", "offset")


def content_digests(parts: DataFrame) -> DataFrame:
    """``path``, ``file_digest`` (as it should be), ``found`` (that of the bytes) of files whose chunks (``path``, ``size``, ``file_digest``, ``offset``, ``data``, ``compressed``) pass as a stream; a chunk without data counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, out = None, hashlib.sha256(), []
        for batch in batches:
            for row in batch.to_pylist():
                if now is not None and now != (row["path"], row["file_digest"]):
                    out.append((*now, digest.hexdigest()))
                    digest = hashlib.sha256()
                now = row["path"], row["file_digest"]
                digest.update(unpacked(row["data"], row["compressed"]) if row["data"] is not None else b"")
        if now is not None:
            out.append((*now, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], ["path", "file_digest", "found"])

    return _streams(parts).mapInArrow(run, "path string, file_digest string, found string")


def write_chunks(parts: DataFrame, root: str, verify: bool = True) -> int:
    """Write files below ``root`` from their chunks (as of ``content_digests``). A file appears whole or not at all, so a task that is run again
    does no harm; one whose bytes haven't its digest is an error, and doesn't appear. Returns how many were written."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, digest, count = None, None, None, 0

        def done() -> None:
            out.close()
            if verify and digest.hexdigest() != now[1]:
                os.remove(out.name)
                raise ValueError(f"wrong bytes: {now[0]}")
            os.replace(out.name, os.path.join(root, now[0]))

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or row["path"] != now[0]:
                    if now is not None:
                        done()
                    now, digest, count = (row["path"], row["file_digest"]), hashlib.sha256(), count + 1
                    to = os.path.join(root, row["path"])
                    os.makedirs(os.path.dirname(to), exist_ok=True)
                    out = open(f"{to}.{os.getpid()}.part", "wb")  # noqa: SIM115  closed by done
                data = unpacked(row["data"], row["compressed"])
                out.write(data)
                digest.update(data)
        if now is not None:
            done()
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["n"])

    return _streams(parts).mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def make_folders(files: DataFrame, root: str) -> int:
    """Make the folders of ``files`` (``path``) below ``root``, each once; returns how many there are."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                os.makedirs(os.path.join(root, folder), exist_ok=True)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return folders(files).mapInArrow(make, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def folders(files: DataFrame) -> DataFrame:
    """``folder``: the folders that files (``path``) are in, each once."""
    return files.select(F.regexp_extract("path", "^(.*)/", 1).alias("folder")).distinct()


def delete_files(paths: DataFrame, root: str) -> int:
    """Delete the files; one that is gone already is no error."""

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    os.remove(os.path.join(root, path))
                except FileNotFoundError:
                    pass
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return paths.select("path").mapInArrow(drop, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
