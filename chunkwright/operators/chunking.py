"""Chunkers: fixed size, lines and content-defined, over blobs (``path``, ``content``).

Each gives ``path``, ``ordinal``, ``offset``, ``len``, ``id``, in bytes; an empty blob is one chunk of no length. The
content-defined one is written after the FastCDC paper: a gear hash, a stricter mask before the average size and a
looser one after it, a least and a most.

A ``Chunker`` says where a blob is cut; ``chunked`` applies any of them.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas

CHUNKS = "path string, ordinal int, offset long, len long, id string"


#: A value for each byte; any fixed random table does.
GEAR = np.random.default_rng(3).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Bytes that the hash sees, and that one step of it holds at once.
WINDOW, SLICE = 32, 1 << 22


@dataclasses.dataclass(frozen=True)
class Sizes:
    least: int = schemas.CHUNK_MIN
    average: int = schemas.CHUNK_AVG
    most: int = schemas.CHUNK_MAX


def fixed_chunks(blobs: DataFrame, size: int) -> DataFrame:
    """Cut every ``size`` bytes, JVM-side."""
    n = F.octet_length("content")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(n.cast("long") - 1, F.lit(0)), F.lit(size).cast("long"))
    rows = blobs.select("path", "content", F.posexplode(starts).alias("ordinal", "offset"))
    data = F.substring(F.col("content"), (F.col("offset") + 1).cast("int"), F.lit(size))
    return rows.select("path", "ordinal", "offset", F.octet_length(data).cast("long").alias("len"), F.sha2(data, 256).alias("id"))


def line_chunks(texts: DataFrame) -> DataFrame:
    """One chunk a line of a text (``path``, ``text``), without its line end; offsets count the ends. JVM-side.

    Offsets are running sums over a path's lines; where nobody asks for them there is no shuffle."""
    rows = texts.select("path", F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))
    rows = rows.select("path", "ordinal", F.octet_length("line").cast("long").alias("len"), F.sha2("line", 256).alias("id"), "line")
    before = Window.partitionBy("path").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(F.col("len") + 1).over(before), F.lit(0))).select("path", "ordinal", "offset", "len", "id", "line")


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the 32 bytes up to it; a window over the whole blob, so it doesn't start anew at a cut."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h


def marks(data: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where the hash lets a chunk end, by the looser mask and by the stricter one; a slice at a time."""
    loose, strict = [], []
    for at in range(0, len(data), SLICE):
        start = max(0, at - WINDOW + 1)
        h = gear(data[start : at + SLICE])[at - start :]
        hit = np.flatnonzero((h >> np.uint32(max(0, 32 - bits + 1))) == 0)
        loose.append(hit + at + 1)
        strict.append(hit[(h[hit] >> np.uint32(max(0, 32 - bits - 1))) == 0] + at + 1 if bits < 31 else hit + at + 1)
    return np.concatenate(loose), np.concatenate(strict)


def cut(data: bytes, sizes: Sizes, window: int | None = None) -> list[int]:
    """Ends of the chunks of ``data``; with ``window`` also cut at each multiple of it (for very large blobs)."""
    n = len(data)
    if not n:
        return [0]
    if window and n > window:
        return [at + end for at in range(0, n, window) for end in cut(data[at : at + window], sizes)]
    loose, strict = marks(np.frombuffer(data, np.uint8), max(1, int(sizes.average).bit_length() - 1))
    ends, start = [], 0
    while start < n:
        stop = min(n, start + sizes.most)
        middle = min(stop, start + sizes.average)
        i = np.searchsorted(strict, start + sizes.least)
        if i < len(strict) and strict[i] < middle:
            stop = int(strict[i])
        else:
            i = np.searchsorted(loose, max(middle, start + sizes.least))
            if i < len(loose) and loose[i] < stop:
                stop = int(loose[i])
        ends.append(stop)
        start = stop
    return ends


class Chunker(Protocol):
    """Says where a blob is cut: ends of its chunks, the last is its length (an empty one has the end 0)."""

    def ends(self, data: bytes) -> list[int]: ...


@dataclasses.dataclass(frozen=True)
class Fixed:
    size: int

    def ends(self, data: bytes) -> list[int]:
        return [*range(self.size, len(data), self.size), len(data)]


@dataclasses.dataclass(frozen=True)
class Lines:
    """A line with its end is a chunk."""

    def ends(self, data: bytes) -> list[int]:
        out = (np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1).tolist()
        return out if out and out[-1] == len(data) else [*out, len(data)]


@dataclasses.dataclass(frozen=True)
class Gear:
    """Content-defined; from ``large`` bytes on also cut at each multiple of ``window``."""

    sizes: Sizes = Sizes()
    large: int = schemas.LARGE_FILE
    window: int = schemas.LARGE_WINDOW

    def ends(self, data: bytes) -> list[int]:
        return cut(data, self.sizes, self.window if len(data) >= self.large else None)


def chunked(blobs: DataFrame, chunker: Chunker, small: int = -1) -> DataFrame:
    """``blobs`` (``path``, ``content``) cut by ``chunker``; a blob of up to ``small`` bytes is one chunk, whose id is the blob's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_py() or b""
                ends = [len(data)] if len(data) <= small else chunker.ends(data)
                for n, (start, end) in enumerate(zip([0, *ends], ends)):
                    out.append((path.as_py(), n, start, end - start, hashlib.sha256(data[start:end]).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["path", "ordinal", "offset", "len", "id"])

    return blobs.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, CHUNKS)


def content_chunks(blobs: DataFrame, sizes: Sizes = Sizes(), small: int = schemas.SMALL_FILE, large: int = schemas.LARGE_FILE, window: int = schemas.LARGE_WINDOW) -> DataFrame:
    """Content-defined chunks with their ids; a blob of up to ``small`` bytes is one chunk."""
    return chunked(blobs, Gear(sizes, large, window), small)


def refs(chunks: DataFrame) -> DataFrame:
    """``path``, ``chunks``: the references of each blob in order."""
    ref = F.struct("ordinal", "id", "offset", "len", F.col("len").alias("raw_len"))
    rows = chunks.groupBy("path").agg(F.array_sort(F.collect_list(ref)).alias("c"))
    return rows.select("path", F.transform("c", lambda c: F.struct(c["id"].alias("id"), c["offset"].alias("offset"), c["len"].alias("len"), c["raw_len"].alias("raw_len"))).alias("chunks"))


def reused_prefix(chunks: Column, size: Column) -> Column:
    """Of a file's former chunks those that end within its new size, up to the first that doesn't."""
    beyond = F.array_position(F.transform(chunks, lambda c: c["offset"] + c["len"] <= size), False)
    return F.when(beyond == 0, chunks).otherwise(F.slice(chunks, F.lit(1), F.greatest(beyond - 1, F.lit(0)).cast("int")))


def resume_offset(chunks: Column, size: Column) -> Column:
    kept = reused_prefix(chunks, size)
    return F.when(F.size(kept) > 0, F.element_at(kept, -1)["offset"] + F.element_at(kept, -1)["len"]).otherwise(F.lit(0))


def boundary_reuse(blobs: DataFrame, previous: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """Chunks of grown or shrunk blobs: the former boundaries (``previous``: ``path``, ``chunks``) as far as they go, content-defined
    ones for the rest. Former chunks are hashed anew, for a boundary is reused by its place alone."""
    rows = blobs.join(previous, "path").withColumn("n", F.octet_length("content").cast("long"))
    rows = rows.withColumn("at", resume_offset(F.col("chunks"), F.col("n")))
    kept = rows.select("path", "content", F.explode(reused_prefix(F.col("chunks"), F.col("n"))).alias("c"))
    data = F.substring(F.col("content"), (F.col("c.offset") + 1).cast("int"), F.col("c.len").cast("int"))
    kept = kept.select("path", F.col("c.offset").alias("offset"), F.col("c.len").alias("len"), F.sha2(data, 256).alias("id"))
    rest = rows.where("at < n").select("path", F.substring(F.col("content"), (F.col("at") + 1).cast("int"), (F.col("n") - F.col("at")).cast("int")).alias("content"))
    rest = content_chunks(rest, sizes, small=-1).join(rows.select("path", "at"), "path").select("path", (F.col("offset") + F.col("at")).alias("offset"), "len", "id")
    return kept.unionByName(rest)


def same_as_before(blobs: DataFrame, previous: DataFrame) -> DataFrame:
    """``path``, ``same``: the former chunks tile the blob and each still has its id."""
    c = F.explode("chunks").alias("c")
    rows = blobs.join(previous, "path").select("path", "content", F.octet_length("content").cast("long").alias("n"), c)
    data = F.substring(F.col("content"), (F.col("c.offset") + 1).cast("int"), F.col("c.len").cast("int"))
    rows = rows.select("path", "n", F.col("c.offset").alias("offset"), F.col("c.len").alias("len"), (F.sha2(data, 256) == F.col("c.id")).alias("ok"))
    from .integrity import tiling

    return tiling(rows.select("path", "offset", "len"), rows.groupBy("path").agg(F.max("n").alias("size"))).join(rows.groupBy("path").agg(F.bool_and("ok").alias("ok")), "path").select("path", (F.col("tiles") & F.col("ok")).alias("same"))
