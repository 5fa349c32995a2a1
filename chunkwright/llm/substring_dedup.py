"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest; what repeats is cut out.

A chunk ends where the hash of the last WINDOW characters has a zero field, so an insertion shifts no chunk but those
it touches. A chunk that a document with a smaller id has, too (by a digest of 128 bits), is looked up in the first such document.
Neighbouring chunks that are neighbours there, too, are a run; a run grows to both sides as far as the two texts are equal, at
most MOST characters, and is cut out if it then has MIN_RUN characters: a passage of that length is cut up to its real ends,
wherever chunks happen to lie, if it holds one whole chunk whose first document has the passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from . import common

#: Characters: least, most; one in EXPECTED characters beyond the least ends a chunk. About 46 on average.
LEAST, EXPECTED, MOST = 16, 32, 256
#: Characters that the boundary condition sees.
WINDOW = 16
#: Shorter repeated runs stay: single lines, names of licences and chance repeats. About 20 words.
MIN_RUN = 128
#: A cut's border moves to a space no farther than this, so that no part of a word is cut.
NEAR = 24
#: Characters that one step of the hash holds at once.
SLICE = 1 << 16

SPAN = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


def boundaries(codes: np.ndarray) -> np.ndarray:
    """Where the gear hash of the characters up to and with the one before lets a chunk end.

    Each character's value is shifted left by its distance and added up; the sum over WINDOW characters is made by
    doubling. The field tested is the window's upper bits, which every character in it reaches.
    """
    found = []
    for at in range(0, len(codes), SLICE):
        part = codes[max(0, at - WINDOW + 1) : at + SLICE]
        h = (part.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        step = 1
        while step < WINDOW:
            h[step:] += h[:-step] << np.uint32(step)  # the right side is made before it is added
            step *= 2
        hit = np.flatnonzero(((h >> np.uint32(WINDOW - 5)) & np.uint32(EXPECTED - 1)) == 0) + (at - min(at, WINDOW - 1)) + 1
        found.append(hit[hit > at])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunk_ends(text: str) -> list[int]:
    """Ends of the chunks of ``text`` in code points; the last is its length, an empty text has none."""
    if not text:
        return []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ends, start, size = [], 0, len(codes)
    for at in boundaries(codes).tolist():
        while at - start > MOST:
            start += MOST
            ends.append(start)
        if at - start >= LEAST:
            start = at
            ends.append(at)
    while size - start > MOST:
        start += MOST
        ends.append(start)
    if start < size:
        ends.append(size)
    return ends


ROW = f"{common.OWN}row"


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.withColumn(ROW, F.xxhash64("doc_id", common.text_of()))


def chunks(docs: DataFrame) -> DataFrame:
    """``high``, ``low`` (a digest), ``doc_id``, ``row`` (a hash of id and text) and ``place`` (512 times the start, plus the length) of each chunk; no shuffle."""
    schema = "high long, low long, doc_id long, row long, place long"
    common.small_batches(docs.sparkSession)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for whole in batches:
            for at in range(0, whole.num_rows, common.STEP):
                part = whole.slice(at, common.STEP)
                digests, places, counts = [], [], []
                for text in part["text"].to_pylist():
                    ends, codes, start = chunk_ends(text), memoryview(text.encode("utf-32-le", "surrogatepass")), 0
                    for end in ends:
                        digests.append(digest(codes[4 * start : 4 * end]))
                        start = end
                    ends = np.array(ends, np.int64)
                    starts = np.r_[np.zeros(min(1, len(ends)), np.int64), ends[:-1]]
                    places.append(starts * 512 + ends - starts)
                    counts.append(len(ends))
                both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                owner = pa.array(np.repeat(np.arange(part.num_rows), counts))
                columns = [pa.array(both[:, 0]), pa.array(both[:, 1]), part["doc_id"].take(owner), part["row"].take(owner), pa.array(np.concatenate(places))]
                yield pa.RecordBatch.from_arrays(columns, ["high", "low", "doc_id", "row", "place"])

    return _numbered(docs).select(F.col("doc_id").cast("long"), F.col(ROW).alias("row"), common.text_of().alias("text")).mapInArrow(found, schema)


def _later() -> F.Column:
    return F.col("doc_id").isNotNull() & (F.col("first").isNull() | (F.col("first") < F.col("doc_id")))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """Computed once: ``doc_id``, ``row``, ``a``, ``b`` (a run of chunks in that row's text), ``of``, ``of_row``, ``at`` (the same run in the first document's text).

    First the digests that several documents have (added up before the shuffle, so a chunk of every document is one row a
    task), then each chunk is looked up among them, then the chunks of one row are joined to runs. All shuffle numbers, no text.
    """
    held, tasks = chunks(docs), common.tasks_for(docs.sparkSession, common.input_rows(docs))
    known = held.groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("unknown"))
    known = known.where((F.col("first") < F.col("last")) | F.col("unknown") & F.col("first").isNotNull()).select("high", "low", F.when(~F.col("unknown"), F.col("first")).alias("first"))
    hits = common.checkpointed(held.join(common.apart(known, "high"), ["high", "low"]), tasks)
    origin = hits.where(F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("high", "low").agg(F.min(F.struct("row", "place")).alias("o"))
    origin = origin.select("high", "low", F.col("o.row").alias("of_row"), F.col("o.place").alias("at"))
    again = hits.where(_later()).join(common.apart(origin, "high"), ["high", "low"]).groupBy("doc_id", "row").agg(F.collect_list(F.struct("place", "first", "of_row", "at")).alias("chunks"))

    def joined(batch: list) -> Iterable[tuple]:
        for doc_id, row, parts in batch:
            run = None
            for x in sorted(parts, key=lambda x: x["place"]):
                a, n, of, at = x["place"] >> 9, x["place"] & 511, (x["first"], x["of_row"]), x["at"] >> 9
                if run and run[1] == a and run[2:4] == of and run[4] + a - run[0] == at:
                    run = run[0], a + n, *run[2:]
                else:
                    if run:
                        yield doc_id, row, *run
                    run = a, a + n, *of, at
            yield doc_id, row, *run

    return common.checkpointed(common.map_rows(again, joined, "doc_id long, row long, a int, b int, of long, of_row long, at int"), tasks)


def _equal(x: Iterable[str], y: Iterable[str]) -> int:
    """How many characters of ``x`` and ``y`` are equal before the first that differs."""
    n = 0
    for p, q in zip(x, y):  # noqa: B905  up to the shorter one's end
        if p != q:
            break
        n += 1
    return n


def grown(text: str, runs: list, min_run: int) -> list[tuple[int, int]]:
    """Spans of ``text``: ``runs`` (a, b, before, after: what stands around the run in the first document) grown to both sides as far as it is the same there; those of ``min_run`` characters, joined."""
    out: list[tuple[int, int]] = []
    for a, b, before, after in runs:
        a, b = a - _equal(reversed(text[max(0, a - MOST) : a]), reversed(before)), b + _equal(text[b : b + MOST], after)
        if b - a >= min_run:
            out.append((a, b))
    joined: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if joined and a <= joined[-1][1]:
            joined[-1] = joined[-1][0], max(b, joined[-1][1])
        else:
            joined.append((a, b))
    return joined


def at_words(text: str, a: int, b: int) -> tuple[int, int]:
    """The span without spaces and parts of words at its borders; where a border has no space near, it stays."""
    if a > 0 and (m := re.match(r"\S*\s+" if re.match(r"\S\S", text[a - 1 : a + 1]) else r"\s+", text[a : a + NEAR])):
        a += m.end()
    if b < len(text) and (m := re.search(r"\s+\S*$" if re.match(r"\S\S", text[b - 1 : b + 1]) else r"\s+$", text[b - NEAR : b])):
        b -= m.end() - m.start()
    return a, b


def substring_dedup(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """``docs`` with ``text`` cut (where anything is) and three more columns, whose names start with ``__llm_``: ``removed`` (array
    of start, end in the old text, at whole words), ``removed_chars`` and ``before`` (characters).

    Rows of one id are one document: they aren't repeats of each other, nor are passages within one. Null ids come before
    all others and are one document. Null texts stay null. Rows equal in id and text are cut alike. Texts are chunked in slices, so
    their length is bounded by a row's only. An empty table gives no rows. No column may have a name that starts with ``__llm_``.
    """
    own = common.OWN
    runs = repeated_runs(docs)
    texts = _numbered(docs)

    # what stands around each place of a first document where a run starts or ends: each place once, however many have the run
    ends = runs.select(F.col("of").alias(f"{own}of"), F.col("of_row").alias(f"{own}of_row"), F.explode(F.array("at", F.col("at") + F.col("b") - F.col("a"))).alias("end"))
    ends = ends.groupBy(f"{own}of", f"{own}of_row").agg(F.collect_set("end").alias(f"{own}ends"))
    asked = texts.join(ends, texts["doc_id"].eqNullSafe(ends[f"{own}of"]) & (texts[ROW] == ends[f"{own}of_row"]))
    names = ["doc_id", ROW, "text", f"{own}ends"]
    names += [c for c in docs.columns if c not in names]  # all columns, so that this shuffle of the texts is the one that serves for cutting, too

    def around(batch: list) -> Iterable[tuple]:
        for doc_id, row, text, places, *_ in batch:
            yield from ((doc_id, row, p, text[max(0, p - MOST) : p], text[p : p + MOST]) for p in places)

    near = common.map_rows(asked.select(*names), around, "of long, of_row long, place int, before string, after string").dropDuplicates(["of", "of_row", "place"])
    left = near.select(F.col("of").alias("l"), F.col("of_row").alias("l_row"), F.col("place").alias("l_place"), "before")
    right = near.select(F.col("of").alias("r"), F.col("of_row").alias("r_row"), F.col("place").alias("r_place"), "after")
    both = runs.join(left, F.col("of").eqNullSafe(F.col("l")) & (F.col("of_row") == F.col("l_row")) & (F.col("at") == F.col("l_place")))
    both = both.join(right, F.col("of").eqNullSafe(F.col("r")) & (F.col("of_row") == F.col("r_row")) & (F.col("at") + F.col("b") - F.col("a") == F.col("r_place")))
    found = both.groupBy("doc_id", "row").agg(F.collect_list(F.struct("a", "b", "before", "after")).alias(f"{own}runs"))
    found = found.select(F.col("doc_id").alias(f"{own}id"), F.col("row").alias(f"{own}key"), f"{own}runs")

    rows = texts.join(found, texts["doc_id"].eqNullSafe(found[f"{own}id"]) & (texts[ROW] == found[f"{own}key"]), "left").select(*docs.columns, f"{own}runs")
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(f"{own}removed", SPAN), StructField(f"{own}before", LongType()), StructField(f"{own}removed_chars", LongType())])

    def cut(batch: list) -> Iterable[tuple]:
        for *row, runs in batch:
            text = row[at] or ""
            spans = [at_words(text, a, b) for a, b in grown(text, [(x["a"], x["b"], x["before"], x["after"]) for x in runs or ()], min_run)]
            if spans:
                row[at] = "".join(text[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(text)], strict=True))
            yield *row, [{"start": a, "end": b} for a, b in spans], len(text), sum(b - a for a, b in spans)

    return common.map_rows(rows, cut, schema)
