"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is a sequence of words and of their five-word shingles. Each of BANDS hash functions picks its TUPLE least
occurrence-labelled shingles; they, in the text's order, are a bucket. Two texts are alike if an alignment of their words,
in a band as wide as ALIKE allows, matches ALIKE of the longer one's words. Links' components are the classes.

All texts go the same way, whatever the size of their buckets:

1. Of the first FIRST functions, each text is compared with the centre (the one with the least key) of its bucket and length. A
   text is in its length's class and in the next, and two lengths that ALIKE allows share one. Copies of one text, edited
   or not, become one class here.
2. Of all functions, each text is compared with the centre of its bucket's least class, if that isn't its own, and with its
   neighbours in the bucket, in the order of another function's bucket, length and key, that are of another class.

Pairs grow in proportion to the rows of a bucket, and no task holds a bucket. Texts so short that an edit leaves them no shingle aren't found.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

WORDS = 5
#: Words of the longer text that an alignment must match.
ALIKE = 0.8
BANDS, FIRST, TUPLE = 24, 8, 2
#: Words that one step of an alignment takes of each text where no shingle ties them.
PIECE = 1 << 14
#: Texts for one task.
TEXTS_A_TASK = 16_000

WORD = re.compile(r"\w+")
#: Fixed odd factors and seeds of the hash functions.
SEEDS = np.random.default_rng(11).integers(1, 1 << 63, BANDS, dtype=np.uint64)
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * FACTOR
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str) -> np.ndarray:
    """A 32-bit hash of each word, a run of letters, digits and underscores in lower case."""
    import xxhash

    one = xxhash.xxh32_intdigest
    return np.fromiter((one(w) for w in WORD.findall(text.lower())), np.uint32)


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words; fewer words are one shingle, no word none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    runs = max(1, len(words) - size + 1)
    out = np.full(runs, np.uint64(min(len(words), size)))
    for k in range(min(size, len(words))):
        out = mixed(out * np.uint64(3) + words[k : k + runs])
    return out


def labelled(shingle: np.ndarray) -> np.ndarray:
    """Each shingle with the number of equal ones before it."""
    order = np.argsort(shingle, kind="stable")
    sorted_ = shingle[order]
    new = np.r_[True, sorted_[1:] != sorted_[:-1]]
    if new.all():
        return shingle
    place = np.arange(len(shingle))
    before = np.empty(len(shingle), np.uint64)
    before[order] = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)
    return np.where(before > 0, mixed(shingle ^ (before * FACTOR)), shingle)


def order_minhash(shingle: np.ndarray, size: int = TUPLE) -> np.ndarray:
    """One 64-bit bucket for each function: its number and its ``size`` least labelled shingles, in the text's order."""
    marks = labelled(shingle)
    places = np.empty((len(SEEDS), min(size, len(marks))), np.int64)
    for f, seed in enumerate(SEEDS):
        values = (marks ^ seed) * (seed | np.uint64(1))
        values ^= values >> np.uint64(32)
        values *= FACTOR
        for k in range(places.shape[1]):
            places[f, k] = least = values.argmin()
            values[least] = np.uint64(0xFFFFFFFFFFFFFFFF)
    places.sort(axis=1)
    out = np.arange(1, len(SEEDS) + 1, dtype=np.uint64)
    for k in range(places.shape[1]):
        out = mixed(out * np.uint64(5) + marks[places[:, k]])
    return out.view(np.int64)


def common_run(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence that stays within ``band`` places of the diagonal.

    Bit-parallel: bit j of a row stands for place low + j of ``b``, a zero for a match gained there; the row's window
    moves by one place with each symbol of ``a``.
    """
    if len(a) > len(b):
        a, b = b, a
    above = len(b) - len(a) + band  # places right of the diagonal, as the longer one's end is in the band, too
    width = band + above + 1
    full, at = (1 << width) - 1, {}
    for j, symbol in enumerate(b.tolist()):
        at[symbol] = at.get(symbol, 0) | 1 << (j + band)
    row, gained = full, 0
    for i, symbol in enumerate(a.tolist()):
        match = at.get(symbol, 0) >> i & full
        row = ((row + (row & match)) | (row & ~match)) & full
        gained += ~row & 1
        row = row >> 1 | 1 << (width - 1)
    return gained + width - row.bit_count()


def chain(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (place in ``a``, place in ``b``, words), in order and apart, from shingles that occur once in each: a longest ascending chain of them."""
    sa, sb = shingles(a), shingles(b)
    (ua, at_a, ca), (ub, at_b, cb) = (np.unique(s, return_index=True, return_counts=True) for s in (sa, sb))
    _, ia, ib = np.intersect1d(ua[ca == 1], ub[cb == 1], assume_unique=True, return_indices=True)
    left, right = at_a[ca == 1][ia], at_b[cb == 1][ib]
    order = np.argsort(left)
    left, right = left[order], right[order]
    if len(right) and np.any(right[1:] < right[:-1]):
        tops: list[int] = []
        ends: list[int] = []
        before = [-1] * len(right)
        for k, j in enumerate(right.tolist()):
            at = bisect_left(tops, j)
            before[k] = ends[at - 1] if at else -1
            tops[at : at + 1], ends[at : at + 1] = [j], [k]
        kept, k = [], ends[-1]
        while k >= 0:
            kept.append(k)
            k = before[k]
        left, right = left[kept[::-1]], right[kept[::-1]]
    runs: list[tuple[int, int, int]] = []
    size = min(WORDS, len(a), len(b))
    breaks = np.flatnonzero((np.diff(left) != np.diff(right)) | (np.diff(left) > size)) + 1 if len(left) else []
    for part in np.split(np.arange(len(left)), breaks):
        if len(part):
            i, j, n = int(left[part[0]]), int(right[part[0]]), int(left[part[-1]] - left[part[0]]) + size
            if runs:
                over = max(0, runs[-1][0] + runs[-1][2] - i, runs[-1][1] + runs[-1][2] - j)
                i, j, n = i + over, j + over, n - over
            if n > 0:
                runs.append((i, j, n))
    return runs


def matched_share(a: np.ndarray, b: np.ndarray, alike: float = ALIKE) -> float:
    """The share of the longer text's words that the alignment matches; where that is below ``alike``, some value below it.

    Equal ends and the chain of shingles that occur once are matched as they are; what lies between is aligned within the band
    that ``alike`` leaves: a path beyond it has more unmatched words than ``alike`` allows. Of more than PIECE words between two ties, equal
    parts are aligned with each other, so time and memory grow with the length; what is matched so is an alignment, too.
    """
    longer = max(len(a), len(b))
    if not min(len(a), len(b)):
        return 0.0
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[len(a) - short + head :] != b[len(b) - short + head :])
    tail = short - head - 1 - int(differ[-1]) if len(differ) else short - head
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    sure, gaps = head + tail, []
    i = j = 0
    for x, y, n in [*(chain(a, b) if len(a) and len(b) else []), (len(a), len(b), 0)]:
        gaps.append((a[i:x], b[j:y]))
        sure, i, j = sure + n, x + n, y + n
    gaps = [(x, y) for x, y in gaps if len(x) and len(y)]
    gaps = [z for x, y in gaps for parts in [1 + min(len(x), len(y)) // PIECE] for z in zip(np.array_split(x, parts), np.array_split(y, parts), strict=True)]
    most = sure + sum(min(len(x), len(y)) for x, y in gaps)
    band = int(longer - np.ceil(alike * longer))
    for x, y in sorted(gaps, key=lambda g: -min(map(len, g))):
        if most < alike * longer:
            break
        most -= min(len(x), len(y))
        (ux, nx), (uy, ny) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
        _, ix, iy = np.intersect1d(ux, uy, assume_unique=True, return_indices=True)
        bound = int(np.minimum(nx[ix], ny[iy]).sum())
        run = common_run(x, y, band) if bound and most + bound >= alike * longer else bound
        most += run
        sure += run
    return min(most, sure) / longer


def sketched(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``key`` (of the text), ``n`` words, ``buckets`` for each row; no shuffle."""

    def rows(batch: list) -> Iterable[tuple]:
        for doc_id, key, text in batch:
            w = word_hashes(text)
            yield doc_id, key, len(w), order_minhash(shingles(w)).tolist() if len(w) else []

    return common.map_rows(docs.select("doc_id", common.text_key().alias("key"), common.text_of().alias("text")), rows, "doc_id long, key binary, n long, buckets array<long>")


def texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``key``, ``words`` (their hashes) of the texts in ``keys`` (``key``, ``doc_id`` of one of its rows)."""
    rows = docs.select("doc_id", common.text_key().alias("key"), common.text_of().alias("text"))
    keys = keys.select(F.col("key").alias("rep_key"), F.col("doc_id").alias("rep")).hint("shuffle_merge")
    # with the id, copies of one text don't meet in one task
    rows = rows.join(keys, F.col("key").eqNullSafe(F.col("rep_key")) & F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")

    def hashed(batch: list) -> Iterable[tuple]:
        for key, text in batch:
            yield key, word_hashes(text).tobytes()

    return common.map_rows(rows.select("key", "text"), hashed, "key binary, words binary").dropDuplicates(["key"])


def verified(pairs: DataFrame, texts: DataFrame, alike: float, tasks: int) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose texts are alike, computed once."""
    rows = pairs.distinct().join(texts.select(F.col("key").alias("b"), F.col("words").alias("wb")), "b").coalesce(tasks).join(texts.select(F.col("key").alias("a"), F.col("words").alias("wa")), "a")

    def judged(batch: list) -> Iterable[tuple]:
        for a, b, wa, wb in batch:
            likeness = matched_share(np.frombuffer(wa, np.uint32), np.frombuffer(wb, np.uint32), alike)
            if likeness >= alike:
                yield a, b, likeness

    return common.checkpointed(common.map_rows(rows.select("a", "b", "wa", "wb"), judged, "u binary, v binary, likeness double"), tasks)


def by_length(rows: DataFrame, alike: float) -> DataFrame:
    """``rows`` (``bucket``, ``n``) in two groups each: of the bucket and the class of ``n`` in a geometric scale of step ``alike``, and of the class below.

    Lengths whose ratio is ``alike`` or more are in the same class or in neighbouring ones."""
    scale = F.floor(F.log(F.col("n").cast("double")) / F.lit(-float(np.log(alike))) + F.lit(1e-9))
    return rows.withColumn("step", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("group", F.xxhash64("bucket", scale + F.col("step"))).drop("step")


def around_centres(rows: DataFrame, alike: float) -> DataFrame:
    """Pairs ``a``, ``b`` of each of ``rows`` (``group``, ``class``, ``key``, ``n``) with its group's centre, where lengths allow it.

    The centre is the least key of the group's least class; rows of that class aren't paired."""
    centre = rows.groupBy("group").agg(F.min(F.struct("class", "key", "n")).alias("c"), F.max("class").alias("last")).where(F.col("c.class") < F.col("last"))
    centre = centre.select(F.col("group").alias("of"), F.col("c.class").alias("least"), F.col("c.key").alias("centre"), F.col("c.n").alias("m"))
    alone = (F.col("class") == F.col("least")) | (F.least("n", "m") < F.greatest("n", "m") * alike)
    return rows.join(common.apart(centre, "of"), (F.col("group") == F.col("of")) & ~alone).select(F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b"))


def beside(rows: DataFrame, alike: float, tasks: int) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a``, ``b`` of neighbours of a group that are of different classes, in the order of ``finer``, ``n``, ``key``.

    The order is made by ranges, so a group of any size is spread over tasks; each task also gives its first and last row, and
    from these, two a task, come the pairs across tasks' borders. The second result is what is kept of the first meanwhile.
    """
    rows = rows.select("group", "finer", "n", "key", "class")
    by = ("group", "finer", "n", "key")
    schema = "a binary, b binary, border int, place int, row struct<group:long,finer:long,n:long,key:binary,class:binary>"

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, last, first = TaskContext.get().partitionId(), None, None
        kinds = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("border", pa.int32()), ("place", pa.int32()), ("row", pa.struct([("group", pa.int64()), ("finer", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("class", pa.binary())]))])
        for batch in batches:
            table = pa.Table.from_batches(([last] if last is not None else []) + [batch]).combine_chunks()
            if first is None:
                first = table.slice(0, 1).to_pylist()[0]
            n, group = table["n"].to_numpy(), table["group"].to_numpy()
            key, of = table["key"].combine_chunks(), table["class"].combine_chunks()
            near = (group[1:] == group[:-1]) & (np.minimum(n[1:], n[:-1]) >= np.maximum(n[1:], n[:-1]) * alike)
            near &= pc.not_equal(of.slice(1), of.slice(0, len(of) - 1)).to_numpy(zero_copy_only=False)
            found = [(key[k].as_py(), key[k + 1].as_py()) for k in np.flatnonzero(near).tolist()]
            if found:
                yield pa.RecordBatch.from_pylist([{"a": min(x), "b": max(x), "border": None, "place": None, "row": None} for x in found], schema=kinds)
            last = table.slice(table.num_rows - 1, 1).to_batches()[0]
        if first is not None:
            yield pa.RecordBatch.from_pylist([{"a": None, "b": None, "border": k, "place": place, "row": row} for k, row in enumerate((first, last.to_pylist()[0]))], schema=kinds)

    ordered = rows.repartitionByRange(tasks, *by).sortWithinPartitions(*by)
    out = ordered.mapInArrow(neighbours, schema).persist()
    edge = sorted(out.where("border IS NOT NULL").select("place", "border", "row").collect(), key=lambda r: (r["place"], r["border"]))  # two rows a task
    across = []
    for x, y in zip(edge[1::2], edge[2::2], strict=False):
        p, q = x["row"], y["row"]
        if p["group"] == q["group"] and p["class"] != q["class"] and min(p["n"], q["n"]) >= max(p["n"], q["n"]) * alike:
            across.append((min(p["key"], q["key"]), max(p["key"], q["key"])))
    return out.where("border IS NULL").select("a", "b").unionByName(rows.sparkSession.createDataFrame(across, "a binary, b binary")), out


def distinct_texts(docs: DataFrame, tasks: int) -> DataFrame:
    """``key``, ``doc_id`` (the least of its rows'), ``copies`` (rows), ``n`` words, ``buckets`` of each different text, computed once."""
    same = [F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("buckets").alias("buckets")]
    return common.checkpointed(sketched(docs).groupBy("key").agg(*same), tasks)


def near_links(docs: DataFrame, texts: DataFrame, alike: float, tasks: int) -> DataFrame:
    """Links ``u``, ``v``, ``likeness`` between keys of different texts, whose components are the classes; see the module for what is compared."""
    place = F.col("place")
    member = texts.select("key", "n", "buckets", F.posexplode("buckets").alias("place", "bucket"))
    member = member.select("key", "n", "bucket", (place < FIRST).alias("early"), F.element_at("buckets", (place + BANDS // 2) % F.size("buckets") + 1).alias("finer"))
    shared = texts.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket")
    member = common.checkpointed(member.join(common.apart(shared, "bucket"), "bucket"), tasks)
    wanted = texts.select("key", "doc_id").join(member.select("key").distinct(), "key", "left_semi")
    words = common.checkpointed(texts_of(docs, wanted), tasks)

    links = verified(around_centres(by_length(member.where("early").withColumn("class", F.col("key")), alike), alike), words, alike, tasks)
    classes = connected_components(links)

    rows = member.join(classes, member["key"] == classes["node"], "left").select("key", "n", F.col("bucket").alias("group"), "finer", F.coalesce("root", "key").alias("class"))
    rows = rows.persist()
    near, kept = beside(rows, alike, tasks)
    new = verified(around_centres(rows, alike).unionByName(near), words, alike, tasks)
    for done in (kept, rows):
        done.unpersist()
    return links.unionByName(new)


def near_classes(docs: DataFrame, alike: float = ALIKE) -> DataFrame:
    """``doc_id``, ``key``, ``class_id`` (the least id of the class), ``n_links`` (verified links of the text that tie its class), ``n_copies``
    (rows of the same text) for each row.

    Rows of equal text, null and empty alike, are one class with no need of a link. A text without a word
    is like its own copies only. Null ids are passed over for ``class_id`` unless the class has no other. Repeated
    rows are given back as often as they come. Texts of any length are sketched and aligned as a whole. Columns other than ``doc_id``
    and ``text`` aren't looked at, whatever their names. An empty table gives no rows.
    """
    tasks = common.tasks_for(docs.sparkSession, common.input_rows(docs), TEXTS_A_TASK)
    texts = distinct_texts(docs, tasks)
    links = near_links(docs, texts, alike, tasks)
    degree = links.select(F.explode(F.array("u", "v")).alias("key")).groupBy("key").agg(F.count("*").alias("n_links"))
    classes = connected_components(links).withColumnRenamed("node", "key")
    texts = texts.select("key", "doc_id", "copies").join(classes, "key", "left").join(degree, "key", "left").withColumn("root", F.coalesce("root", "key"))
    texts = common.checkpointed(texts, tasks)
    ids = texts.where(F.col("root") != F.col("key")).groupBy("root").agg(F.min("doc_id").alias("other"))
    roots = texts.where(F.col("root") == F.col("key")).join(ids, "root", "left").select("root", F.least("doc_id", "other").alias("class_id"))
    texts = texts.join(roots, "root").select("key", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("copies").alias("n_copies"))
    return docs.select("doc_id", common.text_key().alias("key")).join(texts, "key").select("doc_id", "key", "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, alike: float = ALIKE) -> DataFrame:
    """The rows of ``docs`` with the least id of each class, one row each; columns as they come.

    Of a class without any id the row with the least text key stays. Rows equal in id and text are one.
    """
    own = common.OWN
    tasks = common.tasks_for(docs.sparkSession, common.input_rows(docs), TEXTS_A_TASK)
    rows = near_classes(docs, alike).groupBy("class_id", "key", "doc_id").agg(F.count("*").alias("times")).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    group = F.struct(F.col("class_id").isNull(), F.col("class_id"), F.when(F.col("class_id").isNull(), F.col("key")))
    best = rows.groupBy(group.alias("g")).agg(F.min(F.struct("key", "doc_id", "times")).alias("b"))
    # nearly as many as there are documents, so they are joined by a shuffle at every size
    best = common.checkpointed(best.select(F.col("b.key").alias(f"{own}key"), F.col("b.doc_id").alias(f"{own}id"), F.col("b.times").alias(f"{own}times")), tasks)
    texts = docs.withColumn(f"{own}k", common.text_key())
    kept = texts.join(best.hint("shuffle_merge"), F.col(f"{own}k").eqNullSafe(F.col(f"{own}key")) & texts["doc_id"].eqNullSafe(F.col(f"{own}id")))
    again = F.col(f"{own}times") > 1
    if best.where(again).isEmpty():
        return kept.select(*docs.columns)
    return kept.where(~again).unionByName(kept.where(again).dropDuplicates([f"{own}k", "doc_id"])).select(*docs.columns)
