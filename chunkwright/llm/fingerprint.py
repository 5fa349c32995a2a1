"""Document fingerprints: threshold-scaled sketches of shingle hashes, in DataFrame functions only.

A sketch keeps every hash of a five-word shingle below a fixed fraction of the hash range, so sketches of
very unequal documents stay comparable and a union of sketches is the sketch of the union. Where none
lies below, the smallest is kept, so that short texts have a sketch too; it takes no part in containment.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORDS = 5
#: One in so many shingle hashes is kept.
SCALE = 8
#: Documents for one range of ids, and the most ranges there are.
DOCS_A_RANGE = 4_000
MOST_RANGES = 1 << 16
LEAST = -(1 << 63)
SEPARATOR = "[^\\p{L}\\p{N}]+"


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), SEPARATOR), lambda w: w != "")


def shingle_hashes(text: Column, size: int = WORDS) -> Column:
    """A 64-bit hash for each run of ``size`` words; fewer words are one shingle, no word none."""
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))

    def over(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - size, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))
        return F.when(F.size(h) > 0, runs).otherwise(F.array().cast("array<bigint>"))

    return F.element_at(F.transform(F.array(hashes), over), 1)


def sketch(text: Column, scale: int = SCALE, size: int = WORDS) -> Column:
    """Ascending distinct kept hashes."""
    most = LEAST + (1 << 64) // scale

    def keep(h: Column) -> Column:
        low = F.filter(h, lambda x: x < F.lit(most))
        return F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).when(F.size(h) > 0, F.array(F.array_min(h))).otherwise(h)

    return F.element_at(F.transform(F.array(shingle_hashes(text, size)), keep), 1)


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts' shingles together."""
    both = F.array_sort(F.array_union(a, b))
    low = F.filter(both, lambda x: x < F.lit(LEAST + (1 << 64) // scale))
    return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))


def resemblance(a: Column, b: Column) -> Column:
    """Estimate of the share of shingles in both among those in either; two empty sketches are alike."""
    shared = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - shared
    return F.when(either == 0, F.lit(1.0)).otherwise(shared / either)


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimate of the share of ``a``'s shingles that are in ``b``, from ``a``'s hashes below the threshold, all of which ``b``'s sketch has if the text does.

    An empty sketch is in any other; a sketch without a hash below the threshold tells nothing: null."""
    low = F.filter(a, lambda x: x < F.lit(LEAST + (1 << 64) // scale))
    return F.when(F.size(a) == 0, F.lit(1.0)).when(F.size(low) > 0, F.size(F.array_intersect(low, b)) / F.size(low))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ",")


def with_next(rows: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    """Add ``columns`` of the next row by ``doc_id`` (after the last: the first) as ``prefix`` + name.

    Ids are cut into ranges of about DOCS_A_RANGE rows at approximate quantiles; an id that very many rows have is several of them, and its rows
    are dealt to its ranges by a hash of the text. The first row of each range is also put at the end of the range before it: one shuffle of the
    rows, no global sort. The driver sees three numbers for each range. Equal ids are ordered by a hash of their text, null ids come first.
    """
    own = common.OWN
    key, tie = F.col(f"{own}key"), F.col(f"{own}tie")
    rows = rows.withColumn(f"{own}key", F.coalesce("doc_id", F.lit(LEAST))).withColumn(f"{own}tie", F.xxhash64("text"))
    count = common.input_rows(rows.select(f"{own}key"))
    ranges = min(MOST_RANGES, max(1, count // DOCS_A_RANGE))
    cuts = rows.agg(F.percentile_approx(f"{own}key", [k / ranges for k in range(1, ranges)], 20 * ranges).alias("q")).first()["q"] if ranges > 1 else []
    steps = [1 << k for k in reversed(range(max(1, len(cuts or [])).bit_length()))]
    padded = [*sorted(cuts or []), *[(1 << 63) - 1] * (2 * steps[0] - 1 - len(cuts or []))]
    bounds = F.split(F.lit(",".join(map(str, padded))), ",").cast("array<bigint>")

    def cuts_below(holds: Callable) -> Column:  # by halving
        return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, step: F.when(holds(F.get(bounds, low + step - 1)), low + step).otherwise(low))

    low, high = cuts_below(lambda cut: cut < key), cuts_below(lambda cut: cut <= key)
    share = (tie.cast("double") / float(1 << 64) + 0.5) * (high - low)  # which of its ranges a row of an id has that is a cut
    rows = rows.withColumn(f"{own}range", F.when(high > low, low + 1 + F.least(F.floor(share).cast("int"), high - low - 1)).otherwise(low))
    firsts = sorted((r[0], r[1][0], r[1][1]) for r in rows.groupBy(f"{own}range").agg(F.min(F.struct(key, tie))).collect())
    before = [(k, t, firsts[n - 1][0]) for n, (_, k, t) in enumerate(firsts)]
    heads = rows.sparkSession.createDataFrame(before, f"{own}key long, {own}tie long, {own}before int")
    again = rows.join(F.broadcast(heads), [f"{own}key", f"{own}tie"]).withColumn(f"{own}range", F.col(f"{own}before")).drop(f"{own}before")
    both = rows.withColumn(f"{own}again", F.lit(False)).unionByName(again.withColumn(f"{own}again", F.lit(True)))
    by = Window.partitionBy(f"{own}range").orderBy(f"{own}again", key, tie)
    led = both.select("*", *[F.lead(c).over(by).alias(prefix + c) for c in columns]).where(~F.col(f"{own}again"))
    return led.drop(f"{own}key", f"{own}tie", f"{own}range", f"{own}again")


def fingerprints(docs: DataFrame, scale: int = SCALE, size: int = WORDS) -> DataFrame:
    """``doc_id``, ``n_chars``, ``sketch`` (array of hashes), ``fingerprint`` for each row; no shuffle.

    A null or empty text, or one without a word, has an empty sketch; repeated rows are taken each.
    """
    rows = docs.select("doc_id", common.text_of().alias("text")).select("doc_id", F.char_length("text").cast("long").alias("n_chars"), sketch(F.col("text"), scale, size).alias("sketch"))
    return rows.withColumn("fingerprint", as_text(F.col("sketch")))


def against_edit(docs: DataFrame, scale: int = SCALE, size: int = WORDS) -> DataFrame:
    """Fingerprints of each document and of its edit, whose last quarter is the start of the next document.

    Null texts are empty; an empty text's edit is empty, and two texts without words are alike. Equal ids are
    ordered by a hash of their text; a table's only document is its own next one; an empty table gives no rows.
    """
    rows = docs.select("doc_id", common.text_of().alias("text"))
    rows = with_next(rows.withColumn("sketch", sketch(F.col("text"), scale, size)), ["text", "sketch"], "next_")
    n, quarter = F.char_length("text"), F.floor(F.char_length("text") / 4).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter)))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", "next_sketch", sketch(F.col("edited"), scale, size).alias("edited_sketch"))
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(a).alias("fingerprint"), as_text(b).alias("edited_fingerprint"),
        resemblance(a, b).alias("near_edited"), resemblance(a, c).alias("near_next"), containment(a, b, scale).alias("held_by_edited"), containment(a, c, scale).alias("held_by_next"),
    )
