"""Exact top-k search by inner product: branch and bound over dimension blocks in vertical layout.

Vectors are dealt to a grid of (candidate block, query block) cells. In a cell the candidates lie dimension by
dimension. Scores grow one block of dimensions at a time; a candidate whose score so far plus the most
that the remaining mass can add (Cauchy-Schwarz) is below the query's k-th best is compacted away. Each query comes with a bound from the
longest vectors of all, so a cell that can't reach it does nothing, and no cell returns what can't be among the best.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

K = 20
#: Rows of a candidate block and of a query block.
CANDIDATES, QUERIES = 16_384, 2_048
#: Dimensions in one step.
BLOCK = 16
#: Longest vectors that give each query its first bound, for each result asked for.
SEEDS = 4
#: Up to this magnitude sums of products are whole numbers that a double holds exactly, for up to 512 dimensions.
EXACT = 1 << 22
#: Scaled components are below this.
LARGEST = float(1 << 62)
RESULT = "query_id long, query long, own long, vec_id long, score long"


def usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def whole_numbers(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """``vec_id`` and floor(scale * x) of each component; a row with a null id, vector or component, or a non-finite one, goes."""
    rows = embeddings.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))

    def whole(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < LARGEST, F.floor(y)).otherwise(F.raise_error(F.lit("a component doesn't fit 64 bits")))

    return rows.select("vec_id", F.transform("embedding", whole).alias("v"))


def search(ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: int, bounds: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query (candidates' ids, scores) of its k best by (score descending, id ascending), but those below its bound."""
    if not len(ids) or not len(q):
        yield from ((ids[:0], ids[:0]) for _ in q)
        return
    exact = max(np.abs(x).max(initial=0), np.abs(q).max(initial=0)) <= EXACT
    if not exact:  # plain integers of any size
        table = [[int(c) for c in row] for row in x]
        for row in q:
            row = [int(c) for c in row]
            best = heapq.nsmallest(k, ((-sum(a * b for a, b in zip(row, c, strict=True)), int(i)) for c, i in zip(table, ids, strict=True)))
            yield np.array([i for _, i in best], object), np.array([-s for s, _ in best], object)
        return
    order = np.argsort(-np.abs(x).sum(0), kind="stable")  # heavy dimensions first
    by_id = np.argsort(ids, kind="stable")
    ids, dims, q = ids[by_id], np.ascontiguousarray(x[by_id][:, order].T, np.float64), q[:, order].astype(np.float64)
    starts = range(0, len(dims), BLOCK)
    mass = np.sqrt(np.array([np.square(dims[s:]).sum(0) for s in starts]).reshape(-1, len(ids)))
    query_mass = np.sqrt(np.array([np.square(q[:, s:]).sum(1) for s in starts]).reshape(-1, len(q)))
    seeds = np.argsort(-mass[0], kind="stable")[: 4 * k] if len(mass) else np.arange(0)
    for at, row in enumerate(q):
        bound = -np.inf if bounds is None else bounds[at]
        score, alive, least = np.zeros(len(ids)), None, bound
        if len(mass) and query_mass[0, at] * mass[0].max() < least - 1e-3 - 1e-12 * abs(least):
            yield ids[:0], ids[:0]
            continue
        if len(ids) > 8 * k and len(seeds) > k:
            least = max(least, np.partition(row @ dims[:, seeds], -k)[-k])
        for b, s in enumerate(starts):
            part = dims[s : s + BLOCK] if alive is None else dims[s : s + BLOCK, alive]
            score = score + row[s : s + BLOCK] @ part
            if b + 1 < len(starts) and least > -np.inf:
                rest = query_mass[b + 1, at] * (mass[b + 1] if alive is None else mass[b + 1, alive])
                keep = score + rest >= least - 1e-3 - 1e-12 * np.abs(least)  # a bound is a root and may be rounded down
                if keep.mean() < 0.7:
                    alive = np.flatnonzero(keep) if alive is None else alive[keep]
                    score = score[keep]
                    if len(alive) > k and b:  # what has survived raises the bar: lower bounds of the same masses
                        least = max(least, np.partition(score - rest[keep], -k)[-k])
        found = np.arange(len(ids)) if alive is None else alive
        if bound > -np.inf:
            found, score = found[score >= bound], score[score >= bound]
        if len(found) > k:
            bar = np.partition(score, -k)[-k]
            found, score = found[score >= bar], score[score >= bar]
        best = np.lexsort((ids[found], -score))[:k]
        yield ids[found[best]], score[best].astype(np.int64)


def first_bounds(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``queries`` (``vec_id``, ``query``, ``v``, ``times``) with ``bound``: the k-th best score among the longest candidates, a few for each result asked for.

    Null where there are too few, or where doubles don't hold the scores exactly."""
    length = F.aggregate("v", F.lit(0.0), lambda n, x: n + x.cast("double") * x.cast("double"))
    longest = [r["v"] for r in candidates.select(F.col("v").cast("array<double>").alias("v"), length.alias("n")).orderBy(F.desc("n")).limit(SEEDS * k).collect()]
    size = max(map(len, longest), default=0)
    seeds = np.array([[*v, *[0.0] * (size - len(v))] for v in longest], np.float64).reshape(len(longest), size)
    good = len(seeds) >= k and np.abs(seeds).max(initial=0) <= EXACT

    def rows(batch: list) -> Iterator[tuple]:
        for vec_id, query, v, times in batch:
            own = np.array(v)[:size]
            exact = good and np.abs(own).max(initial=0) <= EXACT
            yield vec_id, query, v, times, float(np.partition(seeds[:, : len(own)] @ own, -k)[-k]) if exact else None

    return common.map_rows(queries.select("vec_id", "query", F.col("v").cast("array<double>").alias("v"), "times"), rows, "vec_id long, query long, v array<double>, times long, bound double")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, own_too: bool = False) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of each query's ``k`` best candidates, without the query's own row unless ``own_too``.

    Both inputs have ``vec_id`` and ``v``, whole numbers; shorter vectors count as ending in zeros. All
    candidates are searched, whatever ties there are: ties go to the smaller id. Each row is a query, or a candidate, of its own, those of equal
    id, too: of the rows that equal a query in id and score, one is its own. Queries equal in id and vector are searched once and given back
    as often as they come. A score beyond 64 bits is an error. Blocks are dealt by hash, so no block follows a hot value.
    """
    own = common.OWN
    blocks = 1 + common.input_rows(candidates) // CANDIDATES, 1 + common.input_rows(queries) // QUERIES
    vector, query = F.col("v").cast("array<double>"), F.xxhash64("v")
    asked = queries.groupBy("vec_id", query.alias("query")).agg(F.first("v").alias("v"), F.count("*").alias("times"))
    asked = first_bounds(candidates, asked, k + 1 - own_too)
    left = candidates.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks[0])).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(blocks[1] - 1))).alias("q"), F.lit(None).cast("long").alias("query"), "vec_id", vector.alias("v"), F.lit(None).cast("double").alias("bound"))
    right = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks[0] - 1).cast("long"))).alias("c"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks[1])).cast("int").alias("q"), "query", "vec_id", "v", "bound")
    cells = left.unionByName(right).groupBy("c", "q")

    def run(cell: pa.Table) -> pa.Table:
        asks = np.array(cell.column("query").is_valid().to_pylist(), bool)
        ids = cell.column("vec_id").to_numpy()
        vectors = cell.column("v").combine_chunks()
        lengths, flat = np.diff(vectors.offsets.to_numpy()), vectors.flatten().to_numpy(zero_copy_only=False)
        x = np.zeros((len(ids), lengths.max(initial=0)))
        x[np.arange(x.shape[1]) < lengths[:, None]] = flat
        bounds = np.array([-np.inf if b is None else b for b in cell.column("bound").to_pylist()])[asks]
        out = list(search(ids[~asks], x[~asks], x[asks], k + 1 - own_too, bounds))
        counts, numbers = [len(got) for got, _ in out], [q for q in cell.column("query").to_pylist() if q is not None]
        selves = [sum(int(c) * int(c) for c in row) if not own_too else 0 for row in x[asks]]
        return pa.table(
            {
                "query_id": pa.array(np.repeat(ids[asks], counts), pa.int64()),
                "query": pa.array(np.repeat(np.array(numbers, np.int64), counts)),
                "own": pa.array([s for s, n in zip(selves, counts, strict=True) for _ in range(n)], pa.int64()),
                "vec_id": pa.array([int(i) for got, _ in out for i in got], pa.int64()),
                "score": pa.array([int(s) for _, got in out for s in got], pa.int64()),
            }
        )

    best = Window.partitionBy("query_id", "query")
    place = F.row_number().over(best.orderBy(F.desc("score"), "vec_id"))
    rows = cells.applyInArrow(run, RESULT).withColumn("rank", place).where(F.col("rank") <= k + 1 - own_too)
    if not own_too:
        rows = rows.withColumn("me", F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("rank"))).over(best))
        rows = rows.where(F.col("me").isNull() | (F.col("rank") != F.col("me"))).withColumn("rank", F.when(F.col("rank") > F.col("me"), F.col("rank") - 1).otherwise(F.col("rank"))).where(F.col("rank") <= k)
    again = asked.where("times > 1").select(F.col("vec_id").alias("a"), F.col("query").alias("b"), "times")
    rows = rows.join(again, (F.col("query_id") == F.col("a")) & (F.col("query") == F.col("b")), "left")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("times", F.lit(1).cast("long")))))
    return rows.select("query_id", "rank", "vec_id", "score")


def embeddings_top_k(embeddings: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``; candidates are all rows but the query's own.

    An empty table, or one without a usable vector, gives no rows. Other columns are ignored.
    """
    vectors = whole_numbers(embeddings)
    return top_k(vectors, vectors.where(F.col("vec_id") % every == 0), k)
