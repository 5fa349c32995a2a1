"""Walks along the chain of commits (``id``, ``parent``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHAIN = "id string, parent string, depth int"
#: Up to so many commits (about 30 MB of ids) are taken to the driver.
SMALL = 200_000


def log(commits: DataFrame, head: str | None, stop: str | None = None, most: int | None = None) -> DataFrame:
    """``id``, ``parent``, ``depth`` from ``head`` back, to a commit that is missing, one that was met before, or ``stop`` (not with it).

    A recursive query would cost a job a step. Up to SMALL commits are walked on the driver, which gets two ids for each; of more
    the reach doubles, see ``walk``.
    """
    spark = commits.sparkSession
    if head is None:
        return empty_chain(spark)
    pairs = commits.select("id", "parent").limit(SMALL + 1).collect()
    if len(pairs) > SMALL:
        return walk(commits, head, stop, most)
    parent, chain, met = {r["id"]: r["parent"] for r in pairs}, [], set()
    now = head
    while now in parent and now not in met and now != stop and len(chain) < (SMALL if most is None else most):
        met.add(now)
        chain.append((now, parent[now], len(chain)))
        now = parent[now]
    return spark.createDataFrame(chain, CHAIN)


def walk(commits: DataFrame, head: str, stop: str | None = None, most: int | None = None) -> DataFrame:
    """``log`` for chains of any length: the (id, parent) pairs double their reach until the chain's end is found.

    After k rounds a row of ``jump`` leads 2^k commits back; rows on the chain are found from those known by one join a round, so
    that a million commits take 20 rounds. A chain that comes back to itself ends with the first commit met again.
    """
    from ..sources.shared import cut_lineage

    jump = commits.select("id", "parent").dropDuplicates(["id"])
    jump = cut_lineage(jump if stop is None else jump.where(F.col("id") != stop))
    found = jump.where(F.col("id") == head).select("id", F.lit(0).cast("long").alias("depth"))
    hops, reach, met = jump.select("id", F.col("parent").alias("to")), 1, 0
    while True:
        ahead = found.join(hops, "id").where(F.col("to").isNotNull()).select(F.col("to").alias("id"), (F.col("depth") + reach).alias("depth"))
        ahead = ahead.join(jump.select("id"), "id", "left_semi")
        found = cut_lineage(found.unionByName(ahead).groupBy("id").agg(F.min("depth").alias("depth")))
        now = found.count()
        if now == met or most is not None and now >= most:
            break
        met, reach = now, reach * 2
        hops = cut_lineage(hops.alias("a").join(hops.alias("b"), F.col("a.to") == F.col("b.id")).select("a.id", "b.to"))
    if most is not None:
        found = found.where(F.col("depth") < most)
    return found.join(jump, "id").select("id", "parent", F.col("depth").cast("int").alias("depth"))


def is_ancestor(commits: DataFrame, ancestor: str, descendant: str) -> DataFrame:
    """One row, ``answer``: yes, no, or unknown where the chain breaks off at a missing parent first. A commit is its own ancestor."""
    chain = log(commits, descendant)
    seen = chain.agg(F.count_if(F.col("id") == ancestor).alias("found"), F.count("*").alias("n"), F.max_by("parent", "depth").alias("end"))
    known = seen.join(commits.select(F.col("id").alias("end")).distinct().withColumn("there", F.lit(True)), "end", "left")
    answer = F.when(F.col("found") > 0, "yes").when((F.col("n") == 0) | F.col("end").isNotNull() & F.col("there").isNull(), "unknown").otherwise("no")
    return known.select(answer.alias("answer"))


def first_missing(remote: DataFrame, local: DataFrame, head: str, most: int | None = None) -> DataFrame:
    """The commits to bring over: ``head``'s chain from its first commit that ``local`` lacks, up to the next one it has, ``most`` at most."""
    chain = log(remote, head, most=most)
    have = local.select("id").distinct().withColumn("have", F.lit(True))
    rows = chain.join(have, "id", "left")
    start = rows.where(F.col("have").isNull()).agg(F.min("depth").alias("start"))
    end = rows.where(F.col("have")).join(start, F.col("depth") > F.col("start")).agg(F.min("depth").alias("end"))
    limits = start.join(end, F.lit(True), "left")  # two single rows
    return rows.join(F.broadcast(limits), (F.col("depth") >= F.col("start")) & ((F.col("depth") < F.col("end")) | F.col("end").isNull())).where(F.col("have").isNull()).select("id", "parent", "depth")


def empty_chain(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CHAIN)
