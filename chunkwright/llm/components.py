"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROWS_A_TASK = 100_000


def _lower(links: DataFrame, parts: int) -> DataFrame:
    """Link each node's larger neighbours to the least of the node and its neighbours (large star)."""
    both = links.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(common.apart(least, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(parts).distinct().coalesce(parts)


def _tie(links: DataFrame, parts: int) -> DataFrame:
    """Link each node and its smaller neighbours to the least of them (small star). Links lead from u to a smaller v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
    return links.join(common.apart(least, "u"), "u").select(ends).select("e.u", "e.v").where("u <> v").coalesce(parts).distinct().coalesce(parts)


def _stars(links: DataFrame) -> bool:
    """Each node leads to one other, and no node that links lead to leads on itself."""
    leads = links.groupBy("u").agg(F.count("*").alias("n"))
    return leads.where("n > 1").isEmpty() and leads.join(links.select(F.col("v").alias("m")).distinct(), F.col("u") == F.col("m"), "left_semi").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (the least node of its component) for each node of ``links`` (``u``, ``v``).

    Alternating large and small stars: every step keeps the components and shortens the paths, so that a few rounds
    (of the order of the square of the logarithm of the longest path) leave stars. Links of a node to
    itself don't count; nodes without another link aren't in the result. Each two rounds are checkpointed.
    """
    now = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    parts = 1 + now.count() // ROWS_A_TASK  # few links in many tasks are mostly files
    while True:
        once = _tie(_lower(now.coalesce(parts), parts), parts)
        now = common.checkpointed(_tie(_lower(once, parts), parts))
        if _stars(now):
            break
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("root")), F.struct(F.col("v").alias("node"), F.col("v").alias("root")))).alias("e")
    return now.select(ends).select("e.node", "e.root").distinct().coalesce(parts)
