"""Connected components of a link table, without ever bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over rows (u, v).

    Every node's links are moved to its smallest neighbour.  The smallest neighbour comes from an
    aggregate (combined before the shuffle) that is joined back, so a node with very many links is
    a skewed join, which adaptive execution splits, and never one group in memory.  Both sides lie shuffled
    already, so they are merged: a broadcast in every round would only load the driver.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = both.join(least.hint("merge"), "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is the smallest node reachable.

    Alternates large-star and small-star steps until the table stops changing.  Each round is
    written to the shared folder, so a lost executor costs one round at most.  Null ends, loops
    and repeated rows are ignored; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    now = settle(edges.select("u", "v").where("u <> v").distinct())
    mark = None
    for _ in range(rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or seen[0] == 0:
            break
        mark = tuple(seen)
        new = settle(_star(_star(now, large=True), large=False))
        forget(spark, now)
        now = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
