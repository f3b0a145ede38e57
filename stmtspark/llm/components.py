"""Connected components by alternating large-star and small-star steps on an edge table.

Each step is a grouped minimum and a join; no step gathers a node's neighbours.  The edge table is
written to the shared folder after each round, so lineage stays short and a lost executor costs one
round.  Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtspark.llm.common import cut, discard, tables_made

MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node joins its (larger or smaller) neighbours to its least neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        lower = both.filter("v < u")
        least = lower.groupBy("u").agg(F.min("v").alias("m"))
        moved = lower.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (u, v): component is the least id it can reach.

    Loops, repeated edges and both directions are allowed; null ends are left out.
    """
    spark, begin = edges.sparkSession, tables_made()
    now = cut(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
        now = cut(_star(_star(now, large=True), large=False))
        discard(spark, begin)  # the round before
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
