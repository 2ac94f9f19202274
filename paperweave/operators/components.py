"""Connected components of an undirected graph, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so no node's neighbours are ever gathered in one place, and the number
of rounds grows with the logarithm of the graph's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.plans.runtime import cut_lineage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; a component is named by its smallest node.

    Null ends, loops, repeated and reversed edges are harmless. An empty edge table gives no rows.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    # read from the checkpoint below, so that whatever made the edges runs once
    pairs = cut_lineage(ends.distinct())
    loops = pairs.where("u = v").select("u")
    current = pairs.where("u > v")
    before = None
    for _ in range(most_rounds):
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        current = cut_lineage(small.where("u > v").distinct())
        state = tuple(current.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    linked = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component"))
    return linked.union(roots).union(alone).groupBy("node").agg(F.min("component").alias("component"))
