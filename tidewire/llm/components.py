"""Connected components of an edge table, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import dematerialize, materialize


def _large(e: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to the least node among u and its neighbours."""
    both = e.union(e.select("v", "u"))
    # written, so the join below has two plain exchanges and Spark can split a hub's edges
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "component-least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the least of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "component-least")
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node of the edges (u, v): root is the component's least node.
    Each round is written to the shared folder, so lineage stays short."""
    e, before = materialize(edges.where("u <> v").distinct(), name), None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        big = materialize(_large(e).distinct(), name)
        after = materialize(_small(big).where("u <> v").distinct(), name)
        dematerialize(e, big)
        e = after
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select("v", "v").distinct())
