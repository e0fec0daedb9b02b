"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, so no neighbourhood is ever collected, and the number of
rounds grows with the logarithm of the longest chain. Every round is cut with a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return (
        joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .where("u <> v")
        .distinct()
    )


def connected_components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link; the component is its least node.

    Self links and repeated links change nothing; NULL ends are left out; an empty table gives no row.
    Raises if the rounds do not settle, rather than return components that may be split.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    edges = cut_lineage(edges)
    mark = None
    for _ in range(most_rounds):
        edges = cut_lineage(_small_star(_large_star(edges)))
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        mark = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
