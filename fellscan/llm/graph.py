"""Connected components of an edge table, by rounds of joins and combinable minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fellscan.session import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of its component.

    Alternating stars: each node's larger neighbours move to its smallest neighbour (itself included), then its smaller
    ones do. A round halves the distance to the root at least, so rounds grow with the logarithm of a component's
    diameter, and edges never grow in number. A node with very many neighbours is aggregated before the shuffle; its
    edges meet its minimum in a join that can be split.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    now = cut_lineage(edges.where(F.col(a) != F.col(b)).select(low.alias("a"), high.alias("b")).distinct())
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = cut_lineage(both.where("b > a").join(least, "a").select(F.col("m").alias("a"), F.col("b")).where("a < b").distinct())
        # small star: a node's smaller neighbours and itself hang on the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        now = cut_lineage(large.join(least, "b").select("m", F.explode(F.array("a", "b")).alias("b")).where("m < b").select(F.col("m").alias("a"), "b").distinct())
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node is either a root or hangs on a single one."""
    roles = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return roles.groupBy("node").agg(F.max("up").alias("up"), F.sum("down").alias("down")).where("down > 1 OR (up = 1 AND down = 1)").isEmpty()
