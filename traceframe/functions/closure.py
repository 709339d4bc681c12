"""Transitive closure of parent edges by pointer doubling.

Paths of up to 2^k edges are extended by one equi join to 2^(k+1), so a chain
of n edges takes log2(n) joins and no depth is left out. Pairs are distinct and
keep their shortest depth, so cycles and nodes with several parents end too.
Every round is cut by a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def ancestor_closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, ancestor, depth >= 1): all ancestors of each node at their least
    depth. Self edges and null ends are left out; a node on a cycle is not its
    own ancestor."""
    pairs = cut_lineage(edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor"))
                        .where("ancestor <> node").distinct().withColumn("depth", F.lit(1)))
    reach = 1
    while not (longest := pairs.where(F.col("depth") == reach)).isEmpty():
        # A shortest path longer than `reach` passes a node at exactly that depth.
        up = pairs.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_up"), F.col("depth").alias("_more"))
        longer = (longest.join(up, "ancestor").where("_up <> node")
                  .select("node", F.col("_up").alias("ancestor"), (F.col("depth") + F.col("_more")).alias("depth")))
        pairs = cut_lineage(pairs.unionByName(longer).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")))
        reach *= 2
    return pairs
