"""Connected components of an undirected edge table by repeated contraction.

Each round every node points to the neighbour of least priority (a hash that
changes by round, so that paths shrink by a constant factor), pointers are
followed twice, and the edges between the resulting groups go on to the next
round. All steps are aggregations and equi joins; nothing is collected. The
tables of a round are written to the shared folder, which cuts their lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _rank(name: str, round_no: int) -> Column:
    return F.struct(F.xxhash64(F.lit(round_no), F.col(name)).alias("rank"), F.col(name).alias("id"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of the edges with the least node of its
    component. Null ends and self-loops link nothing; repeated edges are one."""
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b")
    left = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    group = None
    round_no = 0
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(_rank("b", round_no)).alias("m"))
        near = written(best.select(F.col("a").alias("node"), F.least("m", _rank("a", round_no))["id"].alias("to")))
        to = written(near.join(near.select(F.col("node").alias("to"), F.col("to").alias("up")), "to")
                     .select("node", F.col("up").alias("to")))
        at_a, at_b = (to.select(F.col("node").alias(c), F.col("to").alias(f"_{c}")) for c in ("a", "b"))
        rest = written(left.join(at_a, "a").join(at_b, "b").where("_a != _b")
                       .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
        if group is None:
            moved = to
        else:
            step = to.select(F.col("node").alias("to"), F.col("to").alias("up"))
            moved = written(group.join(step, "to", "left").select("node", F.coalesce("up", "to").alias("to")))
            discard(group, to)
        discard(left, near)
        left, group, round_no = rest, moved, round_no + 1
    if group is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = written(group.groupBy("to").agg(F.min("node").alias("component")))
    out = written(group.join(least, "to").select("node", "component"))
    discard(group, least, left)
    return out
