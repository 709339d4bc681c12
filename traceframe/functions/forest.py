"""Forests of nodes with one parent each, by pointer jumping.

Every step keeps one row for a node: a pointer up and what was gathered on the
way there. A round joins the pointers with the table itself, so a node learns
what lies twice as far up; a path of n edges takes log2(n) rounds, whatever
the number of nodes above each. Nodes that have arrived leave the join, which
also keeps the many nodes below one root out of it. Rounds are stored in the
shared folder, and the table of the round before is removed.

Keys are columns ``scope`` (run and machine, say) with the node's id, so trees
of different scopes never touch. A parent that is no node of the table counts
as a root. Null nodes are left out. Of several parents of a node the greatest
counts. On a cycle, the edge above its least node is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored


def _key(scope: list[str], column: str) -> Column:
    return F.struct(*[F.col(c) for c in scope], F.col(column).alias("_id"))


def _nodes(nodes: DataFrame, scope: list[str], node: str, parent: str, **extra: Column) -> DataFrame:
    """(node, parent, extras) with struct keys: one row a node, parents without a row added."""
    up = F.when(F.col(parent).isNotNull() & (F.col(parent) != F.col(node)), _key(scope, parent))
    rows = nodes.where(F.col(node).isNotNull()).select(_key(scope, node).alias("node"), up.alias("parent"), *[c.alias(n) for n, c in extra.items()])
    missing = rows.select(F.col("parent").alias("node")).where("node is not null")
    return (rows.unionByName(missing, allowMissingColumns=True).groupBy("node")
            .agg(F.max("parent").alias("parent"), *[F.max(n).alias(n) for n in extra]))


LOOKUPS = 3  # jumps of a round, all through the same table: it reaches four times as far


def _arrive(table: DataFrame) -> tuple[DataFrame, bool]:
    """Jumps the rows (node, at, depth, low, stopped, done) until all are done;
    rows that run in cycles keep done = false. Second: whether there are such."""
    table, reach, n = stored(table), 1, None
    while left := table.where("not done").count():
        n = n or left
        if reach > 4 * n:
            return table, True  # as many steps as there are nodes: what is left never ends
        ahead = table.select(F.col("node").alias("_key"), *[F.col(c).alias(f"_{c}") for c in ("at", "depth", "low", "stopped", "done")])
        moved = table.where("not done")
        for _ in range(LOOKUPS):
            # Rows that have arrived meet their own row, not the one many share.
            moved = (moved.withColumn("_key", F.when(F.col("done"), F.col("node")).otherwise(F.col("at"))).join(ahead, "_key")
                     .select("node", F.when(F.col("done"), F.col("at")).otherwise(F.col("_at")).alias("at"),
                             F.when(F.col("done"), F.col("depth")).otherwise(F.col("depth") + F.col("_depth")).alias("depth"),
                             F.when(F.col("done"), F.col("low")).otherwise(F.least("low", "_low")).alias("low"),
                             F.when(F.col("done"), F.col("stopped")).otherwise(F.col("_stopped")).alias("stopped"),
                             (F.col("done") | F.col("_done")).alias("done")))
        after = stored(table.where("done").unionByName(moved))
        discard(table)
        table, reach = after, reach * (LOOKUPS + 1)
    return table, False


def nearest(nodes: DataFrame, node: str, parent: str, stop: Column | None = None, scope: list[str] = ()) -> DataFrame:
    """(scope, node, root, depth, stopped) of each node: the nearest node at or
    above it for which ``stop`` holds, else its root; ``depth`` is the number of
    edges there and ``stopped`` tells which of the two it is."""
    scope = list(scope)
    rows = _nodes(nodes, scope, node, parent, stop=F.coalesce(stop, F.lit(False)) if stop is not None else F.lit(False))

    def start(cut: DataFrame | None) -> DataFrame:
        parents = rows if cut is None else rows.join(cut.withColumn("_cut", F.lit(True)), "node", "left")
        stopped = F.coalesce("stop", F.lit(False))
        end = stopped | F.col("parent").isNull()
        end = end if cut is None else end | F.coalesce("_cut", F.lit(False))
        return parents.select("node", F.when(end, F.col("node")).otherwise(F.col("parent")).alias("at"),
                              F.when(end, 0).otherwise(1).cast("long").alias("depth"), F.col("node").alias("low"), stopped.alias("stopped"), end.alias("done"))

    table, endless = _arrive(start(None))
    if endless:
        # Far enough up, every pointer is on its cycle; the least node seen from there is the cycle's least.
        on_cycle = table.where("not done").select(F.col("at").alias("node")).distinct()
        cut = stored(on_cycle.join(table, "node").select(F.col("low").alias("node")).distinct())
        discard(table)
        table, _ = _arrive(start(cut))
    return table.select(*[F.col(f"node.{c}").alias(c) for c in scope], F.col("node._id").alias("node"),
                        F.col("at._id").alias("root"), F.col("depth").cast("int").alias("depth"), "stopped")


def with_ancestors(nodes: DataFrame, node: str, parent: str, marked: Column, scope: list[str] = ()) -> DataFrame:
    """(scope, node): the marked nodes and all nodes above them. After round k
    the set holds what lies up to 2^k - 1 edges above."""
    scope = list(scope)
    rows = stored(_nodes(nodes, scope, node, parent, marked=F.coalesce(marked, F.lit(False))))
    jump = rows.select("node", F.col("parent").alias("at")).where("at is not null")
    found, reach, n = stored(rows.where("marked").select("node")), 1, None
    old = None
    while not (up := found.join(jump, "node").select(F.col("at").alias("node"))).isEmpty():
        n = rows.count() if n is None else n
        if reach > 2 * n:
            break  # cycles: every node of a path has been met
        after = stored(found.unionByName(up).distinct())
        further = stored(jump.join(jump.select(F.col("node").alias("at"), F.col("at").alias("_up")), "at").select("node", F.col("_up").alias("at")))
        discard(found, *([old] if old is not None else []))
        found, jump, old, reach = after, further, further, 2 * reach
    return found.select(*[F.col(f"node.{c}").alias(c) for c in scope], F.col("node._id").alias("node"))


def above(nodes: DataFrame, node: str, parent: str, tags: Column, scope: list[str] = ()) -> DataFrame:
    """(scope, node, tags): the distinct tags of all nodes strictly above each
    node. ``tags`` is an array of few distinct values (labels), nulls and empty
    arrays for nodes without."""
    scope = list(scope)
    none = F.array().cast("array<string>")
    rows = stored(_nodes(nodes, scope, node, parent, own=F.coalesce(tags, none)))
    # span: the tags of the node itself and on the way to, but not at, the node pointed to.
    table = stored(rows.select("node", F.col("parent").alias("at"), F.array_distinct(F.coalesce("own", none)).alias("span")))
    reach, n = 1, None
    while not (active := table.where("at is not null")).isEmpty():
        n = active.count() if n is None else n
        if reach > 2 * n:
            break
        ahead = table.select(F.col("node").alias("at"), F.col("at").alias("_at"), F.col("span").alias("_span"))
        moved = active.join(ahead, "at").select("node", F.col("_at").alias("at"), F.array_union("span", "_span").alias("span"))
        after = stored(table.where("at is null").unionByName(moved))
        discard(table)
        table, reach = after, 2 * reach
    over = table.select(F.col("node").alias("parent"), F.col("span").alias("tags"))
    return (rows.select("node", "parent").join(over, "parent", "left")
            .select(*[F.col(f"node.{c}").alias(c) for c in scope], F.col("node._id").alias("node"), F.coalesce("tags", none).alias("tags")))
