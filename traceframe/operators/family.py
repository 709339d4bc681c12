"""Process families over parent edges: roots, families, related processes and
counter attribution. All climb one row a process by pointer jumping
(``functions/forest.py``), so depth has no limit and no table of all (process,
ancestor) pairs arises. The key of a process is ``node`` (a pid, or an instance
id with ``scope`` columns where one table holds several runs or machines)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import forest
from ..functions.closure import ancestor_closure
from ..session import stored


def root_processes(procs: DataFrame, matches: Column, scope: list[str] = (), node: str = "pid", parent: str = "ppid") -> DataFrame:
    """Processes matching ``matches`` with no matching ancestor."""
    tags = F.when(matches, F.array(F.lit("match")))
    over = forest.above(procs, node, parent, tags, scope).where(~F.array_contains("tags", "match"))
    mine = procs.where(matches).select(*scope, node).distinct()
    return mine.join(over.select(*scope, F.col("node").alias(node)), [*scope, node], "left_semi")


def is_exec_invocation(command: Column) -> Column:
    """A codex executable followed by the word ``exec`` on the command line."""
    words = F.split(F.trim(F.coalesce(command, F.lit(""))), r"\s+")
    bare = F.transform(words, lambda w: F.lower(F.regexp_replace(w, "^[\"\']+|[\"\']+$", "")))
    named = F.transform(bare, lambda w: F.element_at(F.split(w, "/"), -1).isin("codex", "codex-cli"))
    pairs = F.zip_with(F.slice(named, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, w: a & (w == "exec"))
    return F.exists(pairs, lambda x: F.coalesce(x, F.lit(False)))


def agent_roots(procs: DataFrame, label: Column, nested: Column | None = None, scope: list[str] = (), node: str = "pid",
                parent: str = "ppid") -> DataFrame:
    """J9 for known agents: processes with a ``label`` and no ancestor of the
    same label, with that label. A ``nested`` process (an ``exec`` invocation)
    only counts as inner under an ancestor of its label that is nested too."""
    nested = F.coalesce(nested, F.lit(False)) if nested is not None else F.lit(False)
    rows = procs.select(*scope, node, parent, label.alias("_label"), nested.alias("_nested"))
    inner = F.concat("_label", F.lit(" exec"))
    tags = F.when(F.col("_label").isNull(), None).when(F.col("_nested"), F.array("_label", inner)).otherwise(F.array("_label"))
    over = forest.above(rows, node, parent, tags, scope).withColumnRenamed("node", node)
    wanted = F.when(F.col("_nested"), inner).otherwise(F.col("_label"))
    return (rows.where("_label is not null").join(over, [*scope, node]).where(~F.array_contains("tags", wanted))
            .select(*scope, node, F.col("_label").alias("label")).distinct())


def process_family(procs: DataFrame, roots: DataFrame, scope: list[str] = (), node: str = "pid", parent: str = "ppid") -> DataFrame:
    """J8 + W11: every descendant of each root, not descending into other
    roots; (root_pid, pid, depth). Root rows have depth 0."""
    keys = [*scope, node]
    rows = procs.select(*keys, parent).join(roots.select(*keys).distinct().withColumn("_root", F.lit(True)), keys, "full")
    up = forest.nearest(rows, node, parent, F.col("_root"), scope).where("stopped")
    own = rows.select(*keys).distinct()
    return (up.withColumnRenamed("node", node).join(own, keys, "left_semi")
            .select(*scope, F.col("root").alias(f"root_{node}"), node, "depth"))


def related_pids(procs: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target pid: itself, its parent, all descendants and its
    siblings, as (target, related_pid, relation); a pid related in several
    ways keeps the first of self, parent, descendant, sibling. Of the closure
    only the targets above each pid are made: a pid climbs to its nearest
    target, and targets to the targets above them. (The rows are the answer:
    siblings of targets are listed for each target.)"""
    edges = procs.select("pid", "ppid").where("ppid IS NOT NULL AND ppid <> pid").distinct()
    t = stored(targets.select(F.col("pid").alias("target")).where("target is not null").distinct())
    self_ = t.select("target", F.col("target").alias("related_pid"), F.lit(0).alias("_o"))
    parent = (t.join(edges, t["target"] == edges["pid"])
              .select("target", F.col("ppid").alias("related_pid"), F.lit(1).alias("_o")))
    marked = edges.join(t.select(F.col("target").alias("pid"), F.lit(True).alias("_t")), "pid", "full")
    near = stored(forest.nearest(marked, "pid", "ppid", F.col("_t")).where("stopped").select("node", F.col("root").alias("target")))
    # Targets above a target: its parent's nearest target, and so on.
    above = ancestor_closure(t.join(edges, t["target"] == edges["pid"]).join(near.select(F.col("node").alias("ppid"), F.col("target").alias("_up")), "ppid")
                             .select(F.col("target").alias("c"), F.col("_up").alias("p")), "c", "p")
    over = above.select(F.col("node").alias("_near"), F.col("ancestor").alias("target")).unionByName(t.select(F.col("target").alias("_near"), "target"))
    desc = (near.select(F.col("node").alias("related_pid"), F.col("target").alias("_near")).join(over, "_near")
            .where("related_pid <> target").select("target", "related_pid", F.lit(2).alias("_o")))
    tp = t.join(edges, t["target"] == edges["pid"]).select("target", F.col("ppid").alias("_p"))
    sib = (tp.join(edges.withColumnRenamed("pid", "related_pid"), F.col("_p") == F.col("ppid"))
           .where(F.col("related_pid") != F.col("target"))
           .select("target", "related_pid", F.lit(3).alias("_o")))
    names = F.element_at(F.array(*[F.lit(x) for x in ("self", "parent", "descendant", "sibling")]),
                         F.col("_o") + 1)
    return (self_.unionByName(parent).unionByName(desc).unionByName(sib)
            .groupBy("target", "related_pid").agg(F.min("_o").alias("_o"))
            .select("target", "related_pid", names.alias("relation")))


def attribute_counters(family: DataFrame, counters: DataFrame, value_cols: list[str]) -> DataFrame:
    """Sum per-pid counters over each root's family, plus one
    'unattributed' row for pids in no family."""
    j = counters.join(family.select("root_pid", "pid"), "pid", "left")
    attributed = (j.where(F.col("root_pid").isNotNull()).groupBy("root_pid")
                  .agg(*[F.sum(c).cast("bigint").alias(c) for c in value_cols],
                       F.count_distinct("pid").alias("pids"))
                  .withColumn("root_pid", F.col("root_pid").cast("string")))
    un = (j.where(F.col("root_pid").isNull())
          .agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in value_cols],
               F.count_distinct("pid").alias("pids"))
          .withColumn("root_pid", F.lit("unattributed")))
    return attributed.unionByName(un)
