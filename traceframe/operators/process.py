"""Process instances, audit rows, interval joins and lineage closures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import is_writable_open
from ..functions import forest
from ..functions.scan import running_sum
from ..session import discard, stored

#: Columns that name a run and a machine; keys of every process table that holds several of them. (``host`` is a network peer.)
SCOPE = ["run_id", "machine"]


def process_instances(canon: DataFrame, bucket_ms: int = 3_600_000, scope: list[str] = ()) -> DataFrame:
    """Instance id per EXEC/EXIT event, surviving pid reuse. Ids are
    unique within ``scope``.

    Gaps and islands per pid in arrival order (timestamp, seq): the island of
    a row is the number of EXITs before it. The first EXEC of an island opens
    the instance ``process-{pid}-{exec ts}``; later EXECs share it; the EXIT
    closes it. An island without EXEC is a lone EXIT with its own id.

    The EXIT count is a two-level running sum (per pid and time bucket, plus a
    carry over buckets), and the island's first EXEC is a grouped min, so a
    pid holding most events does not serialise the job into one task.
    """
    p = canon.where(F.col("event").isin("EXEC", "EXIT"))
    p = running_sum(p, [*scope, "pid"], F.expr(f"timestamp_ms div {int(bucket_ms)}"), ["timestamp_ms", "seq"],
                    (F.col("event") == "EXIT").cast("bigint"), "island", inclusive=False)
    first = (p.groupBy(*scope, "pid", "island")
             .agg(F.min(F.when(F.col("event") == "EXEC", F.col("timestamp_ms"))).alias("_first_exec")))
    p = p.join(first, [*scope, "pid", "island"])
    return p.withColumn(
        "instance_id",
        F.format_string("process-%d-%d", F.col("pid"), F.coalesce("_first_exec", "timestamp_ms"))
    ).drop("_first_exec")


def process_node_rows(instances: DataFrame, scope: list[str] = ()) -> DataFrame:
    """One node row per EXEC/EXIT event (before the upsert merge)."""
    is_exec = F.col("event") == "EXEC"
    is_exit = F.col("event") == "EXIT"
    status = (F.when(~is_exit, "observed").when(F.col("exit_code") == 0, "success")
              .when(F.col("exit_code").isNotNull(), "failure").otherwise("observed"))
    return instances.select(
        *scope, F.col("instance_id").alias("id"), "seq", "pid", "ppid",
        F.when(is_exec, F.col("timestamp_ms")).alias("start_timestamp_ms"),
        F.when(is_exit, F.col("timestamp_ms")).alias("end_timestamp_ms"),
        "comm",
        F.col("filename").alias("command"),
        "cwd",
        F.when(is_exit, F.col("exit_code")).cast("int").alias("exit_code"),
        status.alias("status"),
    )


def upsert_processes(rows: DataFrame, scope: list[str] = ()) -> DataFrame:
    """Merge node rows by id — min start, max end, latest non-null fields.

    All terms are aggregates (min/max/max_by), so the merge is a partial
    aggregation keyed by instance id.
    """
    def latest(c):
        return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)

    return rows.groupBy(*scope, "id").agg(
        F.first("pid").alias("pid"),
        latest("ppid"),
        F.min("start_timestamp_ms").alias("start_timestamp_ms"),
        F.max("end_timestamp_ms").alias("end_timestamp_ms"),
        latest("comm"), latest("command"), latest("cwd"), latest("exit_code"), latest("status"),
    )


def process_nodes(canon: DataFrame, scope: list[str] = ()) -> DataFrame:
    """W2 + S8: the process_nodes table from canonical events."""
    return upsert_processes(process_node_rows(process_instances(canon, scope=scope), scope), scope)


def audit_from_events(canon: DataFrame) -> DataFrame:
    """audit rows — process exec/exit, writable file opens, network events."""
    ev = F.col("event")
    proc = canon.where(ev.isin("EXEC", "EXIT")).select(
        F.format_string("audit-%d", "seq").alias("id"), "seq", "timestamp_ms",
        F.lit("process").alias("audit_type"), "pid", "comm",
        F.when(ev == "EXEC", "exec").otherwise("exit").alias("action"),
        F.col("filename").alias("target"),
        F.when(ev == "EXEC", "observed").when(F.col("exit_code") == 0, "success")
         .when(F.col("exit_code").isNotNull(), "failure").otherwise("observed").alias("status"))
    files = canon.where((ev == "FILE_OPEN") & is_writable_open(F.col("flags"))).select(
        F.format_string("audit-%d", "seq").alias("id"), "seq", "timestamp_ms",
        F.lit("file").alias("audit_type"), "pid", "comm", F.lit("write").alias("action"),
        F.col("path").alias("target"), F.lit("observed").alias("status"))
    net = canon.where(ev.startswith("NET_")).select(
        F.format_string("audit-%d", "seq").alias("id"), "seq", "timestamp_ms",
        F.lit("network").alias("audit_type"), "pid", "comm", ev.alias("action"),
        F.col("host").alias("target"), F.lit("observed").alias("status"))
    return proc.unionByName(files).unionByName(net)


def attach_process(audit: DataFrame, nodes: DataFrame, bucket_ms: int = 3600 * 1000,
                   key: str = "id", before_key: bool = False,
                   max_buckets: int = 256, scope: list[str] = ()) -> DataFrame:
    """The process instance of each audit row.

    Candidates: same pid, ``coalesce(start,0) <= ts <= coalesce(end,+inf)``;
    the latest-starting candidate wins (ties: larger id). As an interval join:
    each node is exploded into the time buckets its life covers, joined on
    ``(pid, bucket)``, and the exact predicate re-checked. Lives are clamped
    to the pid's probe time range and the bucket width per pid is at least
    ``range / max_buckets``, so a node never explodes into more than
    ``max_buckets + 1`` rows, however open-ended it is. Each audit row meets a
    node in one bucket only, so no duplicates arise.
    """
    scope = list(scope)
    by = [F.col(c).alias(f"_r_{c}") for c in scope]
    rng = (audit.groupBy(*by, F.col("pid").alias("_rpid"))
           .agg(F.min("timestamp_ms").alias("_t0"), F.max("timestamp_ms").alias("_t1"))
           .withColumn("_bw", F.greatest(F.lit(int(bucket_ms)).cast("bigint"),
                                         F.ceil((F.col("_t1") - F.col("_t0") + 1) / max_buckets)
                                         .cast("bigint"))))
    keys = [f"_r_{c}" for c in scope] + ["_rpid"]

    def bucket(ts):
        return F.floor((ts - F.col("_t0")) / F.col("_bw")).cast("bigint")

    n = nodes.select(F.col("id").alias("process_id"), *by, F.col("pid").alias("_rpid"),
                     F.coalesce("start_timestamp_ms", F.lit(0)).alias("_s"),
                     F.col("start_timestamp_ms").isNotNull().alias("_has_start"),
                     F.col("end_timestamp_ms").alias("_e"))
    n = n.join(rng, keys)
    lo = F.greatest(F.col("_s"), F.col("_t0"))
    hi = F.least(F.coalesce(F.col("_e"), F.col("_t1")), F.col("_t1"))
    n = (n.where(lo <= hi)
         .select(*keys, "process_id", "_s", "_has_start", "_e",
                 F.explode(F.sequence(bucket(lo), bucket(hi))).alias("_nb")))
    # Only ids, pids and times meet the lives and are aggregated; the other columns are joined back by id.
    own = {f"_r_{c}": F.col(c) for c in scope} | {"_rpid": F.col("pid")}
    a = audit.select(*[c.alias(n) for n, c in own.items()], F.col(key).alias("_key"), F.col("timestamp_ms").alias("_ts"))
    a = a.join(rng, keys).withColumn("_nb", bucket(F.col("_ts")))
    inside = (F.col("_s") <= F.col("_ts")) & (F.col("_e").isNull() | (F.col("_ts") <= F.col("_e")))
    if before_key:
        inside &= F.struct("_s", "process_id") < F.struct("_ts", "_key")
    best = F.max_by("process_id", F.struct("_s", "_has_start", "process_id")).alias("process_id")
    by_key = [*keys[:-1], "_key"]
    found = a.join(n, [*keys, "_nb"]).where(inside).groupBy(*by_key).agg(best)
    found = found.select(*[F.col(f"_r_{c}").alias(c) for c in scope], F.col("_key").alias(key), "process_id")
    return audit.join(found, [*scope, key], "left").select(*scope, key, *[c for c in audit.columns if c not in (key, *scope)], "process_id")


def process_edges(canon: DataFrame) -> DataFrame:
    """Distinct (pid, ppid) edges observed in events."""
    return canon.select("pid", "ppid").where(F.col("pid").isNotNull()).distinct()


def process_lineage(edges: DataFrame, scope: list[str] = (), node: str = "pid", parent: str = "ppid") -> DataFrame:
    """J6 closure + W11: root ancestor and depth of every process (pid,
    root_pid, depth), by pointer jumping over one row a process
    (``functions/forest.py``); a process without a parent is its own root."""
    up = forest.nearest(edges, node, parent, scope=scope)
    own = edges.select(*scope, F.col(node).alias("node")).where("node is not null").distinct()
    return (up.join(own, [*scope, "node"], "left_semi")
            .select(*scope, F.col("node").alias(node), F.col("root").alias(f"root_{node}"), "depth"))


def process_parents(nodes: DataFrame, bucket_ms: int = 3600 * 1000, scope: list[str] = ()) -> DataFrame:
    """Parent instance of each process instance.

    Parent candidates: pid = child's ppid, child's start inside the parent's
    life, and the parent before the child in the order (start, id), a missing
    start being 0; the latest-starting one wins. The order makes the parents a
    forest: two instances can never be each other's parent. Same bucketed
    interval join as ``attach_process`` with the child start as the probe time.
    """
    child = nodes.select(*scope, F.col("id").alias("child_id"), F.col("ppid").alias("pid"),
                         F.coalesce("start_timestamp_ms", F.lit(0)).alias("timestamp_ms"))
    child = child.where(F.col("pid").isNotNull())
    j = attach_process(child, nodes, bucket_ms, key="child_id", before_key=True, scope=scope)
    return j.select(*scope, "child_id", F.col("process_id").alias("parent_id"))


def process_forest(nodes: DataFrame, scope: list[str] = ()) -> DataFrame:
    """All process nodes with ``parent_id``, null for roots. The nodes are made
    once (lives, children and result all read them), and so is the forest."""
    nodes = stored(nodes)
    parents = process_parents(nodes, scope=scope).withColumnRenamed("child_id", "id")
    forest_rows = stored(nodes.join(parents, [*scope, "id"], "left"))
    discard(nodes)
    return forest_rows


def process_timeline(attached_audit: DataFrame, parents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per process instance, its own audit events and the starts of its
    child processes, in time order (rows keyed by process_id; ordering within
    a process by (timestamp, kind, id))."""
    ev = attached_audit.where(F.col("process_id").isNotNull()).select(
        "process_id", "timestamp_ms", F.lit("event").alias("item_type"), F.col("id").alias("item_id"))
    child_start = nodes.select(F.col("id").alias("child_id"),
                               F.coalesce("start_timestamp_ms", F.lit(0)).alias("timestamp_ms"))
    ch = (parents.where(F.col("parent_id").isNotNull()).join(child_start, "child_id")
          .select(F.col("parent_id").alias("process_id"), "timestamp_ms", F.lit("process").alias("item_type"),
                  F.col("child_id").alias("item_id")))
    return ev.unionByName(ch).orderBy("process_id", "timestamp_ms", "item_type", "item_id")


def filter_process_tree(attached: DataFrame, parents: DataFrame, predicate, scope: list[str] = ()) -> DataFrame:
    """processes that hold events matching ``predicate`` plus all their
    ancestors (so the tree stays connected), with the number of matching
    events of each."""
    hits = stored(attached.where(predicate & F.col("process_id").isNotNull())
                  .groupBy(*scope, "process_id").agg(F.count(F.lit(1)).alias("matching_events")))
    nodes = parents.select(*scope, F.col("child_id").alias("process_id"), "parent_id").join(hits, [*scope, "process_id"], "full")
    kept = forest.with_ancestors(nodes, "process_id", "parent_id", F.col("matching_events").isNotNull(), scope)
    return (kept.withColumnRenamed("node", "process_id").join(hits, [*scope, "process_id"], "left")
            .select(*scope, "process_id", F.coalesce("matching_events", F.lit(0)).alias("matching_events")))


def observed_processes(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """a process row for every pid that made LLM calls but has no
    process node (left anti join on pid): first call time, latest comm,
    status 'observed', source 'llm_call'."""
    c = (calls.where(F.col("pid").isNotNull()).groupBy("pid")
         .agg(F.min("start_timestamp_ms").alias("start_timestamp_ms"),
              F.max_by("comm", "start_timestamp_ms").alias("comm"), F.count(F.lit(1)).alias("calls")))
    return (c.join(nodes.select("pid").distinct(), "pid", "left_anti")
            .select(F.format_string("observed-%d", "pid").alias("id"), "pid", "comm", "start_timestamp_ms", "calls",
                    F.lit("observed").alias("status"), F.lit("llm_call").alias("view_source")))
