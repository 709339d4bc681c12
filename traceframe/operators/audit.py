"""Audit counters, ranked audit views, retention and network targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def audit_counters(audit: DataFrame, by_pid: bool = False) -> DataFrame:
    """Execs, exits ok/fail, file events, unique files, network, pids."""
    t, a, s = F.col("audit_type"), F.col("action"), F.col("status")
    aggs = [
        F.count_if((t == "process") & (a == "exec")).alias("process_execs"),
        F.count_if((t == "process") & (a == "exit")).alias("process_exits"),
        F.count_if((t == "process") & (a == "exit") & (s == "success")).alias("process_exit_success"),
        F.count_if((t == "process") & (a == "exit") & (s == "failure")).alias("process_exit_failure"),
        F.count_if(t == "file").alias("file_events"),
        F.count_distinct(F.when(t == "file", F.col("target"))).alias("unique_files"),
        F.count_if(t == "network").alias("network_events"),
        F.count_distinct("pid").alias("pids"),
    ]
    if by_pid:
        return audit.where(F.col("pid").isNotNull()).groupBy("pid").agg(*aggs)
    return audit.agg(*aggs)


def audit_rows(audit: DataFrame, audit_type: str | None = None, limit: int = 100) -> DataFrame:
    """optional type filter, newest first (ties: id asc), the ``limit`` first rows."""
    df = audit if audit_type is None else audit.where(F.col("audit_type") == audit_type)
    return df.orderBy(F.col("timestamp_ms").desc(), F.col("id").asc()).limit(limit)


def recent_failures(audit: DataFrame, n: int = 10) -> DataFrame:
    """Latest failures first; text = summary, else target, else 'failure'."""
    text = F.coalesce(*([F.col("summary")] if "summary" in audit.columns else []),
                      F.col("target"), F.lit("failure"))
    return (audit.where(F.col("status") == "failure")
            .orderBy(F.col("timestamp_ms").desc(), F.col("id").desc()).limit(n)
            .select("id", "timestamp_ms", "pid", text.alias("failure")))


def retain_recent(df: DataFrame, n: int, order_cols=("seq",)) -> DataFrame:
    """Keep the last ``n`` rows by arrival (a top-k, not a global window)."""
    return df.orderBy(*[F.col(c).desc() for c in order_cols]).limit(n)


def audit_tail(audit: DataFrame, n: int = 20_000) -> DataFrame:
    """The last ``n`` audit rows by (time, id), ascending."""
    tail = audit.orderBy(F.col("timestamp_ms").desc(), F.col("id").desc()).limit(n)
    return tail.orderBy("timestamp_ms", "id")


def network_rows(canon: DataFrame) -> DataFrame:
    """every event with a host counts once (errors: status >= 400)."""
    return canon.where(F.col("host").isNotNull() & (F.col("host") != "")).select(
        "seq", "pid", "comm", "host",
        F.nullif(F.col("path"), F.lit("")).alias("path"),
        F.lit(1).cast("bigint").alias("count"),
        F.coalesce((F.col("status_code") >= 400).cast("bigint"), F.lit(0).cast("bigint")).alias("error_count"),
        F.col("timestamp_ms").alias("first_timestamp_ms"),
        F.col("timestamp_ms").alias("last_timestamp_ms"))


def network_targets(rows: DataFrame) -> DataFrame:
    """Merge target rows by (pid or 0, host, path or '').

    Counts add, first = min, last = max; pid/comm/path of the first arrival.
    Sorted by count desc, host, path.
    """
    g = rows.groupBy(F.coalesce(F.col("pid"), F.lit(0)).alias("_pk"), "host",
                     F.coalesce(F.col("path"), F.lit("")).alias("_path"))
    out = g.agg(
        F.min_by("pid", "seq").alias("pid"),
        F.min_by("comm", "seq").alias("comm"),
        F.sum("count").cast("bigint").alias("count"),
        F.sum("error_count").cast("bigint").alias("error_count"),
        F.min("first_timestamp_ms").alias("first_timestamp_ms"),
        F.max("last_timestamp_ms").alias("last_timestamp_ms"))
    return (out.select("pid", "comm", "host", F.nullif(F.col("_path"), F.lit("")).alias("path"),
                       "count", "error_count", "first_timestamp_ms", "last_timestamp_ms")
            .orderBy(F.col("count").desc(), "host", "path"))


def top_counts(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """Count per key, count desc then key asc, first ``n``."""
    return (df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).count()
            .orderBy(F.col("count").desc(), F.col("key").asc()).limit(n))


def edge_samples(df: DataFrame, group_cols: list[str], score_col: str, key_col: str,
                 k: int = 5) -> DataFrame:
    """Per group the top ``k`` and bottom ``k`` rows by score, disjoint.

    Groups with at most ``2k`` rows are kept whole (rank_kind 'all'); else the
    top k (score desc, key asc) are 'top' and the first k of the remaining rows
    in (score asc, key asc) order are 'bottom'. ``key_col`` is unique within a
    group.

    Skew: the candidates are the first 2k rows of each order, filtered with
    ``row_number() <= 2k`` which Spark runs as a partial group limit before the
    shuffle, so even a group holding most rows ships at most 4k rows per input
    partition. Group sizes come from a partial count aggregate.
    """
    top = Window.partitionBy(*group_cols).orderBy(F.col(score_col).desc(), F.col(key_col).asc())
    bot = Window.partitionBy(*group_cols).orderBy(F.col(score_col).asc(), F.col(key_col).asc())
    c_top = df.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= 2 * k).drop("_r")
    c_bot = df.withColumn("_r", F.row_number().over(bot)).where(F.col("_r") <= 2 * k).drop("_r")
    cand = c_top.unionByName(c_bot).dropDuplicates(group_cols + [key_col])
    sizes = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n"))
    x = cand.join(sizes, group_cols).withColumn("_rt", F.row_number().over(top))
    rest = Window.partitionBy(*group_cols, (F.col("_rt") <= k)).orderBy(
        F.col(score_col).asc(), F.col(key_col).asc())
    x = x.withColumn("_rb", F.row_number().over(rest))
    kind = (F.when(F.col("_n") <= 2 * k, "all").when(F.col("_rt") <= k, "top")
            .when(F.col("_rb") <= k, "bottom"))
    return (x.withColumn("rank_kind", kind).where(F.col("rank_kind").isNotNull())
            .drop("_n", "_rt", "_rb"))


def top_sections(audit: DataFrame, network_targets: DataFrame, model_tokens: DataFrame,
                 tool_calls: DataFrame, session_files: DataFrame | None = None, n: int = 10,
                 view: str = "all") -> DataFrame:
    """The five ranked sections (Processes by exec count, Files by file
    events — else files recorded in sessions —, Network by target counts —
    else network audit rows —, Models by tokens, Tools by calls), each top
    ``n`` (count desc, key asc). Fallbacks are chosen per section by a
    priority column, not by a driver-side emptiness check."""
    def top(df, section, unit, key, weight=None, prio=0):
        g = df.where(key.isNotNull()).groupBy(key.alias("key"))
        g = g.agg((F.count(F.lit(1)) if weight is None else F.sum(F.greatest(weight, F.lit(0)))).cast("bigint")
                  .alias("count"))
        return g.select(F.lit(section).alias("section"), F.lit(unit).alias("unit"), "key", "count",
                        F.lit(prio).alias("_prio"))
    procs = audit.where((F.col("audit_type") == "process") & (F.col("action") == "exec"))
    parts = [
        top(procs, "Processes", "execs", F.coalesce("comm", "target", F.lit("unknown"))),
        top(audit.where(F.col("audit_type") == "file"), "Files", "events", F.col("target")),
        top(network_targets, "Network", "events", F.col("host"), F.col("count")),
        top(audit.where(F.col("audit_type") == "network"), "Network", "events", F.col("target"), prio=1),
        top(model_tokens, "Models", "tokens", F.col("group"), F.col("total_tokens")),
        top(tool_calls, "Tools", "calls", F.col("tool_name")),
    ]
    if session_files is not None:
        parts.append(top(session_files, "Files", "events", F.col("path"), F.col("count"), prio=1))
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    # top n per (section, source) first — a partial group limit, so the
    # fallback choice below only sees at most 2n rows per section
    w = Window.partitionBy("section", "_prio").orderBy(F.col("count").desc(), F.col("key").asc())
    allp = allp.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    best = Window.partitionBy("section")
    out = (allp.withColumn("_best", F.min("_prio").over(best)).where(F.col("_prio") == F.col("_best"))
           .drop("_prio", "_best"))
    views = {"process": ["Processes"], "processes": ["Processes"], "proc": ["Processes"],
             "file": ["Files"], "files": ["Files"], "fs": ["Files"], "network": ["Network"], "net": ["Network"],
             "model": ["Models", "Tools"], "models": ["Models", "Tools"], "tokens": ["Models", "Tools"],
             "tool": ["Tools"], "tools": ["Tools"]}
    keep = views.get(view.lower())
    return out if keep is None else out.where(F.col("section").isin(*keep))


def top_filter(df: DataFrame, pid: int | None = None, comm: str | None = None) -> DataFrame:
    """pid exact, else substring of comm or command."""
    if pid is not None:
        return df.where(F.col("pid") == pid)
    if comm:
        cmd = F.coalesce(F.col("command"), F.lit("")) if "command" in df.columns else F.lit("")
        return df.where(F.coalesce(F.col("comm"), F.lit("")).contains(comm) | cmd.contains(comm))
    return df


def merge_sources(*dfs: DataFrame) -> DataFrame:
    """One stream/table from several sources (columns aligned by name)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


ORDERS = {
    "process_nodes": [("start_timestamp_ms", True), ("pid", True), ("id", True)],
    "sessions": [("start_timestamp_ms", True), ("id", True)],
    "resource_samples": [("timestamp_ms", True), ("pid", True), ("comm", True)],
    "network_targets": [("count", False), ("host", True), ("path", True)],
    "audit_events": [("timestamp_ms", True), ("id", True)],
}


def ordered(name: str, df: DataFrame) -> DataFrame:
    """The deterministic export order of a table (nulls first, as in the
    reference's Option ordering)."""
    cols = [F.col(c).asc_nulls_first() if asc else F.col(c).desc_nulls_last() for c, asc in ORDERS[name]]
    return df.orderBy(*cols)
