"""Event summaries, file-open collapse, rate limiting and monitor windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import prev_value, running_sum


def summarize_events(events: DataFrame, interval_ms: int = 5_000,
                     detail_col: str = "detail", bytes_col: str = "bytes") -> DataFrame:
    """Per (flush interval, pid, type, detail): count, bytes, first/last ts.

    A plain grouped aggregate, so it is combined map-side like the in-kernel
    summary maps it replaces.
    """
    return (events.withColumn("interval_start", F.expr(f"timestamp_ms div {int(interval_ms)}") * interval_ms)
            .groupBy("interval_start", "pid", "type", detail_col)
            .agg(F.count(F.lit(1)).alias("count"),
                 F.sum(bytes_col).cast("bigint").alias("total_bytes"),
                 F.min("timestamp_ms").alias("first_ts"),
                 F.max("timestamp_ms").alias("last_ts")))


def collapse_file_opens(opens: DataFrame, window_ms: int = 60_000,
                        instance_col: str = "process_id", bucket_ms: int = 3_600_000) -> DataFrame:
    """Repeated opens of one (pid, path) within ``window_ms`` of the last
    one collapse into one row with a count; flags of the first open are kept;
    a process exit (a new instance) splits.

    Gaps and islands: the previous open of a (pid, path, instance) and the
    number of islands before it come from two-level scans, so a path that is
    opened all the time is no single window; an island is a partial aggregate.
    (The stream form uses ``session_window``.)
    """
    keys = ["pid", "path"] + ([instance_col] if instance_col in opens.columns else [])
    bucket, order = F.expr(f"timestamp_ms div {int(bucket_ms)}"), ["timestamp_ms", "seq"]
    x = opens.select(F.struct(*keys).alias("_k"), *order, "flags")
    x = prev_value(x, ["_k"], bucket, order, "timestamp_ms", "_before")
    gap = F.col("_before").isNull() | (F.col("timestamp_ms") - F.col("_before") > window_ms)
    x = running_sum(x, ["_k"], bucket, order, gap.cast("bigint"), "_island")
    return (x.groupBy("_k", "_island")
            .agg(F.min_by("flags", F.struct(*order)).alias("flags"), F.count(F.lit(1)).alias("count"),
                 F.min("timestamp_ms").alias("first_timestamp_ms"), F.max("timestamp_ms").alias("last_timestamp_ms"))
            .select("_k.*", "flags", "count", "first_timestamp_ms", "last_timestamp_ms"))


def rate_limit(events: DataFrame, per_second: int = 30) -> DataFrame:
    """Keep at most ``per_second`` events per (pid, second); the next one
    becomes a warning row (``rate_limited = true``), the rest are dropped."""
    w = Window.partitionBy("pid", F.expr("timestamp_ms div 1000")).orderBy("timestamp_ms", "seq")
    x = events.withColumn("_rn", F.row_number().over(w))
    return (x.where(F.col("_rn") <= per_second + 1)
            .withColumn("rate_limited", F.col("_rn") == per_second + 1).drop("_rn"))


def monitor_windows(samples: DataFrame, window_ms: int = 2_000) -> DataFrame:
    """Per session and tumbling window: summed cpu_ms, rss, io; distinct
    targets; first/last sample time."""
    return (samples.withColumn("window_start", F.expr(f"sample_ts div {int(window_ms)}") * window_ms)
            .groupBy("session_id", "window_start")
            .agg(F.sum("cpu_ms").cast("bigint").alias("cpu_ms"),
                 F.max("rss_kb").alias("max_rss_kb"),
                 F.sum("read_delta").cast("bigint").alias("read_bytes"),
                 F.sum("write_delta").cast("bigint").alias("write_bytes"),
                 F.count_distinct("pid").alias("processes"),
                 F.min("sample_ts").alias("first_seen_ms"),
                 F.max("sample_ts").alias("last_seen_ms")))


def monitor_top(windows: DataFrame, tracked: DataFrame, window_ms: int = 2_000) -> DataFrame:
    """The latest window of every tracked session (``max_by`` per
    session, a partial aggregate) with cpu% = cpu_ms / window_ms · 100."""
    cols = [c for c in windows.columns if c != "session_id"]
    latest = (windows.groupBy("session_id").agg(F.max_by(F.struct(*cols), "window_start").alias("_w"))
              .select("session_id", "_w.*"))
    return (tracked.select("session_id").distinct().join(latest, "session_id")
            .withColumn("cpu_percent", F.round(F.col("cpu_ms") / window_ms * 100, 4)))


SORT_KEYS = {"rss": "rss", "mem": "rss", "memory": "rss", "tokens": "tokens", "token": "tokens",
             "exec": "execs", "execs": "execs", "fail": "fail", "fails": "fail", "failure": "fail",
             "failures": "fail", "file": "files", "files": "files", "net": "net", "network": "net",
             "agent": "agent", "name": "agent", "command": "agent"}


def sort_agent_rows(rows: DataFrame, key: str = "cpu", n: int | None = None) -> DataFrame:
    """T5: order by the chosen key (cpu, rss, tokens, execs, fail, files,
    net: descending; agent: ascending), then cpu desc, rss desc, agent, pid.
    With ``n`` the first n rows (a top-k)."""
    k = SORT_KEYS.get(key.lower(), "cpu")
    col = {"rss": "rss_mb", "tokens": "tokens", "execs": "execs", "fail": "failures", "files": "files",
           "net": "network", "cpu": "cpu_percent"}
    primary = [F.col("agent").asc()] if k == "agent" else [F.coalesce(F.col(col[k]), F.lit(0)).desc()]
    out = rows.orderBy(*primary, F.col("cpu_percent").desc(), F.col("rss_mb").desc(), F.col("agent").asc(),
                       F.col("pid").asc())
    return out.limit(n) if n else out


# Evidence tokens of a row's trace that imply a live process link.
PROC_TOKENS = ["proc", "proc_fd", "sticky", "cwd_recent"]
HISTORY_TOKENS = ["local", "agent-native"]
PATH_LINK_TOKENS = ["ebpf_file", "proc_fd", "sticky"]


def label_rows(rows: DataFrame, trace_col: str = "trace") -> DataFrame:
    """State label from the '+'-joined evidence trace and failures
    (live / failed / history / saved / '-') and whether the row is linked to
    a session log path."""
    toks = F.split(F.coalesce(F.col(trace_col), F.lit("")), r"\+")
    has = lambda words: F.arrays_overlap(toks, F.array(*[F.lit(w) for w in words]))
    state = (F.when(has(PROC_TOKENS), "live").when(F.coalesce(F.col("failures"), F.lit(0)) > 0, "failed")
             .when(has(HISTORY_TOKENS), "history").when(F.array_contains(toks, "db"), "saved").otherwise("-"))
    return rows.withColumn("state", state).withColumn("session_path_link", has(PATH_LINK_TOKENS))
