"""Token accounting: effective token rows, session/dir attribution, summaries.

All operators are declarative aggregations: the per-key choices (best token
row per call, first matching session per token) are ``min(struct(...))``
aggregates, which Spark combines map-side before the shuffle. A call id or
session that owns a third of all rows therefore costs one partial-aggregate
row per input partition, not one giant window partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import empty_to_unknown, file_directory, token_source_priority

TOKEN_COLS = ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens",
              "total_tokens"]


def effective_tokens(tokens: DataFrame) -> DataFrame:
    """One token row per call (key = call id, else own id).

    Order of preference: source priority 0..5, confidence desc (null = 0),
    id asc.  Implemented as ``min(struct(prio, -conf, id, row))`` per key —
    a partial aggregate, so skewed keys are combined before the exchange.
    """
    key = F.coalesce(F.nullif(F.col("llm_call_id"), F.lit("")), F.col("id"))
    payload = [c for c in tokens.columns]
    best = F.min(F.struct(
        token_source_priority(F.col("source")).alias("_prio"),
        (-F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))).alias("_nconf"),
        F.col("id").alias("_id"),
        F.struct(*payload).alias("_row")))
    return (tokens.withColumn("token_key", key)
            .groupBy("token_key").agg(best.alias("_best"))
            .select("token_key", "_best._row.*"))


def latest_calls(calls: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """S7 replace-by-id read side: the last arrival (max seq) per id wins."""
    cols = [c for c in calls.columns]
    return (calls.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_r"))
            .select("_r.*"))


def dash_prefixes(col) -> "F.Column":
    """All prefixes p of ``col`` with p == col or col starting with p + '-'."""
    parts = F.split(col, "-", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)),
                       lambda i: F.array_join(F.slice(parts, 1, i), "-"))


def token_session_key(tokens: DataFrame, calls: DataFrame, sessions: DataFrame) -> DataFrame:
    """Session of each token row.

    First the call's session id (call looked up by ``llm_call_id``), else the
    smallest session id equal to the call id or a '-'-prefix of it. The prefix
    test becomes an equi join on the exploded dash-prefixes, so it is a hash
    join instead of a token × session scan.
    Returns ``tokens`` + ``session_key``.
    """
    call_sessions = (latest_calls(calls)
                     .select(F.col("id").alias("_cid"),
                             F.nullif(F.col("session_id"), F.lit("")).alias("_call_session")))
    t = tokens.join(call_sessions, tokens["llm_call_id"] == call_sessions["_cid"], "left").drop("_cid")
    need = (t.where(F.col("_call_session").isNull() & (F.col("llm_call_id") != ""))
            .select(F.col("id").alias("_tid"),
                    F.explode(F.array_distinct(dash_prefixes(F.col("llm_call_id")))).alias("_prefix")))
    sess_ids = sessions.select(F.col("id").alias("_prefix")).distinct()
    by_prefix = (need.join(sess_ids, "_prefix")
                 .groupBy("_tid").agg(F.min("_prefix").alias("_prefix_session")))
    return (t.join(by_prefix, t["id"] == by_prefix["_tid"], "left")
            .withColumn("session_key", F.coalesce("_call_session", "_prefix_session"))
            .drop("_call_session", "_tid", "_prefix_session"))


def process_cwd_by_pid(processes: DataFrame) -> DataFrame:
    """First non-empty cwd per pid in process-id order."""
    return (processes.where(F.col("cwd").isNotNull() & (F.col("cwd") != ""))
            .groupBy("pid").agg(F.min_by("cwd", "id").alias("_proc_cwd")))


def token_working_dir(tokens_with_session: DataFrame, calls: DataFrame, sessions: DataFrame,
                      processes: DataFrame) -> DataFrame:
    """Session cwd, else the process cwd of the token's (or call's) pid."""
    s = sessions.select(F.col("id").alias("_sid"),
                        F.nullif(F.col("cwd"), F.lit("")).alias("_sess_cwd"))
    c = latest_calls(calls).select(F.col("id").alias("_cid2"), F.col("pid").alias("_call_pid"))
    t = (tokens_with_session
         .join(s, F.col("session_key") == F.col("_sid"), "left")
         .join(c, F.col("llm_call_id") == F.col("_cid2"), "left")
         .withColumn("_pid", F.coalesce(F.col("pid"), F.col("_call_pid"))))
    p = process_cwd_by_pid(processes).withColumnRenamed("pid", "_ppid")
    t = t.join(p, F.col("_pid") == F.col("_ppid"), "left")
    return (t.withColumn("working_dir", F.coalesce("_sess_cwd", "_proc_cwd"))
            .drop("_sid", "_sess_cwd", "_cid2", "_call_pid", "_pid", "_ppid", "_proc_cwd"))


def token_summary(tokens: DataFrame, calls: DataFrame, sessions: DataFrame,
                  processes: DataFrame | None = None, group_by: str = "model") -> DataFrame:
    """A1: sums, calls and distinct sessions per group of effective tokens.

    ``group_by`` is model | provider | comm | pid | dir; empty → 'unknown'.
    Sorted by total desc, group asc.
    """
    eff = effective_tokens(tokens).drop("token_key")
    eff = token_session_key(eff, calls, sessions)
    if group_by in ("dir", "cwd", "directory"):
        if processes is None:
            raise ValueError("group_by=dir needs process nodes")
        eff = token_working_dir(eff, calls, sessions, processes)
        g = F.col("working_dir")
    elif group_by == "pid":
        g = F.col("pid").cast("string")
    elif group_by in ("provider", "comm"):
        g = F.col(group_by)
    else:
        g = F.col("model")
    out = (eff.withColumn("group", empty_to_unknown(g))
           .groupBy("group")
           .agg(*[F.sum(c).cast("bigint").alias(c) for c in TOKEN_COLS],
                F.count(F.lit(1)).alias("calls"),
                F.count_distinct("session_key").alias("sessions")))
    return out.orderBy(F.col("total_tokens").desc(), F.col("group").asc())


def snapshot_summary(tokens: DataFrame, calls: DataFrame, audit: DataFrame,
                     sessions: DataFrame) -> DataFrame:
    """A2: one row of distinct-id counts, effective token totals and time range."""
    eff = effective_tokens(tokens).agg(
        F.sum("input_tokens").cast("bigint").alias("input_tokens"),
        F.sum("output_tokens").cast("bigint").alias("output_tokens"),
        F.sum("total_tokens").cast("bigint").alias("total_tokens"))
    c = calls.agg(F.count_distinct("id").alias("llm_calls"),
                  F.min("start_timestamp_ms").alias("t0"), F.max("end_timestamp_ms").alias("t1"))
    t = tokens.agg(F.count_distinct("id").alias("token_usage_rows"),
                   F.min("timestamp_ms").alias("t0"), F.max("timestamp_ms").alias("t1"))
    a = audit.agg(F.count_distinct("id").alias("audit_events"),
                  F.min("timestamp_ms").alias("t0"), F.max("timestamp_ms").alias("t1"))
    s = sessions.agg(F.count_distinct("id").alias("sessions"),
                     F.min("start_timestamp_ms").alias("t0"), F.max("end_timestamp_ms").alias("t1"))
    # Stack the one-row aggregates and fold them into one row (no join needed).
    parts = eff
    for part in (c, t, a, s):
        parts = parts.unionByName(part, allowMissingColumns=True)
    return parts.agg(
        *[F.max(x).alias(x) for x in ("llm_calls", "token_usage_rows", "audit_events", "sessions",
                                      "input_tokens", "output_tokens", "total_tokens")],
        F.min("t0").alias("start_timestamp_ms"), F.max("t1").alias("end_timestamp_ms"))


def llm_call_rows(calls: DataFrame, tokens: DataFrame, limit: int = 100) -> DataFrame:
    """A4: calls with effective token totals, newest first, the ``limit`` first rows."""
    eff = (effective_tokens(tokens).where(F.col("llm_call_id") != "")
           .select(F.col("llm_call_id").alias("_cid"),
                   F.col("input_tokens").alias("_in"), F.col("output_tokens").alias("_out"),
                   F.col("total_tokens").alias("_tot")))
    c = latest_calls(calls)
    j = c.join(eff, c["id"] == eff["_cid"], "left")
    out = j.select(
        *[x for x in c.columns if x not in ("input_tokens", "output_tokens", "total_tokens")],
        F.coalesce("_in", F.lit(0)).cast("bigint").alias("input_tokens"),
        F.coalesce("_out", F.lit(0)).cast("bigint").alias("output_tokens"),
        F.coalesce("_tot", F.lit(0)).cast("bigint").alias("total_tokens"))
    return out.orderBy(F.col("start_timestamp_ms").desc(), F.col("id").asc()).limit(limit)


def _top_text(df: DataFrame, key, weight, n: int) -> DataFrame:
    """'key(count), ...' of the n largest (count desc, key asc), one row."""
    g = df.groupBy(key.alias("k")).agg(F.sum(weight).cast("bigint").alias("c"))
    top = g.orderBy(F.col("c").desc(), F.col("k").asc()).limit(n)
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("o"), "k", "c"))),
                                            lambda s: F.format_string("%s(%d)", s["k"], s["c"])), ", ").alias("t"))


def run_summary(summary: DataFrame, calls: DataFrame, audit: DataFrame, targets: DataFrame) -> DataFrame:
    """A3: one row per run: duration, first LLM offset, LLM latency stats,
    exec/exit counts, file access (events, first/last offset, unique files,
    top-8 directories) and network events with the top-8 endpoints.

    ``summary`` is the A2 row (start/end). The run start enters the other
    aggregates as a scalar subquery; every part is a global aggregate or a
    top-8, folded into one row without joins."""
    start = summary.select("start_timestamp_ms").scalar()
    c = latest_calls(calls)
    lat = F.when(F.col("end_timestamp_ms") >= F.col("start_timestamp_ms"),
                 F.col("end_timestamp_ms") - F.col("start_timestamp_ms"))
    parts = [
        summary.select(((F.col("end_timestamp_ms") - F.col("start_timestamp_ms")) / 1000).alias("duration_s")),
        c.agg((F.min("start_timestamp_ms") - start).alias("first_llm_after_ms"),
              F.count(lat).alias("llm_latency_count"), F.sum(lat).alias("llm_latency_total_ms"),
              F.max(lat).alias("llm_latency_max_ms"), F.round(F.avg(lat), 4).alias("llm_latency_avg_ms")),
        audit.agg(F.count_if((F.col("audit_type") == "process") & (F.col("action") == "exec")).alias("process_execs"),
                  F.count_if((F.col("audit_type") == "process") & (F.col("action") == "exit")
                             & (F.col("status") == "success")).alias("exit_success"),
                  F.count_if((F.col("audit_type") == "process") & (F.col("action") == "exit")
                             & (F.col("status") == "failure")).alias("exit_failure"),
                  F.count_if(F.col("audit_type") == "file").alias("file_events"),
                  F.count_distinct(F.when(F.col("audit_type") == "file", F.col("target"))).alias("unique_files"),
                  (F.min(F.when(F.col("audit_type") == "file", F.col("timestamp_ms"))) - start).alias("first_file_after_ms"),
                  (F.max(F.when(F.col("audit_type") == "file", F.col("timestamp_ms"))) - start).alias("last_file_after_ms")),
        _top_text(audit.where((F.col("audit_type") == "file") & F.col("target").isNotNull()),
                  file_directory(F.col("target")), F.lit(1), 8).withColumnRenamed("t", "top_directories"),
        targets.agg(F.sum(F.greatest("count", F.lit(0))).cast("bigint").alias("network_events")),
        _top_text(targets, F.when(F.coalesce("path", F.lit("")) != "", F.concat("host", "path")).otherwise(F.col("host")),
                  F.greatest("count", F.lit(0)), 8).withColumnRenamed("t", "top_endpoints"),
    ]
    row = parts[0]
    for p in parts[1:]:
        row = row.unionByName(p, allowMissingColumns=True)
    return row.agg(*[F.max(c).alias(c) for c in row.columns])
