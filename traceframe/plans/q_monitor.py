"""Audit views, network targets, resources and monitoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import monitor as M
from ..operators import process as P
from ..operators import resources as R
from ..sources import fixtures as FX
from .registry import register
from .sql_common import AUDIT, PROCESS_CTES, parent_ctes

W = FX.with_fixtures
AUD = [("audit", AUDIT)]


def _audit(spark, sf):
    return P.audit_from_events(FX.canonical_events(spark, sf))


_COUNTERS = """count(*) FILTER (WHERE audit_type = 'process' AND action = 'exec') AS process_execs,
    count(*) FILTER (WHERE audit_type = 'process' AND action = 'exit') AS process_exits,
    count(*) FILTER (WHERE audit_type = 'process' AND action = 'exit' AND status = 'success') AS process_exit_success,
    count(*) FILTER (WHERE audit_type = 'process' AND action = 'exit' AND status = 'failure') AS process_exit_failure,
    count(*) FILTER (WHERE audit_type = 'file') AS file_events,
    count(DISTINCT CASE WHEN audit_type = 'file' THEN target END) AS unique_files,
    count(*) FILTER (WHERE audit_type = 'network') AS network_events,
    count(DISTINCT pid) AS pids"""


@register("a6_audit_counters", W(["canon"], f"SELECT {_COUNTERS} FROM audit", AUD))
def a6_audit_counters(spark, sf):
    return A.audit_counters(_audit(spark, sf))


@register("a6_audit_counters_by_pid",
          W(["canon"], f"SELECT pid, {_COUNTERS} FROM audit WHERE pid IS NOT NULL GROUP BY pid", AUD))
def a6_audit_counters_by_pid(spark, sf):
    return A.audit_counters(_audit(spark, sf), by_pid=True)


@register("f15_audit_rows", W(["canon"], "SELECT * FROM audit WHERE audit_type = 'file' "
                                         "ORDER BY timestamp_ms DESC, id LIMIT 100", AUD))
def f15_audit_rows(spark, sf):
    return A.audit_rows(_audit(spark, sf), "file", 100)


@register("t1_top_targets", W(["canon"], "SELECT target AS key, count(*) AS count FROM audit "
                                         "WHERE target IS NOT NULL GROUP BY target "
                                         "ORDER BY count DESC, key LIMIT 10", AUD))
def t1_top_targets(spark, sf):
    return A.top_counts(_audit(spark, sf), "target", 10)


@register("t6_recent_failures", W(["canon"], "SELECT id, timestamp_ms, pid, coalesce(target, 'failure') AS failure "
                                             "FROM audit WHERE status = 'failure' "
                                             "ORDER BY timestamp_ms DESC, id DESC LIMIT 10", AUD))
def t6_recent_failures(spark, sf):
    return A.recent_failures(_audit(spark, sf), 10)


@register("t7_retain_recent_samples", W(["resource_samples"],
                                        "SELECT * FROM resource_samples ORDER BY seq DESC LIMIT 2000"))
def t7_retain_recent_samples(spark, sf):
    return A.retain_recent(FX.resource_samples(spark, sf), 2000, ("seq",))


@register("t8_audit_tail", W(["canon"], "SELECT * FROM (SELECT * FROM audit ORDER BY timestamp_ms DESC, id DESC "
                                        "LIMIT 1000) ORDER BY timestamp_ms, id", AUD))
def t8_audit_tail(spark, sf):
    return A.audit_tail(_audit(spark, sf), 1000)


@register("a5_network_targets", W(["canon"], """
    SELECT arg_min(pid, seq) AS pid, arg_min(comm, seq) AS comm, host, nullif(coalesce(path, ''), '') AS path,
        count(*) AS count,
        CAST(sum(CASE WHEN status_code >= 400 THEN 1 ELSE 0 END) AS BIGINT) AS error_count,
        min(timestamp_ms) AS first_timestamp_ms, max(timestamp_ms) AS last_timestamp_ms
    FROM canon WHERE host IS NOT NULL AND host <> ''
    GROUP BY coalesce(pid, 0), host, coalesce(path, '')
    ORDER BY count DESC, host, path"""))
def a5_network_targets(spark, sf):
    return A.network_targets(A.network_rows(FX.canonical_events(spark, sf)))


@register("w10_edge_samples", W(["canon"], """
    SELECT pid, host, cnt, rank_kind FROM (
      SELECT *, CASE WHEN n <= 10 THEN 'all' WHEN rt <= 5 THEN 'top' WHEN rb <= 5 THEN 'bottom' END AS rank_kind
      FROM (SELECT *, row_number() OVER (PARTITION BY pid, rt <= 5 ORDER BY cnt ASC, host ASC) AS rb
            FROM (SELECT *, count(*) OVER (PARTITION BY pid) AS n,
                         row_number() OVER (PARTITION BY pid ORDER BY cnt DESC, host ASC) AS rt
                  FROM (SELECT pid, host, count(*) AS cnt FROM canon WHERE event = 'NET_CONNECT'
                        GROUP BY pid, host))))
    WHERE rank_kind IS NOT NULL"""))
def w10_edge_samples(spark, sf):
    c = FX.canonical_events(spark, sf)
    counts = (c.where(F.col("event") == "NET_CONNECT").groupBy("pid", "host")
              .agg(F.count(F.lit(1)).alias("cnt")))
    return A.edge_samples(counts, ["pid"], "cnt", "host", 5)


@register("f10_resource_rows", W(["resource_samples"], """
    SELECT seq, timestamp_ms, pid, comm, TRY_CAST(CAST(cpu_percent AS VARCHAR) AS DOUBLE) AS cpu_percent,
        CAST(floor(greatest(TRY_CAST(CAST(rss_mb - 300 AS VARCHAR) AS DOUBLE), 0)) AS BIGINT) AS rss_mb
    FROM resource_samples"""))
def f10_resource_rows(spark, sf):
    s = FX.resource_samples(spark, sf).select(
        "seq", "timestamp_ms", "pid", "comm", F.col("cpu_percent").cast("string").alias("cpu"),
        (F.col("rss_mb") - 300).cast("string").alias("rss_mb"))
    return R.resource_rows(s, "cpu", "rss_mb")


@register("a7_resource_peaks", W(["resource_samples"], """
    SELECT coalesce(max(cpu_percent), 0) AS max_cpu_percent,
        CAST(coalesce(max(greatest(rss_mb, 0)), 0) AS BIGINT) AS max_rss_mb, count(*) AS samples
    FROM resource_samples"""))
def a7_resource_peaks(spark, sf):
    return R.resource_peaks(FX.resource_samples(spark, sf))


@register("a8_resource_stats", W(["resource_samples"], """
    SELECT pid, comm, round(avg(cpu_percent), 4) AS avg_cpu_percent, max(cpu_percent) AS max_cpu_percent,
        round(avg(rss_mb), 4) AS avg_rss_mb, max(rss_mb) AS max_rss_mb, count(*) AS samples
    FROM resource_samples GROUP BY pid, comm"""))
def a8_resource_stats(spark, sf):
    return R.resource_stats(FX.resource_samples(spark, sf))


_W6 = """SELECT seq, sample_ts, pid, starttime_ticks, rss_kb,
    round(CASE WHEN lag(sample_ts) OVER w IS NOT NULL AND (sample_ts - lag(sample_ts) OVER w) / 1000 > 0
          THEN (greatest(ticks - lag(ticks) OVER w, 0) / 100) / ((sample_ts - lag(sample_ts) OVER w) / 1000) * 100
          ELSE (ticks / 100) / greatest(uptime_s - starttime_ticks / 100, 0.001) * 100 END, 4) AS cpu_percent,
    CAST(coalesce(greatest(ticks - lag(ticks) OVER w, 0) * 10, 0) AS BIGINT) AS cpu_ms,
    CAST(coalesce(greatest(read_bytes - lag(read_bytes) OVER w, 0), 0) AS BIGINT) AS read_delta,
    CAST(coalesce(greatest(write_bytes - lag(write_bytes) OVER w, 0), 0) AS BIGINT) AS write_delta
    FROM proc_samples WINDOW w AS (PARTITION BY pid, starttime_ticks ORDER BY sample_ts, seq)"""


@register("w6_cpu_io_delta", W(["proc_samples"], "SELECT * FROM w6", [("w6", _W6)]))
def w6_cpu_io_delta(spark, sf):
    return R.cpu_io_delta(FX.proc_samples(spark, sf))


@register("a33_monitor_windows", W(["proc_samples"], """
    SELECT 's-' || (pid % 10) AS session_id, sample_ts // 2000 * 2000 AS window_start,
        CAST(sum(cpu_ms) AS BIGINT) AS cpu_ms, max(rss_kb) AS max_rss_kb,
        CAST(sum(read_delta) AS BIGINT) AS read_bytes, CAST(sum(write_delta) AS BIGINT) AS write_bytes,
        count(DISTINCT pid) AS processes, min(sample_ts) AS first_seen_ms, max(sample_ts) AS last_seen_ms
    FROM w6 GROUP BY 1, 2""", [("w6", _W6)]))
def a33_monitor_windows(spark, sf):
    d = R.cpu_io_delta(FX.proc_samples(spark, sf)).withColumn(
        "session_id", F.format_string("s-%d", F.col("pid") % 10))
    return M.monitor_windows(d, 2000)


_LINEAGE = [
    ("edges", "SELECT DISTINCT pid, ppid FROM proc_samples WHERE pid IS NOT NULL"),
    ("up", "SELECT pid, pid AS anc, 0 AS depth FROM edges UNION ALL "
           "SELECT up.pid, e.ppid, up.depth + 1 FROM up JOIN edges e ON up.anc = e.pid "
           "WHERE e.ppid <> e.pid AND e.ppid IS NOT NULL"),
    ("lineage", "SELECT pid, arg_max(anc, depth) AS root_pid, max(depth) AS depth FROM up GROUP BY pid"),
]


@register("a32_family_metrics", W(["proc_samples"], """
    SELECT root_pid, snapshot, round(sum(cpu_percent), 4) AS cpu_percent, sum(rss_kb) / 1024 AS rss_mb, sum(vsz_kb) / 1024 AS vsz_mb,
        count(*) AS processes, (round(sum(cpu_percent), 4) > 80.0 OR sum(rss_kb) / 1024 > 1024.0) AS alert
    FROM (SELECT pid, sample_ts // 60000 AS snapshot,
                 last(cpu_percent ORDER BY sample_ts, seq) AS cpu_percent,
                 last(rss_kb ORDER BY sample_ts, seq) AS rss_kb, last(vsz_kb ORDER BY sample_ts, seq) AS vsz_kb
          FROM proc_samples GROUP BY pid, snapshot) s JOIN lineage USING (pid)
    GROUP BY root_pid, snapshot""", _LINEAGE, recursive=True))
def a32_family_metrics(spark, sf):
    proc = FX.proc_samples(spark, sf)
    lin = P.process_lineage(proc.select("pid", "ppid").distinct())
    return R.family_metrics(proc, lin)


@register("a31_summarize_events", W(["canon"], """
    SELECT timestamp_ms // 5000 * 5000 AS interval_start, pid, event AS type, coalesce(path, host) AS detail,
        count(*) AS count, CAST(sum(k * 100) AS BIGINT) AS total_bytes,
        min(timestamp_ms) AS first_ts, max(timestamp_ms) AS last_ts
    FROM canon GROUP BY 1, 2, 3, 4"""))
def a31_summarize_events(spark, sf):
    c = FX.canonical_events(spark, sf).select(
        "timestamp_ms", "pid", F.col("event").alias("type"),
        F.coalesce("path", "host").alias("detail"), (F.col("k") * 100).alias("bytes"))
    return M.summarize_events(c, 5000)


_FO = PROCESS_CTES + [
    ("fo", "SELECT seq, timestamp_ms, pid, path, flags FROM canon WHERE event = 'FILE_OPEN'"),
    ("foc", "SELECT f.seq, n.id AS process_id, coalesce(n.start_timestamp_ms, 0) AS s, "
            "n.start_timestamp_ms IS NOT NULL AS hs FROM fo f JOIN nodes n ON f.pid = n.pid "
            "AND coalesce(n.start_timestamp_ms, 0) <= f.timestamp_ms "
            "AND (n.end_timestamp_ms IS NULL OR f.timestamp_ms <= n.end_timestamp_ms)"),
    ("fo2", "SELECT f.*, b.process_id FROM fo f LEFT JOIN (SELECT seq, process_id FROM foc QUALIFY "
            "row_number() OVER (PARTITION BY seq ORDER BY s DESC, hs DESC, process_id DESC) = 1) b "
            "ON f.seq = b.seq"),
    ("g", "SELECT *, CASE WHEN lag(timestamp_ms) OVER w IS NULL OR timestamp_ms - lag(timestamp_ms) OVER w > 60000 "
          "THEN 1 ELSE 0 END AS nb FROM fo2 WINDOW w AS (PARTITION BY pid, path, process_id ORDER BY timestamp_ms, seq)"),
    ("h", "SELECT *, sum(nb) OVER (PARTITION BY pid, path, process_id ORDER BY timestamp_ms, seq "
          "ROWS UNBOUNDED PRECEDING) AS grp FROM g"),
]


@register("r6_collapse_file_opens", W(["canon"], """
    SELECT pid, path, process_id, first(flags ORDER BY timestamp_ms, seq) AS flags, count(*) AS count,
        min(timestamp_ms) AS first_timestamp_ms, max(timestamp_ms) AS last_timestamp_ms
    FROM h GROUP BY pid, path, process_id, grp""", _FO))
def r6_collapse_file_opens(spark, sf):
    canon = FX.canonical_events(spark, sf)
    fo = canon.where(F.col("event") == "FILE_OPEN").select("seq", "timestamp_ms", "pid", "path", "flags")
    fo = P.attach_process(fo, P.process_nodes(canon), key="seq")
    return M.collapse_file_opens(fo, 60_000)


@register("r7_rate_limit", W(["canon"], """
    SELECT seq, timestamp_ms, pid, path, rn = 31 AS rate_limited FROM (
        SELECT seq, timestamp_ms, pid, path, row_number() OVER (PARTITION BY pid, timestamp_ms // 1000
            ORDER BY timestamp_ms, seq) AS rn FROM canon WHERE event = 'FILE_OPEN') WHERE rn <= 31"""))
def r7_rate_limit(spark, sf):
    fo = FX.canonical_events(spark, sf).where(F.col("event") == "FILE_OPEN").select(
        "seq", "timestamp_ms", "pid", "path")
    return M.rate_limit(fo, 30)


# ---- T2 top sections, U3 process timeline ------------------------------------

from ..operators import tokens as T  # noqa: E402
from ..operators import sessionlog as SL  # noqa: E402
from .sql_common import TOKEN_SESSION_CTES  # noqa: E402


def _top_sections(spark, sf):
    canon = FX.canonical_events(spark, sf)
    audit = P.audit_from_events(canon)
    targets = A.network_targets(A.network_rows(canon))
    models = T.token_summary(FX.token_usage(spark, sf), FX.llm_calls(spark, sf), FX.sessions(spark, sf))
    tools = SL.session_events(FX.session_jsonl(spark, sf))[1]
    return A.top_sections(audit, targets, models, tools, None, 10, "all")


_TOP = """SELECT section, unit, key, count, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY section ORDER BY count DESC, key) AS rank FROM (
      SELECT 'Processes' AS section, 'execs' AS unit, coalesce(comm, target, 'unknown') AS key, count(*) AS count
        FROM audit WHERE audit_type = 'process' AND action = 'exec' GROUP BY 3
      UNION ALL SELECT 'Files', 'events', target, count(*) FROM audit WHERE audit_type = 'file' AND target IS NOT NULL GROUP BY 3
      UNION ALL SELECT 'Network', 'events', host, CAST(sum(greatest(cnt, 0)) AS BIGINT) FROM (
          SELECT host, count(*) AS cnt FROM canon WHERE host IS NOT NULL AND host <> ''
          GROUP BY coalesce(pid, 0), host, coalesce(path, '')) GROUP BY host
      UNION ALL SELECT 'Models', 'tokens', "group", CAST(sum(greatest(total_tokens, 0)) AS BIGINT) FROM models GROUP BY 3
      UNION ALL SELECT 'Tools', 'calls', tool_name, count(*) FROM tools WHERE tool_name IS NOT NULL GROUP BY 3))
    WHERE rank <= 10"""


@register("t2_top_sections", None)
def t2_top_sections(spark, sf):
    return _top_sections(spark, sf)


def _register_t2_sql():
    from . import q_sessions as QS
    from .registry import ORACLES
    models = ("SELECT coalesce(nullif(model, ''), 'unknown') AS \"group\", CAST(sum(total_tokens) AS BIGINT) AS total_tokens "
              "FROM tks GROUP BY 1")
    ORACLES["t2_top_sections"] = W(["canon", "token_usage", "llm_calls", "sessions", "session_jsonl"], _TOP,
                                   [("audit", AUDIT)] + TOKEN_SESSION_CTES + [("models", models)] + QS._P1_SQL)


@register("u3_process_timeline", W(["canon"], """
    SELECT process_id, timestamp_ms, item_type, item_id FROM (
        SELECT b.process_id, a.timestamp_ms, 'event' AS item_type, a.id AS item_id FROM audit a
        JOIN (SELECT id, process_id FROM cand QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, hs DESC, process_id DESC) = 1) b
          ON a.id = b.id
        UNION ALL
        SELECT p.parent_id, coalesce(n.start_timestamp_ms, 0), 'process', p.child_id FROM pedges p
        JOIN nodes n ON n.id = p.child_id)
    ORDER BY process_id, timestamp_ms, item_type, item_id""", [("audit", AUDIT)] + PROCESS_CTES + [
    ("cand", "SELECT a.id, n.id AS process_id, coalesce(n.start_timestamp_ms, 0) AS s, "
             "n.start_timestamp_ms IS NOT NULL AS hs FROM audit a JOIN nodes n ON a.pid = n.pid "
             "AND coalesce(n.start_timestamp_ms, 0) <= a.timestamp_ms "
             "AND (n.end_timestamp_ms IS NULL OR a.timestamp_ms <= n.end_timestamp_ms)")] + parent_ctes()))
def u3_process_timeline(spark, sf):
    canon = FX.canonical_events(spark, sf)
    nodes = P.process_nodes(canon)
    att = P.attach_process(P.audit_from_events(canon), nodes)
    return P.process_timeline(att, P.process_parents(nodes), nodes)


# ---- T3 / T5 agent rows, J17 monitor top, J12 latest session path --------------

def _agent_rows(spark, sf):
    """One row per pid: agent (comm), peak cpu and rss, effective tokens,
    execs, failed exits, file and network events."""
    canon = FX.canonical_events(spark, sf)
    counters = A.audit_counters(P.audit_from_events(canon), by_pid=True)
    res = FX.resource_samples(spark, sf).groupBy("pid").agg(
        F.max("cpu_percent").alias("cpu_percent"), F.max("rss_mb").alias("rss_mb"), F.max("comm").alias("agent"))
    tok = (T.effective_tokens(FX.token_usage(spark, sf)).groupBy("pid")
           .agg(F.sum("total_tokens").cast("bigint").alias("tokens")))
    return (res.join(counters, "pid", "left").join(tok, "pid", "left")
            .select("pid", "agent", "cpu_percent", "rss_mb", "tokens",
                    F.coalesce("process_execs", F.lit(0)).alias("execs"),
                    F.coalesce("process_exit_failure", F.lit(0)).alias("failures"),
                    F.coalesce("file_events", F.lit(0)).alias("files"),
                    F.coalesce("network_events", F.lit(0)).alias("network")))


_AGENT_SQL = [("audit", AUDIT), ("eff", "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY "
               "coalesce(nullif(llm_call_id, ''), id) ORDER BY CASE source WHEN 'response_usage' THEN 0 "
               "WHEN 'orphan_response_usage' THEN 1 WHEN 'gemini_cli_stdout_stats' THEN 2 WHEN 'claude_telemetry' THEN 3 "
               "WHEN 'agent_native_session' THEN 4 ELSE 5 END, coalesce(confidence, 0) DESC, id) AS rn FROM token_usage) "
               "WHERE rn = 1"),
              ("agent_rows", """SELECT r.pid, r.agent, r.cpu_percent, r.rss_mb, t.tokens,
                    coalesce(c.execs, 0) AS execs, coalesce(c.failures, 0) AS failures,
                    coalesce(c.files, 0) AS files, coalesce(c.network, 0) AS network
                FROM (SELECT pid, max(cpu_percent) AS cpu_percent, max(rss_mb) AS rss_mb, max(comm) AS agent
                      FROM resource_samples GROUP BY pid) r
                LEFT JOIN (SELECT pid, count(*) FILTER (WHERE audit_type = 'process' AND action = 'exec') AS execs,
                      count(*) FILTER (WHERE audit_type = 'process' AND action = 'exit' AND status = 'failure') AS failures,
                      count(*) FILTER (WHERE audit_type = 'file') AS files,
                      count(*) FILTER (WHERE audit_type = 'network') AS network FROM audit GROUP BY pid) c ON r.pid = c.pid
                LEFT JOIN (SELECT pid, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM eff GROUP BY pid) t ON r.pid = t.pid""")]


@register("t3_agent_rows", W(["canon", "resource_samples", "token_usage"], "SELECT * FROM agent_rows", _AGENT_SQL))
def t3_agent_rows(spark, sf):
    return _agent_rows(spark, sf)


@register("t5_sort_agent_rows", W(["canon", "resource_samples", "token_usage"], """
    SELECT * FROM agent_rows ORDER BY coalesce(failures, 0) DESC, cpu_percent DESC, rss_mb DESC, agent, pid LIMIT 20""",
    _AGENT_SQL))
def t5_sort_agent_rows(spark, sf):
    return M.sort_agent_rows(_agent_rows(spark, sf), "fail", 20)


@register("j17_monitor_top", W(["proc_samples"], """
    SELECT w.session_id, w.window_start, w.cpu_ms, w.max_rss_kb, w.read_bytes, w.write_bytes, w.processes,
        w.first_seen_ms, w.last_seen_ms, round(w.cpu_ms / 2000 * 100, 4) AS cpu_percent
    FROM (SELECT * FROM win QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY window_start DESC) = 1) w
    WHERE w.session_id IN (SELECT 's-' || (pid % 10) FROM proc_samples)""",
    [("w6", _W6), ("win", """SELECT 's-' || (pid % 10) AS session_id, sample_ts // 2000 * 2000 AS window_start,
        CAST(sum(cpu_ms) AS BIGINT) AS cpu_ms, max(rss_kb) AS max_rss_kb,
        CAST(sum(read_delta) AS BIGINT) AS read_bytes, CAST(sum(write_delta) AS BIGINT) AS write_bytes,
        count(DISTINCT pid) AS processes, min(sample_ts) AS first_seen_ms, max(sample_ts) AS last_seen_ms
        FROM w6 GROUP BY 1, 2""")]))
def j17_monitor_top(spark, sf):
    d = R.cpu_io_delta(FX.proc_samples(spark, sf)).withColumn(
        "session_id", F.format_string("s-%d", F.col("pid") % 10))
    windows = M.monitor_windows(d, 2000)
    tracked = FX.proc_samples(spark, sf).select(
        F.format_string("s-%d", F.col("pid") % 10).alias("session_id"))
    return M.monitor_top(windows, tracked, 2000)


@register("j12_latest_session_path", W(["canon"], """
    SELECT b.process_id, arg_max(a.target, (a.timestamp_ms, a.id)) AS latest_path, max(a.timestamp_ms) AS latest_ms
    FROM audit a JOIN (SELECT id, process_id FROM cand
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, hs DESC, process_id DESC) = 1) b ON a.id = b.id
    WHERE a.audit_type = 'file' GROUP BY b.process_id""", [("audit", AUDIT)] + PROCESS_CTES + [
    ("cand", "SELECT a.id, n.id AS process_id, coalesce(n.start_timestamp_ms, 0) AS s, "
             "n.start_timestamp_ms IS NOT NULL AS hs FROM audit a JOIN nodes n ON a.pid = n.pid "
             "AND coalesce(n.start_timestamp_ms, 0) <= a.timestamp_ms "
             "AND (n.end_timestamp_ms IS NULL OR a.timestamp_ms <= n.end_timestamp_ms)")]))
def j12_latest_session_path(spark, sf):
    """The latest file observed for each process instance after it
    started (file audit rows attached by the J5 interval join)."""
    canon = FX.canonical_events(spark, sf)
    att = P.attach_process(P.audit_from_events(canon), P.process_nodes(canon))
    return (att.where((F.col("audit_type") == "file") & F.col("process_id").isNotNull())
            .groupBy("process_id")
            .agg(F.max_by("target", F.struct("timestamp_ms", "id")).alias("latest_path"),
                 F.max("timestamp_ms").alias("latest_ms")))


TRACES = ["db", "local+db", "proc_fd", "sticky+db", "ebpf_file", ""]


@register("t10_label_rows", W(["canon", "resource_samples", "token_usage"], f"""
    SELECT pid, agent, failures, trace,
        CASE WHEN list_has_any(toks, ['proc', 'proc_fd', 'sticky', 'cwd_recent']) THEN 'live'
             WHEN coalesce(failures, 0) > 0 THEN 'failed'
             WHEN list_has_any(toks, ['local', 'agent-native']) THEN 'history'
             WHEN list_contains(toks, 'db') THEN 'saved' ELSE '-' END AS state,
        list_has_any(toks, ['ebpf_file', 'proc_fd', 'sticky']) AS session_path_link
    FROM (SELECT *, string_split(trace, '+') AS toks FROM (
        SELECT pid, agent, failures, {"[" + ", ".join("'" + t + "'" for t in TRACES) + "]"}[pid % 6 + 1] AS trace FROM agent_rows))""",
    _AGENT_SQL))
def t10_label_rows(spark, sf):
    rows = _agent_rows(spark, sf).withColumn(
        "trace", F.element_at(F.array(*[F.lit(t) for t in TRACES]), (F.col("pid") % 6 + 1).cast("int")))
    return M.label_rows(rows).select("pid", "agent", "failures", "trace", "state", "session_path_link")
