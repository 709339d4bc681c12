"""Token accounting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import process as P
from ..operators import tokens as T
from ..sources import fixtures as FX
from .registry import register
from .sql_common import AUDIT, PROCESS_CTES, TOKEN_SESSION_CTES
from .sql_common import CALLS_LATEST, EFF

W = FX.with_fixtures

TOKEN_COLS_SQL = ("id, llm_call_id, seq, timestamp_ms, pid, comm, provider, model, input_tokens, "
                  "output_tokens, cache_creation_tokens, cache_read_tokens, total_tokens, source, "
                  "view_source, confidence")


@register("w1_effective_tokens",
          W(["token_usage"], f"SELECT token_key, {TOKEN_COLS_SQL} FROM eff", [("eff", EFF)]))
def w1_effective_tokens(spark, sf):
    return T.effective_tokens(FX.token_usage(spark, sf))


@register("s7_upsert_llm_calls", W(["llm_calls"], "SELECT * FROM calls_latest",
                                   [("calls_latest", CALLS_LATEST)]))
def s7_upsert_llm_calls(spark, sf):
    return T.latest_calls(FX.llm_calls(spark, sf))


@register("j3_token_session_key",
          W(["token_usage", "llm_calls", "sessions"], "SELECT id, llm_call_id, session_key FROM tks",
            TOKEN_SESSION_CTES))
def j3_token_session_key(spark, sf):
    eff = T.effective_tokens(FX.token_usage(spark, sf)).drop("token_key")
    return T.token_session_key(eff, FX.llm_calls(spark, sf), FX.sessions(spark, sf)) \
        .select("id", "llm_call_id", "session_key")


_DIR_CTES = TOKEN_SESSION_CTES + PROCESS_CTES + [
    ("pcwd", "SELECT pid, arg_min(cwd, id) AS proc_cwd FROM nodes WHERE cwd IS NOT NULL AND cwd <> '' GROUP BY pid"),
    ("tkd", "SELECT tks.*, coalesce(nullif(s.cwd, ''), p.proc_cwd) AS working_dir FROM tks "
            "LEFT JOIN sessions s ON tks.session_key = s.id "
            "LEFT JOIN calls_latest c ON tks.llm_call_id = c.id "
            "LEFT JOIN pcwd p ON coalesce(tks.pid, c.pid) = p.pid"),
]


@register("j4_token_working_dir",
          W(["token_usage", "llm_calls", "sessions", "canon"],
            "SELECT id, session_key, working_dir FROM tkd", _DIR_CTES))
def j4_token_working_dir(spark, sf):
    eff = T.effective_tokens(FX.token_usage(spark, sf)).drop("token_key")
    calls, sess = FX.llm_calls(spark, sf), FX.sessions(spark, sf)
    t = T.token_session_key(eff, calls, sess)
    nodes = P.process_nodes(FX.canonical_events(spark, sf))
    return T.token_working_dir(t, calls, sess, nodes).select("id", "session_key", "working_dir")


def _summary_sql(group_expr: str, src: str = "tks", ctes=TOKEN_SESSION_CTES, fixtures=None) -> str:
    sel = f"""SELECT coalesce(nullif({group_expr}, ''), 'unknown') AS "group",
        CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
        CAST(sum(cache_creation_tokens) AS BIGINT) AS cache_creation_tokens,
        CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens,
        CAST(sum(total_tokens) AS BIGINT) AS total_tokens, count(*) AS calls,
        count(DISTINCT session_key) AS sessions
        FROM {src} GROUP BY 1 ORDER BY total_tokens DESC, "group" ASC"""
    return W(fixtures or ["token_usage", "llm_calls", "sessions"], sel, ctes)


def _summary(group_by):
    def run(spark, sf):
        nodes = None
        if group_by == "dir":
            nodes = P.process_nodes(FX.canonical_events(spark, sf))
        return T.token_summary(FX.token_usage(spark, sf), FX.llm_calls(spark, sf),
                               FX.sessions(spark, sf), nodes, group_by)
    return run


register("a1_token_summary_model", _summary_sql("model"))(_summary("model"))
register("a1_token_summary_provider", _summary_sql("provider"))(_summary("provider"))
register("a1_token_summary_comm", _summary_sql("comm"))(_summary("comm"))
register("a1_token_summary_pid", _summary_sql("CAST(pid AS VARCHAR)"))(_summary("pid"))
register("a1_token_summary_dir",
         _summary_sql("working_dir", "tkd", _DIR_CTES,
                      ["token_usage", "llm_calls", "sessions", "canon"]))(_summary("dir"))


@register("a2_snapshot_summary", W(
    ["token_usage", "llm_calls", "sessions", "canon"],
    """SELECT (SELECT count(DISTINCT id) FROM llm_calls) AS llm_calls,
        (SELECT count(DISTINCT id) FROM token_usage) AS token_usage_rows,
        (SELECT count(DISTINCT id) FROM audit) AS audit_events,
        (SELECT count(DISTINCT id) FROM sessions) AS sessions,
        (SELECT CAST(sum(input_tokens) AS BIGINT) FROM eff) AS input_tokens,
        (SELECT CAST(sum(output_tokens) AS BIGINT) FROM eff) AS output_tokens,
        (SELECT CAST(sum(total_tokens) AS BIGINT) FROM eff) AS total_tokens,
        least((SELECT min(start_timestamp_ms) FROM llm_calls), (SELECT min(timestamp_ms) FROM token_usage),
              (SELECT min(timestamp_ms) FROM audit), (SELECT min(start_timestamp_ms) FROM sessions)) AS start_timestamp_ms,
        greatest((SELECT max(end_timestamp_ms) FROM llm_calls), (SELECT max(timestamp_ms) FROM token_usage),
              (SELECT max(timestamp_ms) FROM audit), (SELECT max(end_timestamp_ms) FROM sessions)) AS end_timestamp_ms""",
    [("eff", EFF), ("audit", AUDIT)]))
def a2_snapshot_summary(spark, sf):
    canon = FX.canonical_events(spark, sf)
    return T.snapshot_summary(FX.token_usage(spark, sf), FX.llm_calls(spark, sf),
                              P.audit_from_events(canon), FX.sessions(spark, sf))


@register("a4_llm_call_rows", W(
    ["token_usage", "llm_calls"],
    """SELECT c.id, c.seq, c.session_id, c.start_timestamp_ms, c.end_timestamp_ms, c.pid, c.comm, c.provider,
        c.model, c.status, c.status_code, c.host, c.path,
        CAST(coalesce(e.input_tokens, 0) AS BIGINT) AS input_tokens,
        CAST(coalesce(e.output_tokens, 0) AS BIGINT) AS output_tokens,
        CAST(coalesce(e.total_tokens, 0) AS BIGINT) AS total_tokens
    FROM calls_latest c LEFT JOIN (SELECT * FROM eff WHERE llm_call_id <> '') e ON c.id = e.llm_call_id
    ORDER BY c.start_timestamp_ms DESC, c.id LIMIT 100""",
    [("eff", EFF), ("calls_latest", CALLS_LATEST)]))
def a4_llm_call_rows(spark, sf):
    return T.llm_call_rows(FX.llm_calls(spark, sf), FX.token_usage(spark, sf), 100)


from ..operators import audit as A  # noqa: E402


@register("a3_run_summary", W(
    ["token_usage", "llm_calls", "sessions", "canon"], """
    SELECT (s.e - s.s) / 1000 AS duration_s,
        (SELECT min(start_timestamp_ms) FROM calls_latest) - s.s AS first_llm_after_ms,
        (SELECT count(lat) FROM lats) AS llm_latency_count, (SELECT CAST(sum(lat) AS BIGINT) FROM lats) AS llm_latency_total_ms,
        (SELECT max(lat) FROM lats) AS llm_latency_max_ms, (SELECT round(avg(lat), 4) FROM lats) AS llm_latency_avg_ms,
        (SELECT count(*) FROM audit WHERE audit_type = 'process' AND action = 'exec') AS process_execs,
        (SELECT count(*) FROM audit WHERE audit_type = 'process' AND action = 'exit' AND status = 'success') AS exit_success,
        (SELECT count(*) FROM audit WHERE audit_type = 'process' AND action = 'exit' AND status = 'failure') AS exit_failure,
        (SELECT count(*) FROM audit WHERE audit_type = 'file') AS file_events,
        (SELECT count(DISTINCT target) FROM audit WHERE audit_type = 'file') AS unique_files,
        (SELECT min(timestamp_ms) FROM audit WHERE audit_type = 'file') - s.s AS first_file_after_ms,
        (SELECT max(timestamp_ms) FROM audit WHERE audit_type = 'file') - s.s AS last_file_after_ms,
        (SELECT string_agg(k || '(' || c || ')', ', ' ORDER BY c DESC, k) FROM (
            SELECT CASE WHEN NOT contains(target, '/') THEN '.' WHEN regexp_extract(target, '^(.*)/[^/]*$', 1) = '' THEN '/'
                        ELSE regexp_extract(target, '^(.*)/[^/]*$', 1) END AS k, count(*) AS c FROM audit
            WHERE audit_type = 'file' AND target IS NOT NULL GROUP BY 1 ORDER BY c DESC, k LIMIT 8)) AS top_directories,
        (SELECT CAST(sum(greatest(count, 0)) AS BIGINT) FROM targets) AS network_events,
        (SELECT string_agg(k || '(' || c || ')', ', ' ORDER BY c DESC, k) FROM (
            SELECT CASE WHEN coalesce(path, '') <> '' THEN host || path ELSE host END AS k,
                   CAST(sum(greatest(count, 0)) AS BIGINT) AS c FROM targets GROUP BY 1 ORDER BY c DESC, k LIMIT 8))
            AS top_endpoints
    FROM (SELECT least((SELECT min(start_timestamp_ms) FROM llm_calls), (SELECT min(timestamp_ms) FROM token_usage),
                       (SELECT min(timestamp_ms) FROM audit), (SELECT min(start_timestamp_ms) FROM sessions)) AS s,
                 greatest((SELECT max(end_timestamp_ms) FROM llm_calls), (SELECT max(timestamp_ms) FROM token_usage),
                       (SELECT max(timestamp_ms) FROM audit), (SELECT max(end_timestamp_ms) FROM sessions)) AS e) s""",
    [("audit", AUDIT), ("calls_latest", CALLS_LATEST),
     ("lats", "SELECT CASE WHEN end_timestamp_ms >= start_timestamp_ms THEN end_timestamp_ms - start_timestamp_ms END AS lat "
              "FROM calls_latest"),
     ("targets", "SELECT host, nullif(coalesce(path, ''), '') AS path, count(*) AS count FROM canon "
                 "WHERE host IS NOT NULL AND host <> '' GROUP BY coalesce(pid, 0), host, coalesce(path, '')")]))
def a3_run_summary(spark, sf):
    canon = FX.canonical_events(spark, sf)
    audit = P.audit_from_events(canon)
    summary = T.snapshot_summary(FX.token_usage(spark, sf), FX.llm_calls(spark, sf), audit, FX.sessions(spark, sf))
    return T.run_summary(summary, FX.llm_calls(spark, sf), audit, A.network_targets(A.network_rows(canon)))


# ---- R11: usage and tool rows from agent telemetry posts ---------------------------

from ..operators import canonical as CN  # noqa: E402


def _telemetry(spark, sf):
    raw = FX.raw_events(spark, sf).where(F.col("event_type") == "click")
    k = F.col("k")
    api = F.to_json(F.struct(F.lit("tengu_api_success").alias("message"), F.format_string("claude-%d", k % 3).alias("model"),
                             F.floor(F.col("value") * 10).cast("bigint").alias("input_tokens"),
                             (k % 50).alias("output_tokens"), (k % 7).alias("cached_input_tokens")))
    tool = F.to_json(F.struct(F.lit("tengu_tool_use_success").alias("message"),
                              F.element_at(F.array(*[F.lit(t) for t in FX.TOOLS]), (k % 4 + 1).cast("int")).alias("tool_name"),
                              (k * 3).alias("duration_ms"), F.format_string("req-%d", "seq").alias("request_id")))
    body = F.when(k % 5 == 0, F.lit("[]")).otherwise(F.concat(F.lit("["), api, F.lit(","), tool, F.lit("]")))
    return raw.select(F.col("seq").alias("event_id"), "timestamp_ms", "pid", "comm", body.alias("body"))


_TEL_SQL = [("tel", """SELECT seq AS event_id, timestamp_ms, pid, comm,
        CASE WHEN k % 5 = 0 THEN '[]' ELSE '[' || json_object('message', 'tengu_api_success', 'model', 'claude-' || (k % 3),
            'input_tokens', CAST(floor(value * 10) AS BIGINT), 'output_tokens', k % 50, 'cached_input_tokens', k % 7)::VARCHAR
            || ',' || json_object('message', 'tengu_tool_use_success', 'tool_name', ['Bash', 'Read', 'Edit', 'WebFetch'][k % 4 + 1],
            'duration_ms', k * 3, 'request_id', 'req-' || seq)::VARCHAR || ']' END AS body
        FROM raw WHERE event_type = 'click'"""),
            ("items", """SELECT event_id, timestamp_ms, pid, comm, i - 1 AS idx, json_extract(body, '$[' || (i - 1) || ']') AS it
        FROM (SELECT *, unnest(range(1, CAST(json_array_length(body) AS BIGINT) + 1)) AS i FROM tel)""")]


def _ji(key):
    return f"coalesce(CASE WHEN json_type(it, '$.{key}') IN ('BIGINT', 'UBIGINT') THEN CAST(it ->> '$.{key}' AS BIGINT) END, 0)"


@register("r11_telemetry_tokens", W(["raw"], f"""
    SELECT 'token-claude-telemetry-' || event_id || '-' || idx AS id, 'claude-telemetry-' || event_id || '-' || idx AS llm_call_id,
        timestamp_ms, pid, comm, 'anthropic' AS provider, coalesce(it ->> '$.model', 'unknown') AS model,
        {_ji('input_tokens')} AS input_tokens, {_ji('output_tokens')} AS output_tokens, {_ji('cached_input_tokens')} AS cache_read_tokens,
        {_ji('input_tokens')} + {_ji('output_tokens')} + {_ji('cached_input_tokens')} AS total_tokens,
        'claude_telemetry' AS source, 0.8 AS confidence
    FROM items WHERE it ->> '$.message' = 'tengu_api_success'
      AND {_ji('input_tokens')} + {_ji('output_tokens')} + {_ji('cached_input_tokens')} > 0""", _TEL_SQL))
def r11_telemetry_tokens(spark, sf):
    return CN.usage_from_telemetry(_telemetry(spark, sf))[0]


@register("r11_telemetry_tools", W(["raw"], f"""
    SELECT 'claude-tool-telemetry-' || event_id || '-' || idx AS id, timestamp_ms, pid,
        coalesce(it ->> '$.tool_name', '?') AS tool_name, it ->> '$.request_id' AS tool_call_id,
        CASE WHEN json_type(it, '$.duration_ms') IN ('BIGINT', 'UBIGINT') AND timestamp_ms >= CAST(it ->> '$.duration_ms' AS BIGINT)
             THEN timestamp_ms - CAST(it ->> '$.duration_ms' AS BIGINT) END AS start_timestamp_ms,
        CASE WHEN json_type(it, '$.duration_ms') IN ('BIGINT', 'UBIGINT') THEN CAST(it ->> '$.duration_ms' AS BIGINT) END AS duration_ms,
        'completed' AS status
    FROM items WHERE it ->> '$.message' = 'tengu_tool_use_success'""", _TEL_SQL))
def r11_telemetry_tools(spark, sf):
    return CN.usage_from_telemetry(_telemetry(spark, sf))[1]
