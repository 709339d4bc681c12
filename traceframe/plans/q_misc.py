"""Sequential and streaming-shaped operators without a SQL form (checked by
golden tests and rows-only), plus the remaining small views."""

from __future__ import annotations

from ..operators import pairing as PA
from ..sources import fixtures as FX
from .registry import register


# The queue of a thread as a recursion over its events, one at a step: what waits, and what the event took.
_QUEUE = [
    ("ev", "SELECT *, row_number() OVER (PARTITION BY pid, tid ORDER BY timestamp_ms, seq) AS rn FROM llm_events "
           "WHERE kind <> 'request' OR has_body OR model IS NOT NULL"),
    ("queue", """SELECT pid, tid, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(seq BIGINT, ts BIGINT, rid VARCHAR, model VARCHAR)[]) AS waiting,
            CAST(NULL AS STRUCT(seq BIGINT, ts BIGINT, rid VARCHAR, model VARCHAR)) AS took FROM ev WHERE rn = 1
        UNION ALL
        SELECT pid, tid, rn, CASE WHEN kind = 'request' THEN list_append(live, {'seq': seq, 'ts': timestamp_ms, 'rid': request_id, 'model': model})[-16:]
            WHEN pos IS NULL THEN live ELSE list_concat(live[:pos - 1], live[pos + 1:]) END,
            CASE WHEN kind <> 'request' THEN live[pos] END
        FROM (SELECT *, CASE WHEN request_id IS NOT NULL THEN nullif(list_position(list_transform(live, lambda w: w.rid), request_id), 0)
                             WHEN len(live) = 1 THEN 1 END AS pos
              FROM (SELECT e.*, list_filter(q.waiting, lambda w: w.ts >= e.timestamp_ms - 300000) AS live
                    FROM queue q JOIN ev e ON e.pid = q.pid AND e.tid = q.tid AND e.rn = q.rn + 1))"""),
    ("took", "SELECT ev.*, queue.took FROM ev JOIN queue USING (pid, tid, rn) WHERE ev.kind <> 'request'"),
    ("pairs", """SELECT 'llm-' || r.seq AS id, r.pid, r.tid, r.seq AS request_seq, t.seq AS response_seq, r.timestamp_ms AS start_timestamp_ms,
            t.timestamp_ms AS end_timestamp_ms, CASE WHEN t.seq IS NULL THEN r.model ELSE coalesce(r.model, t.model, 'unknown') END AS model,
            CASE WHEN t.seq IS NULL THEN 'pending' WHEN t.status_code >= 400 THEN 'error' ELSE 'complete' END AS status, t.status_code,
            CASE WHEN t.status_code >= 400 THEN 'http_' || t.status_code END AS error_type,
            CASE WHEN t.seq IS NULL THEN NULL WHEN t.request_id IS NULL THEN 0.75 ELSE 0.95 END::DOUBLE AS confidence
        FROM ev r LEFT JOIN took t ON t.took.seq = r.seq WHERE r.kind = 'request'
        UNION ALL
        SELECT 'llm-orphan-' || seq, pid, tid, NULL, seq, timestamp_ms, timestamp_ms, coalesce(model, 'unknown'),
            CASE WHEN status_code >= 400 THEN 'error' ELSE 'complete' END, status_code, CASE WHEN status_code >= 400 THEN 'http_' || status_code END, 0.35
        FROM took WHERE took IS NULL"""),
]


@register("j1_pair_llm_calls", FX.with_fixtures(["llm_events"], "SELECT * FROM pairs", _QUEUE, recursive=True))
def j1_pair_llm_calls(spark, sf):
    return PA.pair_llm_calls(FX.llm_events(spark, sf))


def _first(*paths):
    return "coalesce(" + ", ".join(f"json_extract_string({b}, '{p}')" for b, p in paths) + ")"


_SESSION_PATHS = ["$.session_id", "$.sessionId", "$.metadata.session_id", "$.metadata.sessionId"]
_CONVERSATION_PATHS = ["$.conversation_id", "$.conversationId", "$.metadata.conversation_id", "$.response.id", "$.id", "$.message_id", "$.message.id"]
_USAGE = {"input_tokens": ["$.usage.input_tokens", "$.usage.prompt_tokens", "$.usageMetadata.promptTokenCount"],
          "output_tokens": ["$.usage.output_tokens", "$.usage.completion_tokens"], "cache_creation_tokens": ["$.usage.cache_creation_input_tokens"],
          "cache_read_tokens": ["$.usage.cache_read_input_tokens"]}
_CALLS = _QUEUE + [
    ("side", "SELECT seq, kind, comm, provider, host, path, model, CASE WHEN json_valid(body) THEN body END AS body FROM llm_traffic"),
    ("joined", """SELECT p.*, r.body AS request, t.body AS response, coalesce(r.comm, t.comm) AS comm, coalesce(r.provider, CASE WHEN r.seq IS NULL THEN t.provider END) AS given,
        coalesce(r.host, t.host) AS host, coalesce(r.path, t.path) AS path, r.model AS request_model
        FROM pairs p LEFT JOIN side r ON r.seq = p.request_seq LEFT JOIN side t ON t.seq = p.response_seq"""),
    ("parts", f"""SELECT * EXCLUDE (model, given, request_model),
        {_first(*[(b, p) for b in ('request', 'response') for p in _SESSION_PATHS[:4]])} AS sid,
        nullif(string_split(json_extract_string(request, '$.metadata.user_id'), '_session_')[2], '') AS user_sid,
        {_first(*[(b, p) for b in ('request', 'response') for p in _CONVERSATION_PATHS])} AS conversation_id,
        coalesce(given, CASE WHEN contains(host, 'openai') THEN 'openai' WHEN contains(host, 'anthropic') THEN 'anthropic'
            WHEN contains(host, 'googleapis') THEN 'gcp.gen_ai' ELSE host END) AS provider,
        coalesce(request_model, {_first(('response', '$.model'))}, CASE WHEN response_seq IS NOT NULL THEN 'unknown' END) AS model,
        CASE WHEN contains(path, '/v1/responses') THEN 'responses' WHEN contains(path, '/v1/messages') THEN 'messages'
            WHEN contains(path, '/chat/completions') THEN 'chat' WHEN contains(path, ':generateContent') THEN 'generate_content' END AS call_kind,
        {_first(*[('response', p) for p in ('$.finish_reason', '$.stop_reason', '$.choices[0].finish_reason')])} AS finish_reason,
        {", ".join(f"coalesce(CAST({_first(*[('response', p) for p in v])} AS BIGINT), 0) AS {c}_0" for c, v in _USAGE.items())},
        coalesce(CAST(json_extract_string(response, '$.usageMetadata.candidatesTokenCount') AS BIGINT), 0)
            + coalesce(CAST(json_extract_string(response, '$.usageMetadata.thoughtsTokenCount') AS BIGINT), 0) AS gemini,
        nullif(coalesce(CAST(json_extract_string(response, '$.usageMetadata.totalTokenCount') AS BIGINT), 0), 0) AS override FROM joined"""),
    ("calls", """SELECT id, coalesce(sid, user_sid) AS session_id, conversation_id, request_seq, response_seq, start_timestamp_ms, end_timestamp_ms,
        pid, tid, comm, provider, model, call_kind, status, error_type, finish_reason, host, path, status_code, input_tokens_0 AS input_tokens,
        greatest(output_tokens_0, gemini) AS output_tokens, cache_creation_tokens_0 AS cache_creation_tokens, cache_read_tokens_0 AS cache_read_tokens,
        coalesce(override, input_tokens_0 + greatest(output_tokens_0, gemini) + cache_creation_tokens_0 + cache_read_tokens_0) AS total_tokens,
        request, response, confidence FROM parts"""),
]


def _calls(spark, sf):
    events = FX.llm_traffic(spark, sf)
    return PA.call_rows(events, PA.pair_llm_calls(events))


@register("j1_call_rows", FX.with_fixtures(["llm_traffic"], "SELECT * FROM calls", _CALLS, recursive=True))
def j1_call_rows(spark, sf):
    """Whole call rows, with bodies, session, provider and tokens."""
    return _calls(spark, sf)


@register("j1_call_tokens", FX.with_fixtures(["llm_traffic"], """
    SELECT 'token-' || id AS id, id AS llm_call_id, response_seq AS seq, end_timestamp_ms AS timestamp_ms, pid, comm, provider, model, input_tokens,
        output_tokens, cache_creation_tokens, cache_read_tokens, total_tokens, 'response_usage' AS source, 'view' AS view_source, confidence
    FROM calls WHERE input_tokens > 0 OR output_tokens > 0 OR cache_creation_tokens > 0 OR cache_read_tokens > 0 OR total_tokens > 0""",
                                             _CALLS, recursive=True))
def j1_call_tokens(spark, sf):
    """Token rows from the usage of the call rows."""
    return PA.call_token_rows(_calls(spark, sf))


# ---- sources and sinks -----------------------------------------------------

from pyspark.sql import functions as F  # noqa: E402

from ..sources import sinks as SK  # noqa: E402
from ..sources import trace as TR  # noqa: E402
from ..operators import tokens as T  # noqa: E402
from .sql_common import AUDIT, PROCESS_CTES  # noqa: E402

W = FX.with_fixtures


def _json_lines(spark, sf):
    """Event-log lines rebuilt from the events table, with envelope defects:
    string timestamp (k % 23), no pid (k % 19), no comm (k % 29), broken JSON
    (k % 31)."""
    raw = FX.raw_events(spark, sf)
    k = F.col("k")
    line = F.concat(
        F.when(k % 31 == 0, F.lit("[")).otherwise(F.lit("{")),
        F.when(k % 23 == 0, F.lit('"timestamp": "x", '))
         .otherwise(F.format_string('"timestamp": %d, ', "timestamp_ms")),
        F.lit('"source": "process", '),
        F.when(k % 19 == 0, F.lit("")).otherwise(F.format_string('"pid": %d, ', "pid")),
        F.when(k % 29 == 0, F.lit("")).otherwise(F.format_string('"comm": "%s", ', "comm")),
        F.format_string('"data": {"k": %d}}', k))
    return raw.select(F.col("seq").alias("line_order"), F.lit("events").alias("file"), line.alias("line")) \
        .withColumn("v", F.expr("try_parse_json(line)"))


_LINES_SQL = [("lines", """SELECT seq, CASE WHEN k % 31 = 0 THEN '[' ELSE '{' END
        || CASE WHEN k % 23 = 0 THEN '"timestamp": "x", ' ELSE '"timestamp": ' || timestamp_ms || ', ' END
        || '"source": "process", '
        || CASE WHEN k % 19 = 0 THEN '' ELSE '"pid": ' || pid || ', ' END
        || CASE WHEN k % 29 = 0 THEN '' ELSE '"comm": "' || comm || '", ' END
        || '"data": {"k": ' || k || '}}' AS line FROM raw"""),
              ("good", """SELECT seq, line, json_type(line, '$.timestamp') AS tt, json_type(line, '$.pid') AS pt,
        json_type(line, '$.comm') AS ct, TRY_CAST(json_extract_string(line, '$.timestamp') AS BIGINT) AS ts,
        TRY_CAST(json_extract_string(line, '$.pid') AS BIGINT) AS p, json_extract_string(line, '$.comm') AS c
        FROM lines WHERE json_valid(line)"""),
              ("checked", """SELECT seq, line, ts, p, c,
        CASE WHEN NOT coalesce(tt IN ('UBIGINT', 'BIGINT') AND ts >= 0, false) THEN 'missing timestamp'
             WHEN NOT coalesce(pt IN ('UBIGINT', 'BIGINT') AND p >= 0, false) THEN 'missing pid'
             WHEN ct IS DISTINCT FROM 'VARCHAR' THEN 'missing comm' END AS reason FROM good
        UNION ALL SELECT seq, line, NULL, NULL, NULL, 'invalid json' FROM lines WHERE NOT json_valid(line)""")]


@register("s2_split_valid_diagnostics", W(["raw"], """
    SELECT seq AS line_order, reason, ts AS timestamp, coalesce(p, 0) AS pid, coalesce(c, 'process') AS comm,
        row_number() OVER (ORDER BY seq) AS parse_error_count
    FROM checked WHERE reason IS NOT NULL""", _LINES_SQL))
def s2_split_valid_diagnostics(spark, sf):
    _, diag = TR.split_valid(_json_lines(spark, sf))
    return diag.select("line_order", "reason", "timestamp", "pid", "comm", "parse_error_count")


@register("s1_trace_events_by_comm", W(["raw"], """
    SELECT c AS comm, count(*) AS events, min(ts) AS first_timestamp, max(ts) AS last_timestamp
    FROM checked WHERE reason IS NULL GROUP BY c""", _LINES_SQL))
def s1_trace_events_by_comm(spark, sf):
    ev, _ = TR.split_valid(_json_lines(spark, sf))
    return ev.groupBy("comm").agg(F.count(F.lit(1)).alias("events"), F.min("timestamp").alias("first_timestamp"),
                                  F.max("timestamp").alias("last_timestamp"))


_SPANS_SQL = """SELECT left(sha256(session_id), 32) AS trace_id, substr(sha256(id), 33, 16) AS span_id,
        'traceframe' AS service_name, 'chat ' || coalesce(model, 'unknown') AS name, 3 AS kind,
        start_timestamp_ms * 1000000 AS start_unix_nano, end_timestamp_ms * 1000000 AS end_unix_nano,
        CASE WHEN status_code >= 400 THEN 2 ELSE 1 END AS status_code,
        CASE WHEN status_code >= 400 THEN 'HTTP ' || status_code END AS status_message,
        3 + (model IS NOT NULL)::INT + (status_code IS NOT NULL)::INT AS attribute_count, id
    FROM calls_latest WHERE end_timestamp_ms IS NOT NULL"""


@register("s12_genai_spans", W(["llm_calls"], _SPANS_SQL, [("calls_latest", "SELECT * FROM llm_calls QUALIFY "
                                                           "row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1")]))
def s12_genai_spans(spark, sf):
    sp = SK.genai_spans(T.latest_calls(FX.llm_calls(spark, sf)), trace_col="session_id")
    return sp.withColumn("attribute_count", F.size("attributes")).drop("attributes")


@register("s13_spans_to_traces", W(["llm_calls"], f"""
    SELECT trace_id, count(*) AS span_count, min(start_unix_nano) AS first_start_unix_nano,
        count(*) FILTER (WHERE status_code = 2) AS error_spans,
        arg_min(name, (start_unix_nano, span_id)) AS root_name
    FROM ({_SPANS_SQL}) GROUP BY trace_id""", [("calls_latest", "SELECT * FROM llm_calls QUALIFY "
                                                "row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1")]))
def s13_spans_to_traces(spark, sf):
    sp = SK.genai_spans(T.latest_calls(FX.llm_calls(spark, sf)), trace_col="session_id")
    return SK.spans_to_traces(sp)


# ---- timeline views ---------------------------------------------------------

from ..operators import timeline as TL  # noqa: E402
from ..operators import process as P  # noqa: E402
from ..operators import audit as A  # noqa: E402


def _tl_events(spark, sf):
    return FX.canonical_events(spark, sf).select("seq", "timestamp_ms", "pid", "tid", "comm",
                                                 F.col("kind").alias("source"), "event")


_TL = [("tl", "SELECT seq, timestamp_ms, pid, tid, comm, kind AS source, event FROM canon"),
       ("b", "SELECT *, CAST(floor((timestamp_ms - (SELECT min(timestamp_ms) FROM tl)) / 60000) AS BIGINT) AS bucket FROM tl")]


@register("a26_time_buckets", W(["canon"], """
    SELECT t.bucket, t.count, s.sources, t.bucket * 60 / 60 AS minute FROM
      (SELECT bucket, count(*) AS count FROM b GROUP BY bucket ORDER BY count DESC, bucket LIMIT 10) t
    LEFT JOIN (SELECT bucket, string_agg(source || ':' || c, ', ' ORDER BY r) AS sources FROM (
        SELECT bucket, source, count(*) AS c, row_number() OVER (PARTITION BY bucket ORDER BY count(*) DESC, min(seq)) AS r
        FROM b GROUP BY bucket, source) WHERE r <= 3 GROUP BY bucket) s ON t.bucket = s.bucket""", _TL))
def a26_time_buckets(spark, sf):
    return TL.time_buckets(_tl_events(spark, sf))


@register("a26_time_summary", W(["canon"], """
    SELECT duration_s, active_buckets, CAST(floor(duration_s / 60) AS BIGINT) + 1 AS total_buckets,
        round(active_buckets / (CAST(floor(duration_s / 60) AS BIGINT) + 1) * 100, 4) AS coverage_pct,
        gaps, avg_gap_s, max_gap_s, inactive_s FROM (
      SELECT count(*) AS active_buckets, (max(m) - (SELECT min(timestamp_ms) FROM tl)) / 1000 AS duration_s,
        count(*) FILTER (WHERE gap > 0) AS gaps, round(avg(CASE WHEN gap > 0 THEN gap * 60 END), 4) AS avg_gap_s,
        max(CASE WHEN gap > 0 THEN gap * 60 END) AS max_gap_s,
        CAST(coalesce(sum(CASE WHEN gap > 0 THEN gap * 60 END), 0) AS BIGINT) AS inactive_s
      FROM (SELECT bucket, m, bucket - lag(bucket) OVER (ORDER BY bucket) - 1 AS gap
            FROM (SELECT bucket, max(timestamp_ms) AS m FROM b GROUP BY bucket)))""", _TL))
def a26_time_summary(spark, sf):
    return TL.time_summary(_tl_events(spark, sf))


@register("w8_time_anomalies", W(["canon"], """
    SELECT pid, tid, prev_seq, seq, abs(timestamp_ms - prev_ts) AS gap_ms FROM (
        SELECT *, lag(seq) OVER w AS prev_seq, lag(timestamp_ms) OVER w AS prev_ts FROM tl
        WINDOW w AS (PARTITION BY pid, tid ORDER BY seq))
    WHERE prev_seq IS NOT NULL AND seq - prev_seq <= 10 AND abs(timestamp_ms - prev_ts) > 3600000""", _TL))
def w8_time_anomalies(spark, sf):
    # pid/tid of the HTTP thread view: tid = pid % 3, so several threads share a pid
    e = _tl_events(spark, sf)
    return TL.time_anomalies(e, 10, 3_600_000)


@register("w9_simultaneous", W(["canon"], """
    SELECT pid, tid, timestamp_ms // 1000 AS second, count(*) AS events, min(seq) AS first_seq
    FROM tl GROUP BY 1, 2, 3 HAVING count(*) > 1""", _TL))
def w9_simultaneous(spark, sf):
    return TL.simultaneous(_tl_events(spark, sf))


@register("f25_sample_evenly", W(["canon"], """
    SELECT seq, timestamp_ms, i AS sample_index FROM (
        SELECT seq, timestamp_ms, row_number() OVER (ORDER BY timestamp_ms, seq) - 1 AS i, count(*) OVER () AS n FROM tl)
    WHERE n <= 20 OR (i % greatest(n // 20, 1) = 0 AND i / greatest(n // 20, 1) < 20)""", _TL))
def f25_sample_evenly(spark, sf):
    return TL.sample_evenly(_tl_events(spark, sf), 20).select("seq", "timestamp_ms", "sample_index")


@register("u4_timeline_groups", W(["canon"], """
    SELECT source, min(timestamp_ms) AS start_ms, max(timestamp_ms) AS end_ms, count(*) AS events,
        round((min(timestamp_ms) - (SELECT min(timestamp_ms) FROM tl)) / greatest((SELECT max(timestamp_ms) - min(timestamp_ms) FROM tl), 1), 6) AS start_pos,
        round((max(timestamp_ms) - (SELECT min(timestamp_ms) FROM tl)) / greatest((SELECT max(timestamp_ms) - min(timestamp_ms) FROM tl), 1), 6) AS end_pos
    FROM tl GROUP BY source""", _TL))
def u4_timeline_groups(spark, sf):
    return TL.timeline_groups(_tl_events(spark, sf))


def _flat(spark, sf):
    ev, diag = TR.split_valid(_json_lines(spark, sf))
    a = ev.select(F.col("line_order").alias("seq"), "source", "comm", "pid",
                  F.col("timestamp").alias("timestamp_ms"), F.lit(None).cast("string").alias("error"))
    b = diag.select(F.col("line_order").alias("seq"), F.lit("diagnostic").alias("source"), "comm", "pid",
                    F.col("timestamp").alias("timestamp_ms"), F.col("reason").alias("error"))
    return a.unionByName(b)


@register("a25_event_log_summary", W(["raw"], """
    SELECT 'totals' AS category, 'total' AS key, count(*) AS value FROM checked
    UNION ALL SELECT 'totals', 'valid', count(*) FILTER (WHERE reason IS NULL) FROM checked
    UNION ALL SELECT 'totals', 'errors', count(*) FILTER (WHERE reason IS NOT NULL) FROM checked
    UNION ALL SELECT 'source', 'process', count(*) FROM checked WHERE reason IS NULL HAVING count(*) > 0
    UNION ALL SELECT 'comm', c, cnt FROM (SELECT c, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, min(seq)) AS r
        FROM checked WHERE reason IS NULL AND c IS NOT NULL AND c <> '' GROUP BY c) WHERE r <= 5
    UNION ALL SELECT 'pid', CAST(p AS VARCHAR), cnt FROM (SELECT p, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, min(seq)) AS r
        FROM checked WHERE reason IS NULL AND p > 0 GROUP BY p) WHERE r <= 5
    UNION ALL SELECT 'range', 'start_ms', min(ts) FROM checked WHERE reason IS NULL AND ts > 0
    UNION ALL SELECT 'range', 'end_ms', max(ts) FROM checked WHERE reason IS NULL AND ts > 0""", _LINES_SQL))
def a25_event_log_summary(spark, sf):
    return TL.event_log_summary(_flat(spark, sf), 5)


def _display(spark, sf):
    """One display row per audit event, LLM call, token row, network
    target, process node and resource sample, in time order."""
    canon = FX.canonical_events(spark, sf)
    audit = P.audit_from_events(canon).select(
        "timestamp_ms", F.lit("audit").alias("source"), F.col("audit_type").alias("kind"), "pid", "comm",
        F.concat_ws(" ", "action", "target", "status").alias("text"))
    calls = T.latest_calls(FX.llm_calls(spark, sf)).select(
        F.col("start_timestamp_ms").alias("timestamp_ms"), F.lit("llm_call").alias("source"),
        F.lit("llm").alias("kind"), "pid", "comm", F.concat_ws(" ", "model", "status").alias("text"))
    toks = FX.token_usage(spark, sf).select(
        "timestamp_ms", F.lit("token_usage").alias("source"), F.col("source").alias("kind"), "pid", "comm",
        F.format_string("%s %d tokens", F.coalesce("model", F.lit("unknown")), "total_tokens").alias("text"))
    nodes = P.process_nodes(canon).select(
        F.coalesce("start_timestamp_ms", "end_timestamp_ms").alias("timestamp_ms"), F.lit("process").alias("source"),
        F.lit("process").alias("kind"), "pid", "comm", F.concat_ws(" ", "command", "status").alias("text"))
    samples = FX.resource_samples(spark, sf).select(
        "timestamp_ms", F.lit("resource").alias("source"), F.lit("sample").alias("kind"), "pid", "comm",
        F.format_string("cpu %.2f rss %d", "cpu_percent", "rss_mb").alias("text"))
    return audit.unionByName(calls).unionByName(toks).unionByName(nodes).unionByName(samples)


_DISPLAY_SQL = [("audit", AUDIT)] + PROCESS_CTES + [
    ("calls_latest", "SELECT * FROM llm_calls QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1"),
    ("display", """SELECT timestamp_ms, 'audit' AS source, audit_type AS kind, pid, comm,
            concat_ws(' ', action, target, status) AS text FROM audit
        UNION ALL SELECT start_timestamp_ms, 'llm_call', 'llm', pid, comm, concat_ws(' ', model, status) FROM calls_latest
        UNION ALL SELECT timestamp_ms, 'token_usage', source, pid, comm,
            coalesce(model, 'unknown') || ' ' || total_tokens || ' tokens' FROM token_usage
        UNION ALL SELECT coalesce(start_timestamp_ms, end_timestamp_ms), 'process', 'process', pid, comm,
            concat_ws(' ', command, status) FROM nodes
        UNION ALL SELECT timestamp_ms, 'resource', 'sample', pid, comm,
            printf('cpu %.2f rss %d', cpu_percent, rss_mb) FROM resource_samples""")]


@register("u2_display_events", W(["canon", "llm_calls", "token_usage", "resource_samples"],
                                 "SELECT * FROM display ORDER BY timestamp_ms", _DISPLAY_SQL))
def u2_display_events(spark, sf):
    return _display(spark, sf).orderBy("timestamp_ms")


@register("f16_filter_display_events", W(["canon", "llm_calls", "token_usage", "resource_samples"], """
    SELECT * FROM display WHERE comm = 'codex'
      AND contains(lower(concat_ws(' ', CAST(timestamp_ms AS VARCHAR), source, kind, CAST(pid AS VARCHAR), comm, text)), 'model-3')""",
    _DISPLAY_SQL))
def f16_filter_display_events(spark, sf):
    return TL.filter_display_events(_display(spark, sf), comm="codex", text="MODEL-3")


@register("f18_filter_options", W(["canon", "llm_calls", "token_usage", "resource_samples"], """
    SELECT DISTINCT facet, value FROM (
        SELECT 'kind' AS facet, kind AS value FROM display UNION ALL SELECT 'source', source FROM display
        UNION ALL SELECT 'comm', comm FROM display) WHERE value IS NOT NULL ORDER BY facet, value""", _DISPLAY_SQL))
def f18_filter_options(spark, sf):
    return TL.filter_options(_display(spark, sf), ("kind", "source", "comm"))


@register("a30_span_summary", W(["llm_calls"], f"""
    SELECT count(*) AS total_spans, count(*) FILTER (WHERE kind = 3) AS request_spans,
        count(*) FILTER (WHERE kind = 2) AS response_spans,
        coalesce(round(avg(CASE WHEN kind = 3 AND (end_unix_nano - start_unix_nano) / 1000000 > 0
                                THEN (end_unix_nano - start_unix_nano) / 1000000 END), 4), 0.0) AS average_latency_ms,
        count(DISTINCT CASE WHEN kind = 3 THEN nullif(regexp_extract(name, '^chat (.*)$', 1), '') END) AS models,
        count(DISTINCT trace_id) AS traces
    FROM ({_SPANS_SQL})""", [("calls_latest", "SELECT * FROM llm_calls QUALIFY "
                              "row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1")]))
def a30_span_summary(spark, sf):
    return SK.span_summary(SK.genai_spans(T.latest_calls(FX.llm_calls(spark, sf)), trace_col="session_id"))


def _session_versions(spark, sf):
    s = FX.sessions(spark, sf)
    base = s.select("id", "start_timestamp_ms", "end_timestamp_ms", F.lit("model-a").alias("model"),
                    F.lit(10).cast("bigint").alias("input_tokens"), F.lit(5).cast("bigint").alias("output_tokens"),
                    F.lit(15).cast("bigint").alias("total_tokens"), F.lit(0.5).alias("confidence"),
                    F.lit(0).cast("bigint").alias("seq"))
    upd = s.select("id", (F.col("start_timestamp_ms") + 500).alias("start_timestamp_ms"),
                   (F.col("end_timestamp_ms") + 1000).alias("end_timestamp_ms"),
                   F.when(F.length("id") % 2 == 0, F.lit("unknown")).otherwise(F.lit("model-b")).alias("model"),
                   F.lit(20).cast("bigint").alias("input_tokens"), F.lit(2).cast("bigint").alias("output_tokens"),
                   F.lit(22).cast("bigint").alias("total_tokens"), F.lit(0.7).alias("confidence"),
                   F.lit(1).cast("bigint").alias("seq"))
    return base, upd


@register("u5_combine_sessions", W(["sessions"], """
    SELECT id, min(start_timestamp_ms) AS start_timestamp_ms, max(end_timestamp_ms) AS end_timestamp_ms,
        coalesce(arg_max(model, seq) FILTER (WHERE model IS NOT NULL AND model <> 'unknown'), arg_max(model, seq)) AS model,
        max(input_tokens) AS input_tokens, max(output_tokens) AS output_tokens, max(total_tokens) AS total_tokens,
        max(confidence) AS confidence
    FROM (SELECT id, start_timestamp_ms, end_timestamp_ms, 'model-a' AS model, CAST(10 AS BIGINT) AS input_tokens,
                 CAST(5 AS BIGINT) AS output_tokens, CAST(15 AS BIGINT) AS total_tokens, 0.5 AS confidence, 0 AS seq FROM sessions
          UNION ALL
          SELECT id, start_timestamp_ms + 500, end_timestamp_ms + 1000,
                 CASE WHEN length(id) % 2 = 0 THEN 'unknown' ELSE 'model-b' END, 20, 2, 22, 0.7, 1 FROM sessions)
    GROUP BY id"""))
def u5_combine_sessions(spark, sf):
    base, upd = _session_versions(spark, sf)
    return SK.upsert_sessions(base, upd)


# ---- X8 / X9 column builders over whole texts ------------------------------------

from ..functions import exprs as X  # noqa: E402


@register("x8_data_types", W([], r"""
    SELECT doc_id AS id, CASE WHEN regexp_matches(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]')
                              THEN 'binary' ELSE 'text' END AS data_type,
        CAST(length(CASE WHEN regexp_matches(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]')
                         THEN 'HEX:' || lower(hex(encode(text))) ELSE text END) AS BIGINT) AS display_length
    FROM documents"""))
def x8_data_types(spark, sf):
    d = FX.read_table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), X.detect_data_type(F.col("text")).alias("data_type"),
                    F.length(X.data_to_string(F.col("text"))).cast("bigint").alias("display_length"))


@register("x9_short_session_ids", W([], r"""
    SELECT conv_id, turn, CASE WHEN trim(s) = '' THEN 'session'
            WHEN length(regexp_replace(string_split_regex(trim(s), '[/\\]')[-1], '(\.jsonl)+$', '')) <= 12
            THEN regexp_replace(string_split_regex(trim(s), '[/\\]')[-1], '(\.jsonl)+$', '')
            ELSE left(regexp_replace(string_split_regex(trim(s), '[/\\]')[-1], '(\.jsonl)+$', ''), 6) || '.' ||
                 right(regexp_replace(string_split_regex(trim(s), '[/\\]')[-1], '(\.jsonl)+$', ''), 5) END AS short_id,
        regexp_replace(role || ':' || s, '[^A-Za-z0-9]', '-', 'g') AS sanitized
    FROM (SELECT conv_id, turn, role, '/sessions/' || role || '/' || sha256(text) || '.jsonl' AS s FROM conversations)"""))
def x9_short_session_ids(spark, sf):
    c = FX.read_table(spark, sf, "conversations")
    s = F.concat(F.lit("/sessions/"), F.col("role"), F.lit("/"), F.sha2("text", 256), F.lit(".jsonl"))
    return c.select("conv_id", "turn", X.short_session_id(s).alias("short_id"),
                    X.sanitize_identifier(F.concat(F.col("role"), F.lit(":"), s)).alias("sanitized"))


def _label_rows(spark, sf):
    p = FX.proc_samples(spark, sf).select("pid", "comm").distinct()
    comm = F.when(F.col("pid") % 6 == 0, F.lit("unknown")).otherwise(F.col("comm"))
    m = F.col("pid") % 4
    command = (F.when(m == 0, F.format_string("/usr/bin/%s run", "comm"))
               .when(m == 1, F.lit("node /opt/npm/@anthropic-ai/claude-code/cli.js"))
               .when(m == 2, F.lit("\"/usr/local/bin/codex-cli\" exec"))
               .otherwise(F.lit("python -m app")))
    return p.select("pid", comm.alias("comm"), command.alias("command"))


def _label_sql(tok):
    t = f"regexp_replace({tok}, '^[''\"]+|[''\"]+$', '', 'g')"
    low = f"translate({t}, '{X._UP}', '{X._LO}')"
    base = f"string_split({low}, '/')[-1]"
    parts = " ".join(f"WHEN {base} = '{n}' THEN '{lab}'" for n, lab in X.AGENT_EXEC_NAMES)
    parts += f" WHEN starts_with({base}, 'openclaw-') THEN 'openclaw'"
    for needles, lab in X.AGENT_PACKAGE_PATHS:
        parts += " WHEN " + " OR ".join(f"contains({low}, '{n}')" for n in needles) + f" THEN '{lab}'"
    return f"(CASE WHEN {t} <> '' THEN CASE {parts} END END)"


@register("x25_agent_labels", W(["proc_samples"], f"""
    SELECT pid, comm, command, coalesce(
        {_label_sql('comm')},
        CASE WHEN len(toks) > 0 THEN coalesce({_label_sql('toks[1]')},
            list_filter(list_transform(list_filter(toks[2:], lambda x: contains(regexp_replace(x, '^[''"]+|[''"]+$', '', 'g'), '/')),
                lambda x: {_label_sql('x')}), lambda y: y IS NOT NULL)[1]) END,
        CASE WHEN comm <> '' AND comm <> 'unknown' THEN comm END,
        CASE WHEN len(toks) > 0 THEN toks[1] END, 'agent') AS agent
    FROM (SELECT *, list_filter(string_split_regex(trim(command), '\\s+'), lambda x: x <> '') AS toks FROM (
        SELECT pid, CASE WHEN pid % 6 = 0 THEN 'unknown' ELSE comm END AS comm,
            CASE pid % 4 WHEN 0 THEN '/usr/bin/' || comm || ' run' WHEN 1 THEN 'node /opt/npm/@anthropic-ai/claude-code/cli.js'
                 WHEN 2 THEN '"/usr/local/bin/codex-cli" exec' ELSE 'python -m app' END AS command
        FROM (SELECT DISTINCT pid, comm FROM proc_samples)))"""))
def x25_agent_labels(spark, sf):
    r = _label_rows(spark, sf)
    return r.select("pid", "comm", "command", X.agent_label(F.col("comm"), F.col("command")).alias("agent"))


# ---- X27: stdio JSON-RPC decoding -------------------------------------------------

from ..operators import canonical as CN  # noqa: E402


def _stdio(spark, sf):
    c = FX.read_table(spark, sf, "conversations")
    conv, t = F.col("conv_id"), F.col("turn")
    msg = (F.when(t % 7 == 6, F.col("text"))
           .when(F.col("role") == "user", F.format_string(
               '{"jsonrpc":"2.0","id":%d,"method":"tools/call","params":{"name":"tool-%d"}}', t, conv % 3))
           .when(F.col("role") == "assistant", F.format_string('{"jsonrpc":"2.0","id":%d,"result":{"ok":true}}', t))
           .otherwise(F.lit('{"jsonrpc":"2.0","method":"notifications/progress"}')))
    return c.select("conv_id", "turn", msg.alias("data"),
                    F.when(F.col("role") == "user", "write").otherwise("read").alias("direction"))


@register("x27_decode_stdio", W([], r"""
    SELECT conv_id, turn, upper(direction) AS direction,
        CASE WHEN is_obj AND method IS NOT NULL THEN CASE WHEN rpc_id IS NOT NULL THEN 'request' ELSE 'notification' END
             WHEN is_obj AND json_exists(data, '$.result') THEN 'response'
             WHEN is_obj AND json_exists(data, '$.error') THEN 'error'
             WHEN is_obj THEN 'unknown'
             WHEN trim(coalesce(data, '')) <> '' THEN 'text' ELSE 'unknown' END AS kind,
        method, rpc_id, tool_name FROM (
        SELECT *, CASE WHEN is_obj THEN data ->> '$.method' END AS method,
            CASE WHEN is_obj THEN data ->> '$.id' END AS rpc_id,
            CASE WHEN is_obj THEN nullif(data ->> '$.params.name', '') END AS tool_name FROM (
        SELECT *, coalesce(CASE WHEN json_valid(data) THEN json_type(CASE WHEN json_valid(data) THEN data END) = 'OBJECT' END, false) AS is_obj
        FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'write' ELSE 'read' END AS direction,
            CASE WHEN turn % 7 = 6 THEN text
                 WHEN role = 'user' THEN '{"jsonrpc":"2.0","id":' || turn || ',"method":"tools/call","params":{"name":"tool-' || (conv_id % 3) || '"}}'
                 WHEN role = 'assistant' THEN '{"jsonrpc":"2.0","id":' || turn || ',"result":{"ok":true}}'
                 ELSE '{"jsonrpc":"2.0","method":"notifications/progress"}' END AS data FROM conversations)))"""))
def x27_decode_stdio(spark, sf):
    d = CN.decode_stdio(_stdio(spark, sf))
    return d.select("conv_id", "turn", F.upper("direction").alias("direction"), "kind", "method", "rpc_id", "tool_name")


@register("u1_merge_sources", W(["canon", "http"], """
    SELECT source, count(*) AS events, min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_ms,
        count(path) AS with_path, count(status_code) AS with_status
    FROM (SELECT 'process' AS source, timestamp_ms, pid, path, CAST(NULL AS INTEGER) AS status_code FROM canon
              WHERE kind IN ('process', 'file')
          UNION ALL SELECT 'network', timestamp_ms, pid, path, status_code FROM canon WHERE kind = 'network'
          UNION ALL SELECT 'http_parser', timestamp_ms, pid, path, status_code FROM http)
    GROUP BY source"""))
def u1_merge_sources(spark, sf):
    """Three sources with different columns merged into one stream
    (columns aligned by name, missing ones null), then counted per source."""
    c = FX.canonical_events(spark, sf)
    proc = c.where(F.col("kind").isin("process", "file")).select(F.lit("process").alias("source"), "timestamp_ms", "pid",
                                                                  "path")
    net = c.where(F.col("kind") == "network").select(F.lit("network").alias("source"), "timestamp_ms", "pid", "path",
                                                      "status_code")
    http = FX.http_messages(spark, sf).select(F.lit("http_parser").alias("source"), "timestamp_ms", "pid", "path",
                                              "status_code")
    merged = A.merge_sources(proc, net, http)
    return merged.groupBy("source").agg(F.count(F.lit(1)).alias("events"), F.min("timestamp_ms").alias("first_ms"),
                                        F.max("timestamp_ms").alias("last_ms"), F.count("path").alias("with_path"),
                                        F.count("status_code").alias("with_status"))
