"""HTTP traffic queries over messages derived from ``pages`` (R1, F4, F20, F22,
J2, J18, X20, A19–A22, A24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import traffic as H
from ..sources import fixtures as FX
from .registry import register

W = FX.with_fixtures
CRLF_SQL = "(chr(13) || chr(10))"

# Reason phrases of the status codes used by the fixture.
STATUS_TEXT = {200: "OK", 204: "No Content", 304: "Not Modified", 404: "Not Found",
               500: "Internal Server Error"}


def _status_text(c):
    e = None
    for code, text in STATUS_TEXT.items():
        e = F.when(c == code, text) if e is None else e.when(c == code, text)
    return e.otherwise("Unknown")


def payloads(spark, sf):
    """Raw HTTP/1.1 texts (request and response) rebuilt from the messages."""
    h = FX.http_messages(spark, sf)
    crlf = F.lit("\r\n")
    target = F.concat(F.col("path"), F.when(F.col("query") != "", F.concat(F.lit("?"), F.col("query")))
                      .otherwise(F.lit("")))
    req = F.concat(F.col("method"), F.lit(" "), target, F.lit(" HTTP/1.1"), crlf,
                   F.lit("Host: "), F.col("host"), crlf,
                   F.lit("User-Agent: agent/"), F.col("pid").cast("string"), crlf,
                   F.when(F.col("pid") % 2 == 0,
                          F.concat(F.lit("Authorization: Bearer t"), F.col("seq").cast("string"), crlf))
                    .otherwise(F.lit("")),
                   F.lit("Content-Length: "), F.length("body").cast("string"), crlf, crlf, F.col("body"))
    resp = F.concat(F.lit("HTTP/1.1 "), F.col("status_code").cast("string"), F.lit(" "),
                    _status_text(F.col("status_code")), crlf,
                    F.lit("Content-Type: "), F.col("content_type"), crlf,
                    F.lit("Content-Length: "), F.length("body").cast("string"), crlf, crlf, F.col("body"))
    return h.select("seq", "tid", "timestamp_ms",
                    F.when(F.col("message_type") == "request", req).otherwise(resp).alias("payload"))


_STATUS_SQL = ("CASE status_code " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in STATUS_TEXT.items())
               + " ELSE 'Unknown' END")
_PAYLOAD_SQL = f"""SELECT seq, tid, timestamp_ms, CASE WHEN message_type = 'request' THEN
        method || ' ' || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END || ' HTTP/1.1' || {CRLF_SQL}
        || 'Host: ' || host || {CRLF_SQL} || 'User-Agent: agent/' || pid || {CRLF_SQL}
        || CASE WHEN pid % 2 = 0 THEN 'Authorization: Bearer t' || seq || {CRLF_SQL} ELSE '' END
        || 'Content-Length: ' || length(body) || {CRLF_SQL} || {CRLF_SQL} || body
    ELSE 'HTTP/1.1 ' || status_code || ' ' || {_STATUS_SQL} || {CRLF_SQL} || 'Content-Type: ' || content_type
        || {CRLF_SQL} || 'Content-Length: ' || length(body) || {CRLF_SQL} || {CRLF_SQL} || body END AS payload
    FROM http"""

_PARSE_SQL = [
    ("payloads", _PAYLOAD_SQL),
    ("pp", f"SELECT seq, payload, strpos(payload, {CRLF_SQL} || {CRLF_SQL}) AS sep FROM payloads"),
    ("pq", "SELECT seq, CASE WHEN sep > 0 THEN substr(payload, 1, sep - 1) ELSE payload END AS head, "
           "CASE WHEN sep > 0 THEN substr(payload, sep + 4) ELSE '' END AS body FROM pp"),
    ("pr", f"SELECT seq, head, body, split_part(head, {CRLF_SQL}, 1) AS first FROM pq"),
]


@register("r1_parse_http", W(["http"], f"""
    SELECT seq, CASE WHEN starts_with(first, 'HTTP/') THEN 'response' ELSE 'request' END AS message_type,
        CASE WHEN NOT starts_with(first, 'HTTP/') THEN split_part(first, ' ', 1) END AS method,
        CASE WHEN NOT starts_with(first, 'HTTP/') THEN split_part(first, ' ', 2) END AS path,
        CASE WHEN starts_with(first, 'HTTP/') THEN split_part(first, ' ', 1)
             ELSE regexp_extract(first, '^[^ ]* [^ ]* (.*)$', 1) END AS protocol,
        CASE WHEN starts_with(first, 'HTTP/') THEN TRY_CAST(split_part(first, ' ', 2) AS INTEGER) END AS status_code,
        CASE WHEN starts_with(first, 'HTTP/') THEN regexp_extract(first, '^[^ ]* [^ ]* (.*)$', 1) END AS status_text,
        nullif(trim(regexp_extract(head, '(?i)\\r\\nhost:([^\\r\\n]*)', 1)), '') AS host,
        nullif(trim(regexp_extract(head, '(?i)\\r\\ncontent-type:([^\\r\\n]*)', 1)), '') AS content_type,
        TRY_CAST(trim(regexp_extract(head, '(?i)\\r\\ncontent-length:([^\\r\\n]*)', 1)) AS INTEGER) AS content_length,
        len(list_filter(string_split(head, {CRLF_SQL})[2:], lambda x: contains(x, ':'))) AS header_count,
        length(body) AS body_length
    FROM pr""", _PARSE_SQL))
def r1_parse_http(spark, sf):
    p = H.parse_http(payloads(spark, sf))
    return p.select("seq", "message_type", "method", "path", "protocol", "status_code", "status_text",
                    F.element_at("headers", F.lit("host")).alias("host"),
                    F.element_at("headers", F.lit("content-type")).alias("content_type"),
                    F.expr("try_cast(element_at(headers, 'content-length') as int)").alias("content_length"),
                    F.size("headers").cast("bigint").alias("header_count"),
                    F.length("body").cast("bigint").alias("body_length"))


@register("f4_strip_auth_headers", W(["http"], f"""
    SELECT seq, len(list_filter(string_split(head, {CRLF_SQL})[2:], lambda x: contains(x, ':')
        AND lower(trim(split_part(x, ':', 1))) NOT IN ('authorization', 'x-api-key', 'x-auth-token', 'bearer',
            'token', 'x-access-token', 'x-session-token', 'cookie', 'set-cookie'))) AS header_count
    FROM pr""", _PARSE_SQL))
def f4_strip_auth_headers(spark, sf):
    p = H.strip_auth_headers(H.parse_http(payloads(spark, sf)))
    return p.select("seq", F.size("headers").cast("bigint").alias("header_count"))


@register("x20_normalized_paths", W(["http"], """
    SELECT seq, path, regexp_replace(regexp_replace(regexp_replace(split_part(path, '?', 1),
        '/[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}', '/{{uuid}}', 'g'),
        '/[0-9]+', '/{{id}}', 'g'), '/[a-f0-9]{24,}', '/{{hash}}', 'g') AS endpoint
    FROM http WHERE message_type = 'request'"""))
def x20_normalized_paths(spark, sf):
    h = FX.http_messages(spark, sf).where(F.col("message_type") == "request")
    return h.select("seq", "path", H.normalize_path(F.col("path")).alias("endpoint"))


@register("f20_drop_overhead", W(["http"], """
    SELECT seq, message_type, method, path, status_code FROM http
    WHERE message_type IN ('request', 'response')
      AND NOT (regexp_matches(coalesce(path, ''), '(?i)(\\.well-known|/handshake|/negotiate|/connect|/ping|/health|/status|/version)')
               OR coalesce(method, '') IN ('OPTIONS', 'HEAD')
               OR (message_type = 'response' AND coalesce(body, '') = '' AND coalesce(status_code, 200) IN (204, 304)))"""))
def f20_drop_overhead(spark, sf):
    return H.drop_overhead(FX.http_messages(spark, sf)).select("seq", "message_type", "method", "path", "status_code")


@register("f22_simple_timeline", W(["http"], """
    SELECT seq, timestamp_ms, CASE WHEN message_type = 'request'
        THEN coalesce(method, 'UNKNOWN') || ' ' || coalesce(path, '/') || ' ' || coalesce(protocol, 'HTTP/1.1')
             || ' host: ' || coalesce(host, 'unknown-host')
        ELSE 'HTTP/1.1 ' || coalesce(CAST(status_code AS VARCHAR), '0') || ' ' || '' || ' content-type: '
             || coalesce(content_type, 'unknown') END AS line
    FROM http"""))
def f22_simple_timeline(spark, sf):
    return H.simple_timeline(FX.http_messages(spark, sf).withColumn("status_text", F.lit(None).cast("string")))


_PAIRS = [("x", """SELECT *, lag(message_type) OVER w AS p_type, lag(seq) OVER w AS p_seq,
        lag(timestamp_ms) OVER w AS p_ts, lag(method) OVER w AS p_method, lag(path) OVER w AS p_path,
        lag(host) OVER w AS p_host FROM http WINDOW w AS (PARTITION BY tid ORDER BY timestamp_ms, seq)"""),
          ("pairs", """SELECT tid, p_seq AS req_seq, seq AS resp_seq, p_ts AS req_ts, timestamp_ms AS resp_ts,
        p_method AS method, p_path AS path, p_host AS host, status_code, content_type,
        timestamp_ms - p_ts AS duration_ms FROM x WHERE message_type = 'response' AND p_type = 'request'""")]


@register("j2_pair_by_tid", W(["http"], "SELECT * FROM pairs", _PAIRS))
def j2_pair_by_tid(spark, sf):
    return H.pair_by_tid(FX.http_messages(spark, sf))


@register("j18_http_spans", W(["http"], """
    SELECT 'req-' || r.seq AS span_id, CAST(NULL AS VARCHAR) AS parent_id, r.tid, r.timestamp_ms AS start_ms,
        p.duration_ms, p.status_code, r.method || ' ' || r.path AS name
    FROM http r LEFT JOIN pairs p ON r.seq = p.req_seq WHERE r.message_type = 'request'
    UNION ALL
    SELECT 'resp-' || resp_seq, 'req-' || req_seq, tid, resp_ts, 0, status_code, 'response' FROM pairs
    UNION ALL
    SELECT 'resp-' || seq, NULL, tid, timestamp_ms, NULL, status_code, 'orphan response' FROM http
    WHERE message_type = 'response' AND seq NOT IN (SELECT resp_seq FROM pairs)""", _PAIRS))
def j18_http_spans(spark, sf):
    return H.http_spans(FX.http_messages(spark, sf))


_LASTM = [("lastm", "SELECT * FROM http WHERE tid IS NOT NULL AND tid <> 0 QUALIFY row_number() OVER "
                    "(PARTITION BY tid, message_type ORDER BY seq DESC) = 1"),
          ("pt", "SELECT q.tid, q.timestamp_ms AS req_ts, q.path AS req_path, q.method AS req_method, "
                 "q.host AS req_host, r.seq AS resp_seq, r.timestamp_ms AS resp_ts, r.status_code AS resp_status, "
                 "r.body AS resp_body, CASE WHEN r.timestamp_ms > q.timestamp_ms THEN r.timestamp_ms - q.timestamp_ms "
                 "END AS lat FROM lastm q LEFT JOIN lastm r ON q.tid = r.tid AND r.message_type = 'response' "
                 "WHERE q.message_type = 'request'")]


@register("a19_response_metrics", W(["http"], """
    SELECT count(lat) AS samples, round(avg(lat), 4) AS mean_ms, round(quantile_cont(lat, 0.5), 4) AS median_ms,
        CAST(min(lat) AS DOUBLE) AS min_ms, CAST(max(lat) AS DOUBLE) AS max_ms, round(stddev_samp(lat), 4) AS stddev_ms,
        round(quantile_cont(lat, 0.95), 4) AS p95_ms, round(quantile_cont(lat, 0.99), 4) AS p99_ms,
        round(avg(length(resp_body)), 4) AS avg_size, count(resp_seq) AS responses
    FROM pt""", _LASTM))
def a19_response_metrics(spark, sf):
    return H.response_metrics(FX.http_messages(spark, sf))


def _top_sql(category, value, where, n):
    lim = f"WHERE r <= {n}" if n else ""
    return f"""SELECT '{category}' AS category, value, count, first_seq FROM (
        SELECT *, row_number() OVER (ORDER BY count DESC, first_seq) AS r FROM (
            SELECT {value} AS value, count(*) AS count, min(seq) AS first_seq FROM http WHERE {where} GROUP BY 1)) {lim}"""


_NORM = ("regexp_replace(regexp_replace(regexp_replace(split_part(coalesce(path, 'unknown'), '?', 1), "
         "'/[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}', '/{{uuid}}', 'g'), "
         "'/[0-9]+', '/{{id}}', 'g'), '/[a-f0-9]{24,}', '/{{hash}}', 'g')")


@register("a20_communication_patterns", W(["http"], " UNION ALL ".join([
    _top_sql("request_method", "coalesce(method, 'unknown')", "message_type = 'request'", 10),
    _top_sql("protocol", "coalesce(protocol, 'unknown')", "message_type = 'request'", None),
    _top_sql("path", _NORM, "message_type = 'request'", 20),
    _top_sql("response_content_type", "coalesce(content_type, 'unknown')", "message_type = 'response'", 10),
    "SELECT 'unique', 'methods', count(DISTINCT coalesce(method, 'unknown')), NULL FROM http WHERE message_type = 'request'",
    f"SELECT 'unique', 'paths', count(DISTINCT {_NORM}), NULL FROM http WHERE message_type = 'request'",
    "SELECT 'unique', 'content_types', count(DISTINCT coalesce(content_type, 'unknown')), NULL FROM http WHERE message_type = 'response'",
    "SELECT 'sse_responses', 'text/event-stream', count(*) FILTER (WHERE contains(content_type, 'text/event-stream')), NULL FROM http "
    "WHERE message_type = 'response'"])))
def a20_communication_patterns(spark, sf):
    return H.communication_patterns(FX.http_messages(spark, sf))


@register("a21_content_stats", W(["http"], """
    SELECT count(*) FILTER (WHERE message_type = 'request' AND b <> '') AS requests_with_body,
        count(*) FILTER (WHERE message_type = 'request' AND b <> '' AND (starts_with(ltrim(b), '{') OR starts_with(ltrim(b), '['))) AS json_requests,
        count(*) FILTER (WHERE message_type = 'request' AND b <> '' AND contains(ct, 'application/x-www-form-urlencoded')) AS form_requests,
        CAST(coalesce(sum(length(b)) FILTER (WHERE message_type = 'request' AND b <> ''), 0) AS BIGINT) AS total_request_size,
        count(*) FILTER (WHERE message_type = 'response' AND b <> '') AS responses_with_body,
        count(*) FILTER (WHERE message_type = 'response' AND b <> '' AND (starts_with(ltrim(b), '{') OR starts_with(ltrim(b), '['))) AS json_responses,
        count(*) FILTER (WHERE message_type = 'response' AND b <> '' AND contains(ct, 'text/html')) AS html_responses,
        count(*) FILTER (WHERE message_type = 'response' AND b <> '' AND NOT contains(ct, 'text/html') AND contains(ct, 'text/event-stream')) AS sse_responses,
        CAST(coalesce(sum(length(b)) FILTER (WHERE message_type = 'response' AND b <> ''), 0) AS BIGINT) AS total_response_size
    FROM (SELECT *, coalesce(body, '') AS b, coalesce(content_type, '') AS ct FROM http)"""))
def a21_content_stats(spark, sf):
    return H.content_stats(FX.http_messages(spark, sf))


@register("a22_endpoint_patterns", W(["http"], f"""
    SELECT endpoint, count(*) AS request_count,
        array_to_string(list_sort(list_distinct(list(req_method))), ',') AS methods,
        array_to_string(list_sort(list_distinct(list(CAST(resp_status AS VARCHAR)))), ',') AS status_codes,
        round(avg(lat), 4) AS avg_latency_ms, max(lat) AS max_latency_ms, min(lat) AS min_latency_ms,
        count(DISTINCT req_host) AS hosts
    FROM (SELECT *, {_NORM.replace('path', 'req_path')} AS endpoint FROM pt)
    GROUP BY endpoint ORDER BY request_count DESC, endpoint LIMIT 15""", _LASTM))
def a22_endpoint_patterns(spark, sf):
    return H.endpoint_patterns(FX.http_messages(spark, sf), 15)


@register("a24_timeline_summary", W(["http"], """
    SELECT count(*) AS messages, CAST(coalesce(sum(length(b)), 0) AS BIGINT) AS total_bytes,
        count(*) FILTER (WHERE t = 'json') AS json_bodies, count(*) FILTER (WHERE t = 'html') AS html_bodies,
        count(*) FILTER (WHERE t = 'sse') AS sse_bodies, count(*) FILTER (WHERE t = 'text') AS text_bodies,
        count(*) FILTER (WHERE t = 'empty') AS empty_bodies, max(timestamp_ms) - min(timestamp_ms) AS duration_ms,
        round(CASE WHEN max(timestamp_ms) - min(timestamp_ms) > 0 THEN
            sum(length(b)) / ((max(timestamp_ms) - min(timestamp_ms)) / 1000) END, 4) AS bytes_per_second
    FROM (SELECT *, coalesce(body, '') AS b,
        CASE WHEN starts_with(ltrim(coalesce(body, '')), '{') OR starts_with(ltrim(coalesce(body, '')), '[') THEN 'json'
             WHEN starts_with(lower(ltrim(coalesce(body, ''))), '<!doctype html') OR contains(lower(coalesce(body, '')), '<html') THEN 'html'
             WHEN starts_with(coalesce(body, ''), 'data:') OR starts_with(coalesce(body, ''), 'event:') THEN 'sse'
             WHEN coalesce(body, '') = '' THEN 'empty' ELSE 'text' END AS t FROM http)"""))
def a24_timeline_summary(spark, sf):
    return H.timeline_summary(FX.http_messages(spark, sf))


# ---- header statistics (A17, A18, A23) ---------------------------------------

_HDR_SQL = _PARSE_SQL + [
    ("msg", f"""SELECT seq, CASE WHEN starts_with(first, 'HTTP/') THEN 'response' ELSE 'request' END AS message_type,
        CASE WHEN NOT starts_with(first, 'HTTP/') THEN split_part(first, ' ', 1) END AS method,
        CASE WHEN NOT starts_with(first, 'HTTP/') THEN split_part(first, ' ', 2) END AS path,
        CASE WHEN starts_with(first, 'HTTP/') THEN TRY_CAST(split_part(first, ' ', 2) AS INTEGER) END AS status_code,
        head FROM pr"""),
    ("hl", f"""SELECT seq, message_type, pos - 1 AS pos, lower(trim(split_part(l, ':', 1))) AS name,
        trim(regexp_extract(l, '^[^:]*:(.*)$', 1)) AS value FROM (
        SELECT seq, message_type, l, row_number() OVER (PARTITION BY seq ORDER BY i) AS pos FROM (
            SELECT seq, message_type, unnest(string_split(head, {CRLF_SQL})[2:]) AS l,
                   unnest(range(len(string_split(head, {CRLF_SQL})) - 1)) AS i FROM msg) WHERE contains(l, ':'))"""),
]


def _top_sql(cat, value, src, where, n):
    lim = f"WHERE r <= {n}" if n else ""
    return f"""SELECT category, value, count FROM (
        SELECT *, row_number() OVER (PARTITION BY category ORDER BY count DESC, fs, fp) AS r FROM (
            SELECT {cat} AS category, CAST({value} AS VARCHAR) AS value, count(*) AS count,
                   arg_min(seq, (seq, pos)) AS fs, arg_min(pos, (seq, pos)) AS fp
            FROM {src} WHERE {where} AND {value} IS NOT NULL GROUP BY 1, 2)) {lim}"""


def _hdr_sql(mt):
    h = f"(SELECT * FROM hl WHERE message_type = '{mt}')"
    m = f"(SELECT *, -1 AS pos FROM msg WHERE message_type = '{mt}')"
    parts = [_top_sql("'header'", "name", h, "true", 20),
             _top_sql("'header_value:' || name", "value", h, "true", 10)]
    if mt == "request":
        parts += [_top_sql("'method'", "coalesce(method, 'UNKNOWN')", m, "true", 10),
                  _top_sql("'url_path'", "coalesce(path, '/')", m, "true", 20),
                  _top_sql("'host'", "value", h, "name = 'host'", 10),
                  _top_sql("'user_agent'", "value", h, "name = 'user-agent'", 10),
                  _top_sql("'content_type'", "value", h, "name = 'content-type'", 10),
                  _top_sql("'authorization_type'", "CASE WHEN contains(value, ' ') THEN split_part(value, ' ', 1) ELSE value END",
                           h, "name = 'authorization'", 10)]
    else:
        parts += [_top_sql("'status_code'", "status_code", m, "true", 10),
                  _top_sql("'content_type'", "value", h, "name = 'content-type'", 10),
                  _top_sql("'cache_header'", "name || ': ' || value", h, f"name IN {tuple(H.CACHE_HEADERS)}", 10),
                  _top_sql("'security_header'", "name", h, f"name IN {tuple(H.SECURITY_HEADERS)}", None),
                  _top_sql("'server'", "value", h, "name = 'server'", 10),
                  _top_sql("'encoding'", "value", h, "name = 'content-encoding'", 10)]
    return " UNION ALL ".join(parts)


@register("a17_request_header_stats", W(["http"], _hdr_sql("request"), _HDR_SQL))
def a17_request_header_stats(spark, sf):
    return H.header_stats(H.parse_http(payloads(spark, sf)), "request")


@register("a18_response_header_stats", W(["http"], _hdr_sql("response"), _HDR_SQL))
def a18_response_header_stats(spark, sf):
    return H.header_stats(H.parse_http(payloads(spark, sf)), "response")


@register("a18_content_length_stats", W(["http"], """
    SELECT count(*) AS count, min(cl) AS min, max(cl) AS max, round(avg(cl), 4) AS mean, CAST(sum(cl) AS BIGINT) AS total FROM (
        SELECT TRY_CAST(value AS BIGINT) AS cl FROM hl WHERE message_type = 'response' AND name = 'content-length')
    WHERE cl IS NOT NULL""", _HDR_SQL))
def a18_content_length_stats(spark, sf):
    return H.content_length_stats(H.parse_http(payloads(spark, sf)))


# ---- F5 / F7: filter expressions ---------------------------------------------

from ..functions import filters as FL  # noqa: E402

FILTERS = ["request.method=options | response.status_code=404", "path_prefix=/en & method=POST", "page=2",
           "response.content_type=event-stream", "health"]

_PARSED_SQL = _PARSE_SQL + [
    ("parsed", f"""SELECT seq, CASE WHEN starts_with(first, 'HTTP/') THEN 'response' ELSE 'request' END AS message_type,
        CASE WHEN NOT starts_with(first, 'HTTP/') THEN split_part(first, ' ', 1) END AS method,
        CASE WHEN NOT starts_with(first, 'HTTP/') THEN split_part(first, ' ', 2) END AS path,
        CASE WHEN starts_with(first, 'HTTP/') THEN TRY_CAST(split_part(first, ' ', 2) AS INTEGER) END AS status_code,
        nullif(trim(regexp_extract(head, '(?i)\\r\\ncontent-type:([^\\r\\n]*)', 1)), '') AS content_type,
        body FROM pr"""),
    ("matched", """SELECT seq, (
          (message_type = 'request' AND lower(coalesce(method, '')) = 'options')
          OR (message_type = 'response' AND coalesce(status_code, 0) = 404)
          OR (message_type = 'request' AND starts_with(coalesce(path, ''), '/en') AND lower(coalesce(method, '')) = 'post')
          OR (message_type = 'request' AND contains(CASE WHEN contains(coalesce(path, ''), '?')
                THEN substr(path, strpos(path, '?') + 1) ELSE '' END, 'page=2'))
          OR (message_type = 'response' AND contains(coalesce(content_type, ''), 'event-stream'))
          OR (message_type = 'request' AND contains(coalesce(path, ''), 'health'))) AS hit FROM parsed"""),
]


def _parsed(spark, sf):
    return H.parse_http(payloads(spark, sf))


@register("f5_http_filter", W(["http"], "SELECT p.seq, p.message_type, p.path, p.status_code FROM parsed p "
                                        "JOIN matched m ON p.seq = m.seq WHERE NOT m.hit", _PARSED_SQL))
def f5_http_filter(spark, sf):
    return FL.http_filter(_parsed(spark, sf), FILTERS).select("seq", "message_type", "path", "status_code")


@register("f7_filter_metrics", W(["http"], "SELECT count(*) AS total, count(*) FILTER (WHERE hit) AS filtered, "
                                           "count(*) FILTER (WHERE NOT hit) AS passed FROM matched", _PARSED_SQL))
def f7_filter_metrics(spark, sf):
    hit = F.lit(False)
    for p in FILTERS:
        hit = hit | FL.compile_http_filter(p)
    return FL.filter_metrics(_parsed(spark, sf), hit)


# ---- R2 / R3: server-sent events ----------------------------------------------

from ..operators import sse as SSE  # noqa: E402

_NL = "chr(10)"
_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _strip(x):
    return _STRIP.format(x=x)


_SSE_SQL = [
    ("b0", "SELECT *, string_split(body, chr(13) || chr(10)) AS ls FROM sse_bodies"),
    ("b1", f"""SELECT *, coalesce(list_position(list_transform(ls, lambda l: regexp_matches({_strip('l')}, '^[0-9a-fA-F]+$')
                AND (length({_strip('l')}) > 8 OR regexp_matches({_strip('l')}, '^0+$'))), true), len(ls) + 1) AS zero_at FROM b0"""),
    ("b2", f"""SELECT *, array_to_string([ls[i + 1] FOR i IN range(1, len(ls)) IF i < zero_at
                AND regexp_matches({_strip('ls[i]')}, '^[0-9a-fA-F]+$')], {_NL}) AS clean FROM b1"""),
    ("b3", f"""SELECT pid, tid, seq, timestamp_ms, replace(CASE WHEN {_strip('clean')} = '' THEN body ELSE clean END,
                chr(13) || chr(10), {_NL}) AS norm FROM b2"""),
    ("blk", f"""SELECT pid, tid, seq, timestamp_ms, i - 1 AS block_no, string_split(norm, {_NL} || {_NL})[i] AS block
                FROM (SELECT *, unnest(range(1, len(string_split(norm, {_NL} || {_NL})) + 1)) AS i FROM b3)"""),
    ("ev0", f"""SELECT pid, tid, seq, timestamp_ms, block_no,
                list_transform(string_split(block, {_NL}), lambda l: {_strip('l')}) AS lines FROM blk
                WHERE {_strip('block')} <> ''"""),
    ("sse", f"""SELECT pid, tid, seq, timestamp_ms, block_no,
                CASE WHEN len(list_filter(lines, lambda l: starts_with(l, 'event:'))) > 0
                     THEN {_strip("substr(list_filter(lines, lambda l: starts_with(l, 'event:'))[-1], 7)")} END AS event,
                CASE WHEN len(list_filter(lines, lambda l: starts_with(l, 'data:'))) > 0
                     THEN array_to_string(list_transform(list_filter(lines, lambda l: starts_with(l, 'data:')),
                          lambda l: {_strip("substr(l, 6)")}), {_NL}) END AS data,
                CASE WHEN len(list_filter(lines, lambda l: starts_with(l, 'id:'))) > 0
                     THEN {_strip("substr(list_filter(lines, lambda l: starts_with(l, 'id:'))[-1], 4)")} END AS id
                FROM ev0"""),
    ("sse2", "SELECT *, coalesce(json_valid(data), false) AS is_json FROM sse WHERE event IS NOT NULL OR data IS NOT NULL"),
]

_R3_SQL = _SSE_SQL + [
    ("r0", """SELECT pid, tid, seq, timestamp_ms, block_no, event,
            CASE WHEN is_json AND event = 'message_start' THEN data->>'$.message.id' END AS mid,
            coalesce(CASE WHEN is_json AND event = 'content_block_delta' AND data->>'$.delta.type' = 'text_delta' THEN data->>'$.delta.text'
                          WHEN is_json AND event = 'content_block_delta' AND data->>'$.delta.type' = 'thinking_delta' THEN data->>'$.delta.thinking' END, '') AS txt,
            coalesce(data = '[DONE]', false) OR (is_json AND (json_exists(data, '$.usage') OR json_exists(data, '$.usageMetadata')))
                OR event IN ('message_stop', 'error') AS done,
            CASE WHEN is_json THEN TRY_CAST(data->>'$.message.usage.input_tokens' AS BIGINT) END AS i_tok,
            CASE WHEN is_json THEN TRY_CAST(data->>'$.usage.output_tokens' AS BIGINT) END AS o_tok,
            CASE WHEN is_json THEN data->>'$.message.model' END AS model FROM sse2"""),
    ("r1", """SELECT *, coalesce(last_value(mid IGNORE NULLS) OVER (PARTITION BY pid, tid ORDER BY seq, block_no
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'w' || (timestamp_ms // 600000)) AS message_key FROM r0"""),
    ("r2", """SELECT *, sum(length(txt)) OVER (PARTITION BY pid, tid, message_key ORDER BY seq, block_no
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chars FROM r1"""),
    ("r3", """SELECT r2.*, e.endpos FROM r2 LEFT JOIN (SELECT pid, tid, message_key, min(seq * 1000000 + block_no) AS endpos
                FROM r2 WHERE done GROUP BY 1, 2, 3) e
              ON r2.pid = e.pid AND r2.tid = e.tid AND r2.message_key = e.message_key"""),
]


@register("r2_sse_events", W(["sse_bodies"], "SELECT pid, tid, seq, timestamp_ms, block_no, event, data, id, is_json FROM sse2",
                             _SSE_SQL))
def r2_sse_events(spark, sf):
    return SSE.sse_events(FX.sse_bodies(spark, sf))


@register("r3_reassemble_sse", W(["sse_bodies"], """
    SELECT pid, tid, message_key, min(seq) AS first_seq, min(timestamp_ms) AS start_ms, max(timestamp_ms) AS end_ms,
        count(*) AS events, string_agg(txt, '' ORDER BY seq, block_no) AS text, bool_or(endpos IS NOT NULL) AS complete,
        max(i_tok) AS input_tokens, max(o_tok) AS output_tokens, max(model) AS model,
        CAST(length(string_agg(txt, '' ORDER BY seq, block_no)) AS BIGINT) AS text_len
    FROM r3 WHERE endpos IS NULL OR seq * 1000000 + block_no <= endpos
    GROUP BY pid, tid, message_key
    HAVING string_agg(txt, '' ORDER BY seq, block_no) <> '' OR max(i_tok) IS NOT NULL OR max(o_tok) IS NOT NULL""", _R3_SQL))
def r3_reassemble_sse(spark, sf):
    return SSE.reassemble_sse(SSE.sse_events(FX.sse_bodies(spark, sf)))


_R4_SQL = _R3_SQL[:-3] + [
    ("own", "SELECT seq, string_agg(txt, '' ORDER BY block_no) AS txt FROM r0 GROUP BY seq"),
    ("chain", """SELECT t.*, CASE WHEN type = 'sse_chunk' AND tid = lag(tid) OVER w AND timestamp_ms - lag(timestamp_ms) OVER w <= 5000 THEN 0 ELSE 1 END AS new
        FROM sse_timeline t WINDOW w AS (PARTITION BY run_id ORDER BY timestamp_ms, seq)"""),
    ("isl4", "SELECT *, sum(new) OVER (PARTITION BY run_id ORDER BY timestamp_ms, seq) AS island FROM chain"),
    ("said", """SELECT i.*, CASE WHEN i.seq % 4 = 3 THEN '!' WHEN i.seq % 4 = 2 OR i.seq % 4 = 1 AND i.body <> '' THEN o.txt ELSE '' END AS txt
        FROM isl4 i LEFT JOIN own o ON o.seq = i.seq // 4"""),
    ("merged", """SELECT run_id, island, string_agg(txt, '' ORDER BY timestamp_ms, seq) AS txt, count(*) FILTER (WHERE type = 'sse_chunk') AS chunks,
        max(timestamp_ms) AS end_ms FROM said GROUP BY run_id, island"""),
]


@register("r4_merge_sse_chunks", W(["sse_timeline"], """
    SELECT run_id, seq, timestamp_ms, tid, type, content_type, CASE WHEN s AND txt <> '' THEN txt ELSE body END AS body,
        CASE WHEN s THEN chunks ELSE 0 END AS chunks, CASE WHEN s THEN end_ms ELSE timestamp_ms END AS end_ms,
        coalesce(s AND starts_with(ltrim(txt), '{') AND json_valid(txt), false) AS is_json
    FROM (SELECT i.*, m.txt, m.chunks, m.end_ms, coalesce(contains(content_type, 'event-stream'), false) AS s
          FROM isl4 i JOIN merged m USING (run_id, island) WHERE type <> 'sse_chunk')""", _R4_SQL))
def r4_merge_sse_chunks(spark, sf):
    return SSE.merge_sse_chunks(FX.sse_timeline(spark, sf), scope=["run_id"])


# ---- F1 / F2 / X1–X3: canonical events from raw envelopes --------------------------

from ..operators import canonical as CN  # noqa: E402


def _raw_envelopes(spark, sf):
    """Raw events of three sources rebuilt from the driver tables: HTTP
    parser events from ``pages`` (some on LLM API paths with JSON bodies),
    process events and system samples from ``events``."""
    pages = FX.read_table(spark, sf, "pages")
    pid = F.col("page_id")
    m6 = pid % 6
    host = F.regexp_extract("url", FX.URL_HOST, 1)
    path = (F.when(m6 == 0, F.lit("/v1/messages"))
            .when(m6 == 1, F.format_string("/v1beta/models/gemini-%d:generateContent", pid % 3))
            .otherwise(F.regexp_extract("url", FX.URL_PATH, 1)))
    req = pages.select(
        (pid * 1000).alias("timestamp"), F.lit("http_parser").alias("source"), (pid % 7).alias("pid"),
        F.lit("agent").alias("comm"),
        F.to_json(F.struct(F.lit("request").alias("message_type"),
                           F.when(pid % 4 == 0, "POST").otherwise("GET").alias("method"), path.alias("path"),
                           (pid % 16).alias("tid"),
                           F.struct(host.alias("host"), F.when(pid % 4 == 0, F.format_string("r-%d", pid))
                                    .alias("X-Request-Id")).alias("headers"),
                           F.when(m6 == 0, F.format_string('{"model":"m-%d"}', pid % 3))
                            .when(m6 == 1, F.lit('{"contents":[]}')).otherwise(F.lit("")).alias("body")))
        .alias("data"))
    status = F.when(pid % 10 == 1, 500).when(pid % 10 == 0, 404).otherwise(200)
    resp = pages.select(
        (pid * 1000 + 500).alias("timestamp"), F.lit("http_parser").alias("source"), (pid % 7).alias("pid"),
        F.lit("agent").alias("comm"),
        F.to_json(F.struct(F.lit("response").alias("message_type"), status.alias("status_code"),
                           (pid % 16).alias("tid"), F.struct(host.alias("host")).alias("headers"),
                           F.when(m6 == 0, F.lit('{"usage":{"input_tokens":5}}')).otherwise(F.lit("")).alias("body")))
        .alias("data"))
    c = FX.canonical_events(spark, sf)
    proc = c.where(F.col("event").isin("EXEC", "EXIT")).select(
        "timestamp_ms", F.lit("process").alias("source"), "pid", "comm",
        F.to_json(F.struct(F.col("event").alias("event"), F.col("ppid").alias("ppid"),
                           F.col("filename").alias("filename"))).alias("data")).withColumnRenamed("timestamp_ms", "timestamp")
    sysr = c.where(F.col("event") == "FILE_OPEN").select(
        "timestamp_ms", F.lit("system").alias("source"), "pid", "comm",
        F.to_json(F.struct(F.struct(F.format_string("%.2f", "value").alias("percent")).alias("cpu"),
                           (F.col("value") > 100).alias("alert"))).alias("data")).withColumnRenamed("timestamp_ms", "timestamp")
    raw = req.unionByName(resp).unionByName(proc).unionByName(sysr)
    return raw.withColumn("data", F.expr("parse_json(data)"))


def _hdr_sql(name):
    return (f"json_extract_string(data, '$.headers.\"' || list_filter(coalesce(json_keys(data, '$.headers'), []), "
            f"lambda k: lower(k) = '{name}')[1] || '\"')")


_F1_SQL = [
    ("raw_env", f"""
        SELECT page_id * 1000 AS timestamp, 'http_parser' AS source, page_id % 7 AS pid, 'agent' AS comm,
            json_object('message_type', 'request', 'method', CASE WHEN page_id % 4 = 0 THEN 'POST' ELSE 'GET' END,
                'path', CASE page_id % 6 WHEN 0 THEN '/v1/messages'
                             WHEN 1 THEN '/v1beta/models/gemini-' || (page_id % 3) || ':generateContent'
                             ELSE regexp_extract(url, '{FX.URL_PATH}', 1) END,
                'tid', page_id % 16,
                'headers', CASE WHEN page_id % 4 = 0 THEN json_object('host', regexp_extract(url, '{FX.URL_HOST}', 1), 'X-Request-Id', 'r-' || page_id)
                                ELSE json_object('host', regexp_extract(url, '{FX.URL_HOST}', 1)) END,
                'body', CASE page_id % 6 WHEN 0 THEN '{{"model":"m-' || (page_id % 3) || '"}}' WHEN 1 THEN '{{"contents":[]}}' ELSE '' END)::VARCHAR AS data
        FROM pages
        UNION ALL
        SELECT page_id * 1000 + 500, 'http_parser', page_id % 7, 'agent',
            json_object('message_type', 'response',
                'status_code', CASE WHEN page_id % 10 = 1 THEN 500 WHEN page_id % 10 = 0 THEN 404 ELSE 200 END,
                'tid', page_id % 16, 'headers', json_object('host', regexp_extract(url, '{FX.URL_HOST}', 1)),
                'body', CASE WHEN page_id % 6 = 0 THEN '{{"usage":{{"input_tokens":5}}}}' ELSE '' END)::VARCHAR
        FROM pages
        UNION ALL
        SELECT timestamp_ms, 'process', pid, comm, json_object('event', event, 'ppid', ppid, 'filename', filename)::VARCHAR
        FROM canon WHERE event IN ('EXEC', 'EXIT')
        UNION ALL
        SELECT timestamp_ms, 'system', pid, comm,
            json_object('cpu', json_object('percent', printf('%.2f', value)), 'alert', value > 100)::VARCHAR
        FROM canon WHERE event = 'FILE_OPEN'"""),
    ("env", """SELECT *, CASE WHEN json_valid(data ->> '$.body') THEN data ->> '$.body' END AS body,
            data ->> '$.message_type' AS mt, TRY_CAST(data ->> '$.status_code' AS INTEGER) AS status,
            data ->> '$.path' AS path0,
            coalesce(data ->> '$.host', data ->> '$.headers.host', data ->> '$.headers.":authority"') AS host0,
            coalesce(data ->> '$.event', '') AS ev FROM raw_env"""),
    ("env2", f"""SELECT *, coalesce(body ->> '$.model', body ->> '$.response.model') AS body_model,
            (body IS NOT NULL AND (json_exists(body, '$.usage') OR json_exists(body, '$.usageMetadata'))) AS has_usage,
            coalesce(ends_with(coalesce(path0, ''), '{CN.LLM_PATH_SUFFIX}')
                {''.join(f" OR contains(coalesce(path0, ''), '{p}')" for p in CN.LLM_PATH_PARTS)}, false) AS llm_path,
            coalesce(status >= 400, false) AS err FROM env"""),
]


@register("f1_normalize_events", W(["canon"], f"""
    SELECT timestamp, source,
        CASE WHEN source = 'http_parser' AND mt = 'request' THEN CASE WHEN llm_path THEN 'LlmRequest' ELSE 'HttpRequest' END
             WHEN source = 'http_parser' AND mt = 'response' THEN
                CASE WHEN llm_path OR coalesce(body_model IS NOT NULL OR has_usage, false)
                     THEN CASE WHEN err THEN 'LlmError' ELSE 'LlmResponse' END ELSE 'HttpResponse' END
             WHEN source = 'process' THEN CASE WHEN ev = 'EXEC' THEN 'ProcessExec' WHEN ev = 'EXIT' THEN 'ProcessExit'
                  WHEN contains(ev, 'FILE_OPEN') THEN 'FsOpen' WHEN contains(ev, 'FILE_WRITE') THEN 'FsWrite'
                  WHEN contains(ev, 'FILE_') THEN 'FsMutation' ELSE 'Unknown' END
             WHEN source = 'system' THEN 'ResourceSample' ELSE 'Unknown' END AS kind,
        CASE WHEN source = 'http_parser' AND mt = 'response' AND err THEN 'Error'
             WHEN source = 'system' AND coalesce(TRY_CAST(data ->> '$.alert' AS BOOLEAN), false) THEN 'Warning'
             ELSE 'Info' END AS severity,
        pid, TRY_CAST(data ->> '$.tid' AS BIGINT) AS tid, TRY_CAST(data ->> '$.ppid' AS BIGINT) AS ppid, comm,
        host0 AS host, data ->> '$.method' AS method, path0 AS path, status AS status_code,
        CASE WHEN host0 IS NULL THEN NULL
             WHEN contains(lower(host0), 'openai.azure.com') THEN 'azure.ai.openai' WHEN contains(lower(host0), 'openai') THEN 'openai'
             WHEN contains(lower(host0), 'anthropic') THEN 'anthropic'
             WHEN contains(lower(host0), 'generativelanguage') OR contains(lower(host0), 'googleapis') THEN 'gcp.gen_ai'
             WHEN contains(lower(host0), 'bedrock') THEN 'aws.bedrock' ELSE host0 END AS provider,
        coalesce(body_model, CASE WHEN contains(coalesce(path0, ''), '/models/') THEN nullif(
            CASE WHEN contains(regexp_extract(path0, '/models/(.*)$', 1), ':') THEN split_part(regexp_extract(path0, '/models/(.*)$', 1), ':', 1)
                 WHEN contains(regexp_extract(path0, '/models/(.*)$', 1), '/') THEN split_part(regexp_extract(path0, '/models/(.*)$', 1), '/', 1)
                 ELSE regexp_extract(path0, '/models/(.*)$', 1) END, '') END) AS model,
        coalesce(data ->> '$.request_id', data ->> '$.requestId', data ->> '$.requestID',
                 {', '.join(_hdr_sql(h) for h in CN.REQUEST_ID_HEADERS)}) AS request_id,
        0.75 AS confidence
    FROM env2""", _F1_SQL))
def f1_normalize_events(spark, sf):
    return CN.normalize_events(_raw_envelopes(spark, sf))


# ---- F21 data timeline, A23 traffic report ----------------------------------------

@register("f21_data_timeline", W(["http"], f"""
    SELECT seq, timestamp_ms, message_type, method, path, status_code, content_type,
        CAST(length(coalesce(body, '')) AS BIGINT) AS body_size FROM http
    WHERE (message_type = 'request' AND (coalesce(body, '') <> ''
            OR regexp_matches(coalesce(path, ''), '(?i)({"|".join(H.DATA_ENDPOINTS)})')))
       OR (message_type = 'response' AND (coalesce(body, '') <> '' OR contains(coalesce(content_type, ''), 'text/event-stream')))
    ORDER BY timestamp_ms, seq"""))
def f21_data_timeline(spark, sf):
    return H.data_timeline(FX.http_messages(spark, sf))


def _a23_sql():
    a19 = ORACLES["a19_response_metrics"]
    a21 = ORACLES["a21_content_stats"]
    s19 = a19[a19.index("SELECT count(lat)"):]
    s21 = a21[a21.index("SELECT count(*) FILTER"):]
    return W(["http"], f"""SELECT c.*, m.*, s.* FROM
        (SELECT count(*) FILTER (WHERE message_type = 'request') AS total_requests,
                count(*) FILTER (WHERE message_type = 'response') AS total_responses, count(DISTINCT host) AS hosts FROM http) c,
        ({s19}) m, ({s21}) s""", _LASTM)


@register("a23_traffic_report")
def a23_traffic_report(spark, sf):
    return H.traffic_report(FX.http_messages(spark, sf))


from .registry import ORACLES  # noqa: E402

ORACLES["a23_traffic_report"] = _a23_sql()


def _int_sql(u, names):
    picks = ", ".join(f"CASE WHEN json_type({u}, '$.{n}') IN ('BIGINT', 'UBIGINT') THEN CAST({u} ->> '$.{n}' AS BIGINT) END"
                      for n in names)
    return f"coalesce({picks}, 0)"


def _usage_sql(u):
    return (f"{_int_sql(u, ['input_tokens', 'prompt_tokens', 'promptTokenCount'])} AS i, "
            f"greatest({_int_sql(u, ['output_tokens', 'completion_tokens'])}, "
            f"{_int_sql(u, ['candidatesTokenCount'])} + {_int_sql(u, ['thoughtsTokenCount'])}) AS o, "
            f"{_int_sql(u, ['cache_creation_input_tokens', 'cache_creation_tokens'])} AS cc, "
            f"{_int_sql(u, ['cache_read_input_tokens', 'cache_read_tokens', 'cachedContentTokenCount'])} AS cr, "
            f"CASE WHEN {_int_sql(u, ['totalTokenCount'])} > 0 THEN {_int_sql(u, ['totalTokenCount'])} END AS tot")


@register("x5_sse_usage", W(["sse_bodies"], f"""
    SELECT pid, tid, seq, max(i) AS input_tokens, max(o) AS output_tokens, max(cc) AS cache_creation_tokens,
        max(cr) AS cache_read_tokens, max(tot) AS total_override,
        coalesce(max(tot), max(i) + max(o) + max(cc) + max(cr)) AS total_tokens
    FROM (SELECT pid, tid, seq, {_usage_sql('u')} FROM (
            SELECT pid, tid, seq, json_extract(data, '$.message.usage') AS u FROM sse2 WHERE is_json
            UNION ALL SELECT pid, tid, seq, json_extract(data, '$.usage') FROM sse2 WHERE is_json
            UNION ALL SELECT pid, tid, seq, json_extract(data, '$.usageMetadata') FROM sse2 WHERE is_json)
          WHERE u IS NOT NULL AND json_type(u) = 'OBJECT')
    GROUP BY pid, tid, seq""", _SSE_SQL))
def x5_sse_usage(spark, sf):
    return CN.sse_usage(SSE.sse_events(FX.sse_bodies(spark, sf)), ["pid", "tid", "seq"])


# ---- X2 / X6 / X7 / X12: LLM request and response bodies ----------------------------

def _llm_bodies(spark, sf):
    """One LLM exchange per user turn in one of three vendor body shapes."""
    conv = FX.read_table(spark, sf, "conversations").where(F.col("role") == "user")
    c, t, shape = F.col("conv_id"), F.col("turn"), F.col("conv_id") % 3
    openai = F.to_json(F.struct(F.lit("gpt-4o").alias("model"),
                                F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"),
                                F.struct(F.format_string("user_abc_session_%d", c).alias("user_id")).alias("metadata")))
    anthropic = F.to_json(F.struct(F.lit("claude-x").alias("model"), F.array(F.struct(
        F.lit("user").alias("role"),
        F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"))).alias("messages"),
        F.struct(F.format_string("s-%d", c).alias("session_id")).alias("metadata")))
    gemini = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.array(
        F.struct(F.col("text").alias("text"))).alias("parts"))).alias("contents")))
    resp = (F.when(shape == 0, F.to_json(F.struct(F.format_string("chatcmpl-%d-%d", c, t).alias("id"),
                                                  F.array(F.struct(F.lit("stop").alias("finish_reason"))).alias("choices"))))
            .when(shape == 1, F.to_json(F.struct(F.format_string("msg_%d_%d", c, t).alias("id"),
                                                 F.lit("end_turn").alias("stop_reason"))))
            .otherwise(F.to_json(F.struct(F.array(F.struct(F.lit("STOP").alias("finishReason"))).alias("candidates")))))
    path = (F.when(shape == 0, "/v1/chat/completions").when(shape == 1, "/v1/messages")
            .otherwise("/v1beta/models/gemini:generateContent"))
    return conv.select("conv_id", "turn", path.alias("path"),
                       F.when(shape == 0, openai).when(shape == 1, anthropic).otherwise(gemini).alias("request"),
                       resp.alias("response"),
                       F.when(t % 5 == 4, 500).otherwise(200).alias("status_code"),
                       F.when(t % 7 == 6, F.lit(None).cast("bigint")).otherwise(t * 1000).alias("end_ms"))


@register("x12_llm_body_fields", W([], r"""
    SELECT conv_id, turn,
        CASE WHEN contains(path, '/v1/responses') THEN 'responses' WHEN contains(path, '/v1/messages') THEN 'messages'
             WHEN contains(path, '/chat/completions') THEN 'chat' WHEN contains(path, ':streamGenerateContent') THEN 'stream_generate_content'
             WHEN contains(path, ':generateContent') THEN 'generate_content' END AS call_kind,
        CASE WHEN end_ms IS NULL THEN 'pending' WHEN status_code >= 400 THEN 'error' ELSE 'complete' END AS status,
        nullif(regexp_replace(trim(array_to_string(list_filter(list_concat(
            flatten(list_transform(coalesce(json_extract(request, '$.messages[*]'), []), lambda m:
                CASE WHEN json_type(m, '$.content') = 'VARCHAR' THEN [m ->> '$.content']
                     WHEN json_type(m, '$.content') = 'ARRAY' THEN list_transform(json_extract(m, '$.content[*]'), lambda p: p ->> '$.text')
                     ELSE [] END)),
            flatten(list_transform(coalesce(json_extract(request, '$.contents[*]'), []), lambda q:
                list_transform(coalesce(json_extract(q, '$.parts[*]'), []), lambda p: p ->> '$.text')))),
            lambda x: x IS NOT NULL), ' ')), '\s+', ' ', 'g'), '') AS prompt_text,
        coalesce(request ->> '$.session_id', request ->> '$.sessionId', request ->> '$.metadata.session_id',
                 request ->> '$.metadata.sessionId',
                 CASE WHEN contains(request ->> '$.metadata.user_id', '_session_')
                      THEN nullif(split_part(request ->> '$.metadata.user_id', '_session_', 2), '') END) AS session_id,
        coalesce(response ->> '$.conversation_id', response ->> '$.id') AS conversation_id,
        coalesce(response ->> '$.finish_reason', response ->> '$.stop_reason', response ->> '$.choices[0].finish_reason',
                 response ->> '$.candidates[0].finishReason') AS finish_reason
    FROM (SELECT conv_id, turn, conv_id % 3 AS shape,
            CASE conv_id % 3 WHEN 0 THEN '/v1/chat/completions' WHEN 1 THEN '/v1/messages'
                 ELSE '/v1beta/models/gemini:generateContent' END AS path,
            CASE conv_id % 3 WHEN 0 THEN json_object('model', 'gpt-4o', 'messages', [json_object('role', 'user', 'content', text)],
                                                     'metadata', json_object('user_id', 'user_abc_session_' || conv_id))
                 WHEN 1 THEN json_object('model', 'claude-x', 'messages', [json_object('role', 'user', 'content',
                                 [json_object('type', 'text', 'text', text)])], 'metadata', json_object('session_id', 's-' || conv_id))
                 ELSE json_object('contents', [json_object('role', 'user', 'parts', [json_object('text', text)])]) END AS request,
            CASE conv_id % 3 WHEN 0 THEN json_object('id', 'chatcmpl-' || conv_id || '-' || turn, 'choices', [json_object('finish_reason', 'stop')])
                 WHEN 1 THEN json_object('id', 'msg_' || conv_id || '_' || turn, 'stop_reason', 'end_turn')
                 ELSE json_object('candidates', [json_object('finishReason', 'STOP')]) END AS response,
            CASE WHEN turn % 5 = 4 THEN 500 ELSE 200 END AS status_code,
            CASE WHEN turn % 7 = 6 THEN NULL ELSE turn * 1000 END AS end_ms
          FROM conversations WHERE role = 'user')"""))
def x12_llm_body_fields(spark, sf):
    b = _llm_bodies(spark, sf).withColumn("_req", F.expr("try_parse_json(request)")) \
        .withColumn("_resp", F.expr("try_parse_json(response)"))
    return b.select("conv_id", "turn", CN.call_kind(F.col("path")).alias("call_kind"),
                    CN.call_status(F.col("end_ms"), F.col("status_code")).alias("status"),
                    CN.extract_prompt_text(F.col("request")).alias("prompt_text"),
                    CN.session_id_from_body("_req").alias("session_id"),
                    CN.conversation_id_from_body("_resp").alias("conversation_id"),
                    CN.finish_reason("_resp").alias("finish_reason"))


# ---- F6: TLS event filter ----------------------------------------------------------

SSL_FILTERS = ["function=SSL_read & len>5000", "(pid=3 | pid=4) & data.type=text & latency_ms>=5.5",
               "comm~gent & is_handshake=true", "function<SSL_write"]


def _tls_events(spark, sf):
    p = FX.read_table(spark, sf, "pages")
    pid = F.col("page_id")
    return p.select(pid.alias("seq"), (pid % 7).alias("pid"), (pid % 16).alias("tid"),
                    F.when(pid % 2 == 0, "SSL_read").otherwise("SSL_write").alias("function"),
                    F.lit("agent").alias("comm"), F.length("html").cast("bigint").alias("len"),
                    ((pid % 100) / 10).alias("latency_ms"), (pid % 9 == 0).alias("is_handshake"),
                    F.col("html").alias("data"))


@register("f6_ssl_filter", W([], r"""
    SELECT seq, pid, function FROM (
        SELECT page_id AS seq, page_id % 7 AS pid, CASE WHEN page_id % 2 = 0 THEN 'SSL_read' ELSE 'SSL_write' END AS function,
            length(html) AS len, (page_id % 100) / 10 AS latency_ms, page_id % 9 = 0 AS is_handshake, html AS data
        FROM pages)
    WHERE NOT ((function = 'SSL_read' AND len > 5000)
            OR ((pid = 3 OR pid = 4) AND NOT regexp_matches(data, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]') AND latency_ms >= 5.5)
            OR (contains('agent', 'gent') AND is_handshake))"""))
def f6_ssl_filter(spark, sf):
    return FL.ssl_filter(_tls_events(spark, sf), SSL_FILTERS).select("seq", "pid", "function")


# ---- R10: tool calls announced in SSE streams --------------------------------------

_TOOLS_LIST = "[" + ", ".join(f"'{x}'" for x in FX.TOOLS) + "]"

def _tool_sse_bodies(spark, sf):
    conv = FX.read_table(spark, sf, "conversations").where((F.col("role") == "assistant") & (F.col("turn") % 3 == 1))
    c, t = F.col("conv_id"), F.col("turn")
    block = F.to_json(F.struct(F.lit("content_block_start").alias("type"), F.lit(1).alias("index"), F.struct(
        F.lit("tool_use").alias("type"),
        F.when(c % 4 != 0, F.format_string("toolu_%d_%d", c, t)).alias("id"),
        F.element_at(F.array(*[F.lit(x) for x in FX.TOOLS]), ((c + t) % 4 + 1).cast("int")).alias("name"),
        F.struct(F.format_string("ls /repo/d%d", t % 3).alias("command")).alias("input")).alias("content_block")))
    body = F.concat(F.lit("event: content_block_start\ndata: "), block, F.lit("\n\nevent: ping\ndata: {}\n"))
    return conv.select((c % 7).alias("pid"), (c % 3 + 1).alias("tid"), (c * 1000 + t).alias("seq"),
                       (F.lit(FX.EPOCH_2024_MS) + c * 3600000 + t * 60000).alias("timestamp_ms"), body.alias("body"))


@register("r10_tools_from_sse", W([], f"""
    SELECT 'tool-' || seq || '-' || coalesce(data ->> '$.content_block.id', 'tool-' || block_no) AS id, seq AS llm_call,
        timestamp_ms, pid, coalesce(data ->> '$.content_block.name', '?') AS tool_name,
        data ->> '$.content_block.id' AS tool_call_id, (data -> '$.content_block.input')::VARCHAR AS input,
        'observed' AS status
    FROM (SELECT pid, seq, timestamp_ms, i - 1 AS block_no,
            regexp_replace(string_split(body, chr(10) || chr(10))[i], '^event: [^\\n]*\\ndata: ', '') AS data
          FROM (SELECT *, unnest(range(1, len(string_split(body, chr(10) || chr(10))) + 1)) AS i FROM (
            SELECT conv_id % 7 AS pid, conv_id * 1000 + turn AS seq,
                {FX.EPOCH_2024_MS} + conv_id * 3600000 + turn * 60000 AS timestamp_ms,
                'event: content_block_start' || chr(10) || 'data: ' || json_object('type', 'content_block_start', 'index', 1,
                    'content_block', CASE WHEN conv_id % 4 <> 0
                        THEN json_object('type', 'tool_use', 'id', 'toolu_' || conv_id || '_' || turn,
                                         'name', {_TOOLS_LIST}[(conv_id + turn) % 4 + 1], 'input', json_object('command', 'ls /repo/d' || (turn % 3)))
                        ELSE json_object('type', 'tool_use', 'name', {_TOOLS_LIST}[(conv_id + turn) % 4 + 1],
                                         'input', json_object('command', 'ls /repo/d' || (turn % 3))) END)::VARCHAR
                || chr(10) || chr(10) || 'event: ping' || chr(10) || 'data: {{}}' || chr(10) AS body
            FROM conversations WHERE role = 'assistant' AND turn % 3 = 1)))
    WHERE json_valid(data) AND data ->> '$.content_block.type' = 'tool_use'"""))
def r10_tools_from_sse(spark, sf):
    return SSE.tools_from_sse(SSE.sse_events(_tool_sse_bodies(spark, sf)))


# ---- F23 flat event fields, F12 prompt rows -------------------------------------------

@register("f23_flatten_events", W(["canon"], """
    SELECT timestamp, coalesce(source, 'unknown') AS source, coalesce(data ->> '$.comm', '') AS data_comm,
        coalesce(TRY_CAST(data ->> '$.pid' AS BIGINT), 0) AS data_pid, coalesce(TRY_CAST(data ->> '$.tid' AS BIGINT), 0) AS data_tid,
        CASE WHEN source = 'http_parser' THEN coalesce(data ->> '$.method', '') END AS method,
        CASE WHEN source = 'http_parser' THEN coalesce(data ->> '$.path', '') END AS path,
        CASE WHEN source = 'http_parser' THEN coalesce(data ->> '$.headers.host', '') END AS host,
        CASE WHEN source = 'http_parser' THEN coalesce(data ->> '$.status_code', '') END AS status_code,
        CASE WHEN source = 'http_parser' THEN coalesce(data ->> '$.message_type', '') END AS message_type,
        CASE WHEN source IN ('ssl', 'sse_processor') THEN coalesce(data ->> '$.function', '') END AS function,
        CASE WHEN source = 'ssl' THEN coalesce(TRY_CAST(data ->> '$.len' AS BIGINT), 0) END AS data_len,
        CASE WHEN source = 'ssl' THEN coalesce(TRY_CAST(data ->> '$.is_handshake' AS BOOLEAN), false) END AS is_handshake,
        CASE WHEN source = 'sse_processor' THEN coalesce(data ->> '$.connection_id', '') END AS connection_id
    FROM raw_env""", _F1_SQL[:1]))
def f23_flatten_events(spark, sf):
    return CN.flatten_events(_raw_envelopes(spark, sf))


@register("f12_prompt_rows")
def f12_prompt_rows(spark, sf):
    """one prompt row per LLM call whose request carries prompt text."""
    b = _llm_bodies(spark, sf)
    return (b.withColumn("prompt_text", CN.extract_prompt_text(F.col("request")))
            .where(F.col("prompt_text").isNotNull())
            .select(F.format_string("prompt-%d-%d", "conv_id", "turn").alias("id"), "conv_id", "turn",
                    "prompt_text", F.char_length("prompt_text").cast("bigint").alias("prompt_chars")))


def _f12_sql():
    x12 = ORACLES["x12_llm_body_fields"]
    return ("SELECT 'prompt-' || conv_id || '-' || turn AS id, conv_id, turn, prompt_text, "
            "CAST(length(prompt_text) AS BIGINT) AS prompt_chars FROM (" + x12 + ") WHERE prompt_text IS NOT NULL")


ORACLES["f12_prompt_rows"] = _f12_sql()
