"""HTTP traffic: message parsing, pairing, spans, filters and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import exact_quantiles, prev_value

CRLF = "\r\n"

# handshake/protocol-overhead path patterns (case-insensitive),
# overhead methods and empty-body statuses.
OVERHEAD_PATH_PATTERNS = [r"\.well-known", "/handshake", "/negotiate", "/connect", "/ping",
                          "/health", "/status", "/version"]
OVERHEAD_METHODS = ["OPTIONS", "HEAD"]
EMPTY_STATUSES = [204, 304]


def normalize_path(path: Column) -> Column:
    """Drop the query, then UUIDs, numeric ids and hex hashes become
    placeholders, in this order (placeholders are the literal texts below)."""
    p = F.substring_index(path, "?", 1)
    p = F.regexp_replace(p, r"/[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}", "/{{uuid}}")
    p = F.regexp_replace(p, r"/[0-9]+", "/{{id}}")
    p = F.regexp_replace(p, r"/[a-f0-9]{24,}", "/{{hash}}")
    return p


def parse_http(payloads: DataFrame, text_col: str = "payload") -> DataFrame:
    """HTTP/1 message from a TLS payload: first line, lower-cased header
    map and body. Stateless column expressions, so the same job runs on a
    batch table or a stream."""
    t = F.col(text_col)
    sep = F.instr(t, CRLF + CRLF)
    head = F.when(sep > 0, F.expr(f"substring({text_col}, 1, instr({text_col}, '\\r\\n\\r\\n') - 1)")).otherwise(t)
    body = F.when(sep > 0, F.expr(f"substring({text_col}, instr({text_col}, '\\r\\n\\r\\n') + 4)")).otherwise(F.lit(""))
    df = payloads.withColumn("_head", head).withColumn("body", body)
    lines = F.split(F.col("_head"), CRLF)
    first = F.element_at(lines, 1)
    parts = F.split(first, " ", 3)
    is_resp = first.startswith("HTTP/")
    hdr_lines = F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda l: F.instr(l, ":") > 0)
    headers = F.map_from_entries(F.transform(hdr_lines, lambda l: F.struct(
        F.lower(F.trim(F.substring_index(l, ":", 1))).alias("k"),
        F.trim(F.regexp_extract(l, r"^[^:]*:(.*)$", 1)).alias("v"))))
    return df.select(
        *[c for c in payloads.columns if c != text_col],
        F.when(is_resp, "response").otherwise("request").alias("message_type"),
        first.alias("first_line"),
        F.when(~is_resp, F.element_at(parts, 1)).alias("method"),
        F.when(~is_resp, F.element_at(parts, 2)).alias("path"),
        F.when(is_resp, F.element_at(parts, 1)).otherwise(F.element_at(parts, 3)).alias("protocol"),
        F.when(is_resp, F.expr("try_cast(element_at(split(split(_head, '\\r\\n')[0], ' ', 3), 2) as int)"))
         .alias("status_code"),
        F.when(is_resp, F.element_at(parts, 3)).alias("status_text"),
        headers.alias("headers"),
        "body",
    )


def strip_auth_headers(http: DataFrame, names=None) -> DataFrame:
    """drop authentication headers (any case) from the header map."""
    # Header names treated as credentials.
    names = names or ["authorization", "x-api-key", "x-auth-token", "bearer", "token",
                      "x-access-token", "x-session-token", "cookie", "set-cookie"]
    arr = F.array(*[F.lit(n) for n in names])
    return http.withColumn("headers", F.map_filter("headers", lambda k, v: ~F.array_contains(arr, F.lower(k))))


def drop_overhead(http: DataFrame) -> DataFrame:
    """drop handshake paths, OPTIONS/HEAD and empty 204/304 responses."""
    pat = "(?i)(" + "|".join(OVERHEAD_PATH_PATTERNS) + ")"
    path = F.coalesce(F.col("path"), F.lit(""))
    overhead = (path.rlike(pat)
                | F.coalesce(F.col("method"), F.lit("")).isin(*OVERHEAD_METHODS)
                | ((F.col("message_type") == "response")
                   & (F.coalesce(F.col("body"), F.lit("")) == "")
                   & F.coalesce(F.col("status_code"), F.lit(200)).isin(*EMPTY_STATUSES)))
    return http.where(F.col("message_type").isin("request", "response") & ~overhead)


def simple_timeline(http: DataFrame) -> DataFrame:
    """one text line per message."""
    req = F.format_string("%s %s %s host: %s", F.coalesce("method", F.lit("UNKNOWN")),
                          F.coalesce("path", F.lit("/")), F.coalesce("protocol", F.lit("HTTP/1.1")),
                          F.coalesce("host", F.lit("unknown-host")))
    resp = F.format_string("HTTP/1.1 %s %s content-type: %s", F.coalesce(F.col("status_code").cast("string"), F.lit("0")),
                           F.coalesce("status_text", F.lit("")), F.coalesce("content_type", F.lit("unknown")))
    return http.select("seq", "timestamp_ms",
                       F.when(F.col("message_type") == "request", req).otherwise(resp).alias("line"))


def pair_by_tid(http: DataFrame, bucket_ms: int = 600_000) -> DataFrame:
    """A response pairs with the request right before it on the same tid
    (the last request wins; a response consumes it). Output one row per
    paired response with request fields prefixed ``req_``. The row before comes
    from a two-level lag, so a busy thread is no single window; messages
    without a thread pair with nothing."""
    before = ["message_type", "seq", "timestamp_ms", "method", "path", "host"]
    x = http.where("tid is not null").select("tid", "status_code", "content_type", *before, F.struct(*before).alias("_now"))
    x = prev_value(x, ["tid"], F.expr(f"timestamp_ms div {int(bucket_ms)}"), ["timestamp_ms", "seq"], "_now", "_p")
    x = x.select("*", *[F.col(f"_p.{c}").alias(f"_p_{c}") for c in before])
    paired = x.where((F.col("message_type") == "response") & (F.col("_p_message_type") == "request"))
    return paired.select(
        "tid", F.col("_p_seq").alias("req_seq"), F.col("seq").alias("resp_seq"),
        F.col("_p_timestamp_ms").alias("req_ts"), F.col("timestamp_ms").alias("resp_ts"),
        F.col("_p_method").alias("method"), F.col("_p_path").alias("path"),
        F.col("_p_host").alias("host"), "status_code", "content_type",
        (F.col("timestamp_ms") - F.col("_p_timestamp_ms")).alias("duration_ms"))


def http_spans(http: DataFrame) -> DataFrame:
    """One span per request (duration from its paired response) plus
    orphan responses as parentless spans."""
    pairs = pair_by_tid(http)
    req = http.where(F.col("message_type") == "request")
    p = pairs.select("req_seq", "resp_seq", "duration_ms", F.col("status_code").alias("_sc"))
    spans = (req.join(p, req["seq"] == p["req_seq"], "left")
             .select(F.format_string("req-%d", "seq").alias("span_id"),
                     F.lit(None).cast("string").alias("parent_id"),
                     "tid", F.col("timestamp_ms").alias("start_ms"), "duration_ms",
                     F.col("_sc").alias("status_code"),
                     F.format_string("%s %s", "method", "path").alias("name")))
    resp = http.where(F.col("message_type") == "response")
    orphans = (resp.join(pairs.select("resp_seq"), resp["seq"] == pairs["resp_seq"], "left_anti")
               .select(F.format_string("resp-%d", "seq").alias("span_id"),
                       F.lit(None).cast("string").alias("parent_id"),
                       "tid", F.col("timestamp_ms").alias("start_ms"),
                       F.lit(None).cast("bigint").alias("duration_ms"), "status_code",
                       F.lit("orphan response").alias("name")))
    children = (pairs.select(F.format_string("resp-%d", "resp_seq").alias("span_id"),
                             F.format_string("req-%d", "req_seq").alias("parent_id"), "tid",
                             F.col("resp_ts").alias("start_ms"), F.lit(0).cast("bigint").alias("duration_ms"),
                             "status_code", F.lit("response").alias("name")))
    return spans.unionByName(children).unionByName(orphans)


def last_per_tid(http: DataFrame) -> DataFrame:
    """Per-tid variant of pairing: last request and last response of each
    non-zero tid (``max_by`` aggregates, partial before the shuffle)."""
    h = http.where(F.col("tid").isNotNull() & (F.col("tid") != 0))
    cols = ["seq", "timestamp_ms", "method", "path", "host", "status_code", "content_type", "body"]
    req = (h.where(F.col("message_type") == "request").groupBy("tid")
           .agg(F.max_by(F.struct(*cols), "seq").alias("req")))
    resp = (h.where(F.col("message_type") == "response").groupBy("tid")
            .agg(F.max_by(F.struct(*cols), "seq").alias("resp")))
    return req.join(resp, "tid", "left")


def response_metrics(http: DataFrame) -> DataFrame:
    """Latency mean/median/min/max/stddev/p95/p99 (linear interpolation),
    response sizes and counts over the per-tid pairs."""
    p = last_per_tid(http)
    lat = F.when(F.col("resp.timestamp_ms") > F.col("req.timestamp_ms"),
                 F.col("resp.timestamp_ms") - F.col("req.timestamp_ms")).cast("double")
    p = p.withColumn("latency_ms", lat).withColumn("size", F.length("resp.body"))
    row = p.agg(
        F.count("latency_ms").alias("samples"),
        F.round(F.avg("latency_ms"), 4).alias("mean_ms"),
        F.min("latency_ms").alias("min_ms"),
        F.max("latency_ms").alias("max_ms"),
        F.round(F.stddev_samp("latency_ms"), 4).alias("stddev_ms"),
        F.round(F.avg("size"), 4).alias("avg_size"),
        F.count_if(F.col("resp.seq").isNotNull()).alias("responses"))
    ranks = exact_quantiles(p, "latency_ms", {"median_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}, 1_000)
    both = row.unionByName(ranks, allowMissingColumns=True)  # two one-row frames folded
    cols = ["samples", "mean_ms", "median_ms", "min_ms", "max_ms", "stddev_ms", "p95_ms", "p99_ms", "avg_size", "responses"]
    return both.agg(*[F.max(c).alias(c) for c in cols]).select(
        *[F.round(c, 4).alias(c) if c in ("median_ms", "p95_ms", "p99_ms") else F.col(c) for c in cols])


def top_values(df: DataFrame, category: str, value: Column, n: int | None, order_col: str = "seq") -> DataFrame:
    """Counter-style top values: count desc, then first occurrence."""
    g = (df.select(value.alias("value"), F.col(order_col)).groupBy("value")
         .agg(F.count(F.lit(1)).alias("count"), F.min(order_col).alias("_first")))
    g = g.withColumn("category", F.lit(category))
    if n is not None:
        w = Window.partitionBy("category").orderBy(F.col("count").desc(), F.col("_first").asc())
        g = g.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
    return g.withColumnRenamed("_first", "first_seq")


def communication_patterns(http: DataFrame) -> DataFrame:
    """Request methods (top 10), protocols, normalised paths (top 20),
    response content types (top 10), the number of event-stream responses
    (category ``sse_responses``) and the numbers of different methods, paths
    and content types (category ``unique``)."""
    req = http.where(F.col("message_type") == "request")
    resp = http.where(F.col("message_type") == "response")
    return (top_values(req, "request_method", F.coalesce("method", F.lit("unknown")), 10)
            .unionByName(top_values(req, "protocol", F.coalesce("protocol", F.lit("unknown")), None))
            .unionByName(top_values(req, "path", normalize_path(F.coalesce("path", F.lit("unknown"))), 20))
            .unionByName(top_values(resp, "response_content_type",
                                    F.coalesce("content_type", F.lit("unknown")), 10))
            .unionByName(_pattern_counts(req, resp)))


def _pattern_counts(req: DataFrame, resp: DataFrame) -> DataFrame:
    """One-row counts of A20 in the columns of ``top_values``."""
    asked = req.agg(F.count_distinct(F.coalesce("method", F.lit("unknown"))).alias("methods"),
                    F.count_distinct(normalize_path(F.coalesce("path", F.lit("unknown")))).alias("paths"))
    told = resp.agg(F.count_distinct(F.coalesce("content_type", F.lit("unknown"))).alias("content_types"),
                    F.count_if(F.coalesce(F.col("content_type").contains("text/event-stream"), F.lit(False))).alias("sse"))
    none = F.lit(None).cast("bigint").alias("first_seq")
    out = None
    for frame, category, name, column in ((asked, "unique", "methods", "methods"), (asked, "unique", "paths", "paths"),
                                          (told, "unique", "content_types", "content_types"), (told, "sse_responses", "text/event-stream", "sse")):
        part = frame.select(F.lit(name).alias("value"), F.col(column).alias("count"), none, F.lit(category).alias("category"))
        out = part if out is None else out.unionByName(part)
    return out


def content_stats(http: DataFrame) -> DataFrame:
    """Body, JSON, form, HTML and SSE counts and total sizes."""
    b = F.coalesce(F.col("body"), F.lit(""))
    has = b != ""
    req = F.col("message_type") == "request"
    resp = F.col("message_type") == "response"
    ct = F.coalesce(F.col("content_type"), F.lit(""))
    is_json = F.ltrim(b).startswith("{") | F.ltrim(b).startswith("[")
    return http.agg(
        F.count_if(req & has).alias("requests_with_body"),
        F.count_if(req & has & is_json).alias("json_requests"),
        F.count_if(req & has & ct.contains("application/x-www-form-urlencoded")).alias("form_requests"),
        F.coalesce(F.sum(F.when(req & has, F.length(b))), F.lit(0)).cast("bigint").alias("total_request_size"),
        F.count_if(resp & has).alias("responses_with_body"),
        F.count_if(resp & has & is_json).alias("json_responses"),
        F.count_if(resp & has & ct.contains("text/html")).alias("html_responses"),
        F.count_if(resp & has & ~ct.contains("text/html") & ct.contains("text/event-stream")).alias("sse_responses"),
        F.coalesce(F.sum(F.when(resp & has, F.length(b))), F.lit(0)).cast("bigint").alias("total_response_size"))


def endpoint_patterns(http: DataFrame, n: int = 15) -> DataFrame:
    """Per normalised request path over per-tid pairs: count, methods,
    status codes, avg/max/min latency, hosts; top ``n`` by count."""
    p = last_per_tid(http)
    lat = F.when(F.col("resp.timestamp_ms") > F.col("req.timestamp_ms"),
                 F.col("resp.timestamp_ms") - F.col("req.timestamp_ms"))
    g = (p.withColumn("endpoint", normalize_path(F.coalesce("req.path", F.lit("unknown"))))
         .groupBy("endpoint")
         .agg(F.count(F.lit(1)).alias("request_count"),
              F.array_join(F.array_sort(F.collect_set("req.method")), ",").alias("methods"),
              F.array_join(F.array_sort(F.collect_set(F.col("resp.status_code").cast("string"))), ",")
               .alias("status_codes"),
              F.round(F.avg(lat), 4).alias("avg_latency_ms"),
              F.max(lat).alias("max_latency_ms"), F.min(lat).alias("min_latency_ms"),
              F.count_distinct("req.host").alias("hosts")))
    return g.orderBy(F.col("request_count").desc(), F.col("endpoint").asc()).limit(n)


def timeline_summary(http: DataFrame) -> DataFrame:
    """Message counts, bytes, body-sniffed types, duration and rate."""
    b = F.coalesce(F.col("body"), F.lit(""))
    sniff = (F.when(F.ltrim(b).startswith("{") | F.ltrim(b).startswith("["), "json")
             .when(F.lower(F.ltrim(b)).startswith("<!doctype html") | F.lower(b).contains("<html"), "html")
             .when(b.startswith("data:") | b.startswith("event:"), "sse")
             .when(b == "", "empty").otherwise("text"))
    s = http.withColumn("_t", sniff).agg(
        F.count(F.lit(1)).alias("messages"),
        F.coalesce(F.sum(F.length(b)), F.lit(0)).cast("bigint").alias("total_bytes"),
        F.count_if(F.col("_t") == "json").alias("json_bodies"),
        F.count_if(F.col("_t") == "html").alias("html_bodies"),
        F.count_if(F.col("_t") == "sse").alias("sse_bodies"),
        F.count_if(F.col("_t") == "text").alias("text_bodies"),
        F.count_if(F.col("_t") == "empty").alias("empty_bodies"),
        (F.max("timestamp_ms") - F.min("timestamp_ms")).alias("duration_ms"))
    return s.withColumn("bytes_per_second", F.round(
        F.when(F.col("duration_ms") > 0, F.col("total_bytes") / (F.col("duration_ms") / 1000)), 4))


# Response header classes.
CACHE_HEADERS = ["cache-control", "expires", "etag"]
SECURITY_HEADERS = ["strict-transport-security", "content-security-policy", "x-frame-options",
                    "x-content-type-options", "x-xss-protection", "referrer-policy"]


def _top(df: DataFrame, category, value: Column, n: int | None) -> DataFrame:
    """Counter.most_common over (value): count desc, then first occurrence."""
    cat = category if isinstance(category, Column) else F.lit(category)
    g = (df.select(cat.alias("category"), value.cast("string").alias("value"), "_ord")
         .where(F.col("value").isNotNull())
         .groupBy("category", "value").agg(F.count(F.lit(1)).alias("count"), F.min("_ord").alias("_first")))
    if n is not None:
        w = Window.partitionBy("category").orderBy(F.col("count").desc(), F.col("_first").asc())
        g = g.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
    return g.drop("_first")


def header_stats(parsed: DataFrame, message_type: str = "request") -> DataFrame:
    """Header frequency, per-header value distribution (top 10)
    and the special header classes, as (category, value, count) rows.

    ``parsed``: R1 output (seq, message_type, method, path, status_code,
    headers map). Headers are exploded once; every statistic is a grouped
    count with a top-n per category (partial group limit)."""
    msgs = parsed.where(F.col("message_type") == message_type)
    hdr = msgs.select("seq", F.posexplode(F.map_entries("headers")).alias("pos", "e")) \
        .select("seq", "pos", F.col("e.key").alias("name"), F.col("e.value").alias("value"))
    hdr = hdr.withColumn("_ord", F.struct("seq", "pos"))
    m = msgs.withColumn("_ord", F.struct("seq", F.lit(-1).alias("pos")))
    parts = [_top(hdr, "header", F.col("name"), 20),
             _top(hdr, F.concat(F.lit("header_value:"), F.col("name")), F.col("value"), 10)]
    if message_type == "request":
        parts += [
            _top(m, "method", F.coalesce("method", F.lit("UNKNOWN")), 10),
            _top(m, "url_path", F.coalesce("path", F.lit("/")), 20),
            _top(hdr.where(F.col("name") == "host"), "host", F.col("value"), 10),
            _top(hdr.where(F.col("name") == "user-agent"), "user_agent", F.col("value"), 10),
            _top(hdr.where(F.col("name") == "content-type"), "content_type", F.col("value"), 10),
            _top(hdr.where(F.col("name") == "authorization"), "authorization_type",
                 F.when(F.col("value").contains(" "), F.substring_index("value", " ", 1)).otherwise(F.col("value")), 10),
        ]
    else:
        parts += [
            _top(m, "status_code", F.col("status_code"), 10),
            _top(hdr.where(F.col("name") == "content-type"), "content_type", F.col("value"), 10),
            _top(hdr.where(F.col("name").isin(*CACHE_HEADERS)), "cache_header",
                 F.concat(F.col("name"), F.lit(": "), F.col("value")), 10),
            _top(hdr.where(F.col("name").isin(*SECURITY_HEADERS)), "security_header", F.col("name"), None),
            _top(hdr.where(F.col("name") == "server"), "server", F.col("value"), 10),
            _top(hdr.where(F.col("name") == "content-encoding"), "encoding", F.col("value"), 10),
        ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def content_length_stats(parsed: DataFrame) -> DataFrame:
    """count/min/max/mean/total of integer content-length headers."""
    cl = F.expr("try_cast(element_at(headers, 'content-length') as bigint)")
    r = parsed.where(F.col("message_type") == "response").select(cl.alias("cl")).where(F.col("cl").isNotNull())
    return r.agg(F.count(F.lit(1)).alias("count"), F.min("cl").alias("min"), F.max("cl").alias("max"),
                 F.round(F.avg("cl"), 4).alias("mean"), F.sum("cl").alias("total"))


# Request paths that count as data transfer (case-insensitive).
DATA_ENDPOINTS = ["/api/", "/v1/", "/v2/", "/chat", "/completion", "/generate", "/query", "/search",
                  "/upload", "/download"]


def data_timeline(http: DataFrame) -> DataFrame:
    """data-transfer messages only (requests with a body or on a data
    endpoint, responses with a body or an event stream), without headers,
    in time order."""
    body = F.coalesce(F.col("body"), F.lit(""))
    pat = "(?i)(" + "|".join(DATA_ENDPOINTS) + ")"
    keep = (((F.col("message_type") == "request") & ((body != "") | F.coalesce(F.col("path"), F.lit("")).rlike(pat)))
            | ((F.col("message_type") == "response")
               & ((body != "") | F.coalesce(F.col("content_type"), F.lit("")).contains("text/event-stream"))))
    return (http.where(keep)
            .select("seq", "timestamp_ms", "message_type", "method", "path", "status_code", "content_type",
                    F.length(body).cast("bigint").alias("body_size"))
            .orderBy("timestamp_ms", "seq"))


def traffic_report(http: DataFrame) -> DataFrame:
    """One row combining request/response counts, latency metrics
    and content statistics (A21) — one-row frames folded without joins."""
    counts = http.agg(F.count_if(F.col("message_type") == "request").alias("total_requests"),
                      F.count_if(F.col("message_type") == "response").alias("total_responses"),
                      F.count_distinct("host").alias("hosts"))
    parts = [counts, response_metrics(http), content_stats(http)]
    row = parts[0]
    for p in parts[1:]:
        row = row.unionByName(p, allowMissingColumns=True)
    return row.agg(*[F.max(c).alias(c) for c in row.columns])
