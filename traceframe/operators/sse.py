"""Server-sent events — split response bodies into events and
reassemble streamed LLM messages.

R2 is stateless column work (runs on batch and stream rows alike). R3 keys
events by (pid, tid, message id from ``message_start``) with the id carried
forward by a two-level scan, stops a message at its first completing event
(``[DONE]``, a top-level ``usage``/``usageMetadata``, ``message_stop``,
``error``), and concatenates all deltas up to that point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import prev_value, running_last, running_sum
from ..session import stored

WINDOW_MS = 600_000  # key of events before any message_start: pid:tid:10-minute window


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


# One step through a chunked body: a size line with its data line, the last
# (zero) size with all that follows, or any other line.
_LINE = r"(?:(?!\r\n)[\s\S])*+"
_BLANK = r"(?:(?!\r\n)\s)*+"
_SIZE = rf"{_BLANK}0*+[1-9a-fA-F][0-9a-fA-F]*+{_BLANK}"
_STEP = rf"\G(?:{_SIZE}\r\n{_LINE}|{_BLANK}0++{_BLANK}(?=\r\n|$)[\s\S]*+|{_LINE})(?:\r\n|$)"


def clean_chunked(body: Column) -> Column:
    """Chunked transfer framing removed: a line that is a non-zero hex size
    is followed by one data line, which is kept; a zero size ends the body."""
    steps = F.regexp_extract_all(body, F.lit(_STEP), F.lit(0))
    data = F.filter(steps, lambda s: s.rlike(rf"^{_SIZE}\r\n"))
    return F.array_join(F.transform(data, lambda s: F.regexp_extract(s, rf"^{_SIZE}\r\n({_LINE})", 1)), "\n")


def sse_events(df: DataFrame, body_col: str = "body") -> DataFrame:
    """R2: one row per SSE event of each body (event, data, id, parsed flag)."""
    # Bodies, lines and fields stand behind generators: as plain columns each use would work them out again.
    body = F.col(body_col)
    clean = F.col("_clean")
    src = F.when(_strip(clean) == "", body).otherwise(clean)
    norm = F.regexp_replace(src, "\r\n", "\n")
    x = df.select("*", F.explode(F.array(clean_chunked(body))).alias("_clean"))
    x = x.select(*df.columns, F.posexplode(F.split(norm, "\n\n")).alias("block_no", "_block")) \
        .where(_strip(F.col("_block")) != "")
    kept = [c for c in df.columns if c != body_col]
    x = x.select(*kept, "block_no", F.explode(F.array(F.transform(F.split("_block", "\n"), _strip))).alias("_lines"))
    lines = F.col("_lines")

    def last_field(prefix):
        hits = F.filter(lines, lambda l: l.startswith(prefix))
        return F.when(F.size(hits) > 0, _strip(F.element_at(hits, -1).substr(F.lit(len(prefix) + 1), F.length(F.element_at(hits, -1)))))

    data_lines = F.transform(F.filter(lines, lambda l: l.startswith("data:")),
                             lambda l: _strip(l.substr(F.lit(6), F.length(l))))
    data = F.when(F.size(data_lines) > 0, F.array_join(data_lines, "\n"))
    fields = F.struct(last_field("event:").alias("event"), data.alias("data"), last_field("id:").alias("id"))
    x = x.select(*kept, "block_no", F.explode(F.array(fields)).alias("_f"))
    x = x.where(F.col("_f.event").isNotNull() | F.col("_f.data").isNotNull()).select(*kept, "block_no", "_f.*")
    return x.withColumn("is_json", F.expr("try_parse_json(data)").isNotNull())


def _delta_text(v: str) -> Column:
    """The text of a content delta (text or thinking), else null."""
    kind = F.expr(f"try_variant_get({v}, '$.delta.type', 'string')")
    return F.when(F.col("event") == "content_block_delta",
                  F.when(kind == "text_delta", F.expr(f"try_variant_get({v}, '$.delta.text', 'string')"))
                  .when(kind == "thinking_delta", F.expr(f"try_variant_get({v}, '$.delta.thinking', 'string')")))


def merge_sse_chunks(http: DataFrame, gap_ms: int = 5_000, bucket_ms: int = 3_600_000, scope: list[str] = ()) -> DataFrame:
    """The offline timeline of requests and responses, streamed chunks
    merged into the response they belong to.

    ``http``: seq, timestamp_ms, tid, type ('request' | 'response' |
    'sse_chunk'), content_type, body, and the ``scope`` columns; ``seq`` is
    unique in a scope. In time order of a scope, a chunk belongs to an event
    stream response while nothing but chunks of its thread lie between, each
    at most ``gap_ms`` after the one before; the next message, a chunk of
    another thread or a longer gap ends it, and chunks that follow belong to
    nothing. A response's own chunked body comes first. Output: every request
    and response with ``body`` (the merged text, unless empty), ``chunks``,
    ``end_ms`` of the last chunk, and ``is_json`` for merged text that is a
    JSON object.

    Islands come from a two-level lag and running count, so a scope is never
    one window; a message's deltas are one group. The timeline and its islands
    are stored once, as scans, deltas, ends and result all read them."""
    scope = list(scope)
    order, bucket = ["timestamp_ms", "seq"], F.expr(f"timestamp_ms div {int(bucket_ms)}")
    x = prev_value(stored(http).withColumn("_at", F.struct("timestamp_ms", "tid")), scope, bucket, order, "_at", "_prev")
    chunk = F.col("type") == "sse_chunk"
    follows = chunk & F.col("_prev.tid").eqNullSafe(F.col("tid")) & (F.col("timestamp_ms") - F.col("_prev.timestamp_ms") <= gap_ms)
    x = x.withColumn("_new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1).cast("bigint")).drop("_prev", "_at")
    x = stored(running_sum(x, scope, bucket, order, F.col("_new"), "_island").drop("_new"))
    key = [*scope, "_island"]
    stream = (F.col("type") == "response") & F.coalesce(F.col("content_type").contains("text/event-stream"), F.lit(False))
    # Of a response only chunked framing holds events; a chunk holds them as it is.
    raw = x.select(*key, "type", *order, "content_type", F.when(chunk, F.col("body")).when(stream, clean_chunked(F.coalesce("body", F.lit("")))).alias("_raw"))
    deltas = (sse_events(raw, "_raw").withColumn("_v", F.expr("try_parse_json(data)"))
              .select(*key, F.struct("timestamp_ms", "seq", "block_no").alias("p"), F.explode(F.array(_delta_text("_v"))).alias("t")).where("t is not null"))
    texts = deltas.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "t"))), lambda d: d["t"]), "").alias("_text"))
    ends = x.groupBy(*key).agg(F.count_if(chunk).alias("_chunks"), F.max("timestamp_ms").alias("_end"))
    y = (x.where(~chunk).join(ends, key, "left").join(texts, key, "left"))
    mine = stream & (F.col("_text") != "")
    return y.select(*scope, "seq", "timestamp_ms", "tid", "type", "content_type", F.when(mine, F.col("_text")).otherwise(F.col("body")).alias("body"),
                    F.when(stream, F.col("_chunks")).otherwise(F.lit(0)).cast("bigint").alias("chunks"),
                    F.when(stream, F.col("_end")).otherwise(F.col("timestamp_ms")).alias("end_ms"),
                    F.coalesce(mine & F.ltrim("_text").startswith("{") & F.expr("try_parse_json(_text)").isNotNull(), F.lit(False)).alias("is_json"))


def reassemble_sse(events: DataFrame, block_ms: int = 3_600_000) -> DataFrame:
    """Merged messages from SSE events (pid, tid, seq, timestamp_ms,
    block_no, event, data, is_json). One row per message with its text,
    event count, completion flag and usage; metadata-only messages dropped."""
    v = F.expr("try_parse_json(data)")
    e = events.withColumn("_v", v)
    msg_id = F.when(F.col("event") == "message_start",
                    F.expr("try_variant_get(_v, '$.message.id', 'string')"))
    delta_type = F.expr("try_variant_get(_v, '$.delta.type', 'string')")
    text = (F.when((F.col("event") == "content_block_delta") & (delta_type == "text_delta"),
                   F.expr("try_variant_get(_v, '$.delta.text', 'string')"))
            .when((F.col("event") == "content_block_delta") & (delta_type == "thinking_delta"),
                  F.expr("try_variant_get(_v, '$.delta.thinking', 'string')")))
    completes = ((F.col("data") == "[DONE]")
                 | F.expr("try_variant_get(_v, '$.usage') IS NOT NULL OR try_variant_get(_v, '$.usageMetadata') IS NOT NULL")
                 | F.col("event").isin("message_stop", "error"))
    e = e.select("pid", "tid", "seq", "timestamp_ms", "block_no", "event", msg_id.alias("_mid"),
                 F.coalesce(text, F.lit("")).alias("_text"), F.coalesce(completes, F.lit(False)).alias("_done"),
                 F.expr("try_variant_get(_v, '$.message.usage.input_tokens', 'bigint')").alias("_in"),
                 F.expr("try_variant_get(_v, '$.usage.output_tokens', 'bigint')").alias("_out"),
                 F.expr("try_variant_get(_v, '$.message.model', 'string')").alias("_model"))
    bucket = F.expr(f"timestamp_ms div {block_ms}")
    e = stored(e)  # both levels of the scan and the ends read the parsed events
    e = running_last(e, ["pid", "tid"], bucket, ["seq", "block_no"], F.col("_mid"), "_carried")
    key = F.coalesce(F.col("_carried"), F.format_string("w%d", F.expr(f"timestamp_ms div {WINDOW_MS}")))
    e = e.withColumn("message_key", key)
    pos = F.struct("seq", "block_no")
    ends = (e.where("_done").groupBy("pid", "tid", "message_key").agg(F.min(pos).alias("_end")))
    e = e.join(ends, ["pid", "tid", "message_key"], "left")
    e = e.where(F.col("_end").isNull() | (pos <= F.col("_end")))
    out = e.groupBy("pid", "tid", "message_key").agg(
        F.min("seq").alias("first_seq"),
        F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"),
        F.count(F.lit(1)).alias("events"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("p"), F.col("_text").alias("t")))),
                                 lambda s: s["t"]), "").alias("text"),
        F.max(F.col("_end").isNotNull()).alias("complete"),
        F.max("_in").alias("input_tokens"), F.max("_out").alias("output_tokens"),
        F.max("_model").alias("model"))
    return (out.withColumn("text_len", F.length("text").cast("bigint"))
            .where((F.col("text") != "") | F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull()))


def tools_from_sse(events: DataFrame, call_col: str = "seq") -> DataFrame:
    """One tool-call row per SSE event whose ``content_block`` is a
    ``tool_use`` (name, id, input as JSON text); the id defaults to
    ``tool-{block_no}`` and the row id is ``tool-{call}-{tool id}``."""
    v = F.expr("try_parse_json(data)")
    x = events.withColumn("_v", v).where(
        F.expr("try_variant_get(_v, '$.content_block.type', 'string')") == "tool_use")
    tool_id = F.coalesce(F.expr("try_variant_get(_v, '$.content_block.id', 'string')"),
                         F.format_string("tool-%d", "block_no"))
    return x.select(
        F.format_string("tool-%s-%s", F.col(call_col).cast("string"), tool_id).alias("id"),
        F.col(call_col).alias("llm_call"), "timestamp_ms", "pid",
        F.coalesce(F.expr("try_variant_get(_v, '$.content_block.name', 'string')"), F.lit("?")).alias("tool_name"),
        F.expr("try_variant_get(_v, '$.content_block.id', 'string')").alias("tool_call_id"),
        F.expr("to_json(try_variant_get(_v, '$.content_block.input'))").alias("input"),
        F.lit("observed").alias("status"))
