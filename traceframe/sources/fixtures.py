"""Event-shaped tables derived from the driver tables.

The driver ships TPC-H-like tables plus ``events``, ``pages`` and
``conversations``; trace analysis needs raw events, token rows, LLM calls,
process/file/network events, samples, session logs and HTTP messages. Each
function below derives one such table with plain column expressions, so the
derivation scales with the input and fuses into the scan stage.

Every Spark derivation has a twin DuckDB CTE in ``SQL`` (same columns, same
values) used by the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# Fixed values of the mapping (FIXTURES.md §2): command names by pid % 5,
# token sources by k % 6 (the reference's six priorities, best first),
# providers by k % 3.
COMMS = ["claude", "codex", "gemini", "node", "python"]
TOKEN_SOURCES = ["response_usage", "orphan_response_usage", "gemini_cli_stdout_stats",
                 "claude_telemetry", "agent_native_session", "session_log"]
PROVIDERS = ["anthropic", "openai", "google"]


def _arr(values: list[str]):
    return F.array(*[F.lit(v) for v in values])


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("seq"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"),
        F.col("user_id").alias("pid"),
        F.col("user_id").alias("tid"),
        F.expr("user_id div 2").alias("ppid"),
        F.element_at(_arr(COMMS), (F.col("user_id") % 5 + 1).cast("int")).alias("comm"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_events(spark, sf_dir)
    src = F.element_at(_arr(TOKEN_SOURCES), (F.col("k") % 6 + 1).cast("int"))
    inp = F.floor(F.col("value") * 10).cast("bigint")
    cc = F.col("k") % 7
    cr = (F.col("k") % 3) * 10
    call = F.when(F.col("k") % 6 == 4,
                  F.format_string("call-%d-%d", F.expr("seq div 30"), F.col("seq") % 30)) \
        .otherwise(F.format_string("call-%d", F.expr("seq div 3")))
    return raw.select(
        F.format_string("token-%d", "seq").alias("id"),
        call.alias("llm_call_id"),
        "seq", "timestamp_ms", "pid", "comm",
        F.element_at(_arr(PROVIDERS), (F.col("k") % 3 + 1).cast("int")).alias("provider"),
        F.when(F.col("k") % 11 == 0, F.lit(None).cast("string"))
         .otherwise(F.format_string("model-%d", F.col("k") % 5)).alias("model"),
        inp.alias("input_tokens"),
        F.col("k").alias("output_tokens"),
        cc.alias("cache_creation_tokens"),
        cr.alias("cache_read_tokens"),
        (inp + F.col("k") + cc + cr).alias("total_tokens"),
        src.alias("source"),
        F.lit("view").alias("view_source"),
        ((F.col("k") % 10) / 10).alias("confidence"),
    )


def llm_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_events(spark, sf_dir).where(F.col("event_type") == "purchase")
    code = F.when(F.col("k") % 17 == 0, 500).when(F.col("k") % 13 == 0, 429).otherwise(200)
    return raw.select(
        F.format_string("call-%d", F.expr("seq div 3")).alias("id"),
        "seq",
        F.format_string("s-%d", "pid").alias("session_id"),
        F.col("timestamp_ms").alias("start_timestamp_ms"),
        (F.col("timestamp_ms") + F.col("k") * 10).alias("end_timestamp_ms"),
        "pid", "comm",
        F.element_at(_arr(PROVIDERS), (F.col("k") % 3 + 1).cast("int")).alias("provider"),
        F.format_string("model-%d", F.col("k") % 5).alias("model"),
        F.when(code >= 400, "error").otherwise("complete").alias("status"),
        code.cast("int").alias("status_code"),
        F.format_string("h%d.example.com", F.col("k") % 20).alias("host"),
        F.lit("/v1/messages").alias("path"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent sessions: one per user (``s-{pid}``) and one per conversation
    (``call-{conv_id}``, agent-native ids that token rows reach by prefix)."""
    raw = raw_events(spark, sf_dir)
    users = raw.groupBy("pid").agg(F.min("timestamp_ms").alias("start_timestamp_ms"),
                                   F.max("timestamp_ms").alias("end_timestamp_ms")).select(
        F.format_string("s-%d", "pid").alias("id"),
        F.lit("agent").alias("agent_type"),
        "start_timestamp_ms", "end_timestamp_ms",
        F.format_string("/repo/u%d", F.col("pid") % 7).alias("cwd"))
    conv = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.min("turn").alias("t0"), F.max("turn").alias("t1")).select(
        F.format_string("call-%d", "conv_id").alias("id"),
        F.lit("agent_native").alias("agent_type"),
        (F.col("conv_id") * 3600000 + F.col("t0") * 60000).alias("start_timestamp_ms"),
        (F.col("conv_id") * 3600000 + F.col("t1") * 60000).alias("end_timestamp_ms"),
        F.when(F.col("conv_id") % 4 == 3, F.lit(""))
         .otherwise(F.format_string("/work/c%d", F.col("conv_id") % 5)).alias("cwd"))
    return users.unionByName(conv)


def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process, file and network events in one canonical shape.

    signup → EXEC, error → EXIT (exit_code = k % 3), view → FILE_OPEN,
    click → NET_CONNECT, purchase → an LLM request on the network.
    """
    raw = raw_events(spark, sf_dir)
    et = F.col("event_type")
    k = F.col("k")
    event = (F.when(et == "signup", "EXEC").when(et == "error", "EXIT")
             .when(et == "view", "FILE_OPEN").when(et == "click", "NET_CONNECT")
             .otherwise("LLM_REQUEST"))
    kind = (F.when(et.isin("signup", "error"), "process").when(et == "view", "file")
            .when(et == "click", "network").otherwise("llm"))
    path = (F.when(et == "view", F.when(k % 25 == 0, F.lit("/etc/passwd"))
                   .otherwise(F.format_string("/repo/d%d/f%d.py", k % 10, k)))
            .when(et == "click", F.format_string("/api/v%d", k % 3))
            .when(et == "purchase", F.lit("/v1/messages")))
    host = (F.when(et == "click", F.format_string("h%d.example.com", k % 20))
            .when(et == "purchase", F.format_string("api%d.example.com", k % 3)))
    status = (F.when(et == "click", F.when(k % 17 == 0, 500).otherwise(200))
              .when(et == "purchase", F.when(k % 17 == 0, 500).when(k % 13 == 0, 429).otherwise(200)))
    return raw.select(
        "seq", "timestamp_ms", "pid", "tid", "ppid", "comm", "k", "value",
        kind.alias("kind"), event.alias("event"),
        F.when(et == "error", k % 3).alias("exit_code"),
        F.when(et == "signup", F.concat(F.lit("/usr/bin/"), F.col("comm"))).alias("filename"),
        F.when(et == "signup", F.format_string("/repo/u%d", F.col("pid") % 7)).alias("cwd"),
        path.alias("path"),
        F.when(et == "view", k % 4).alias("flags"),
        host.alias("host"),
        status.cast("int").alias("status_code"),
    )


def fleet_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical events as those of two runs on two machines each, whose
    pids overlap."""
    return canonical_events(spark, sf_dir).select(
        F.format_string("run-%d", F.col("seq") % 2).alias("run_id"), F.format_string("m-%d", F.col("k") % 2).alias("machine"), "*")


def resource_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_events(spark, sf_dir)
    return raw.select("seq", "timestamp_ms", "pid", "comm",
                      F.col("value").alias("cpu_percent"),
                      (F.col("k") * 10).alias("rss_mb"))


def proc_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic /proc-style snapshots: cumulative counters per process.

    Cumulative ticks/io are running sums over (pid order by time, seq); this is
    the one fixture that needs a window (partitioned by pid, so it scales).
    """
    from pyspark.sql import Window
    raw = raw_events(spark, sf_dir)
    w = Window.partitionBy("pid").orderBy("timestamp_ms", "seq").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return raw.select(
        "seq",
        F.col("timestamp_ms").alias("sample_ts"),
        "pid",
        (F.col("pid") * 100).alias("starttime_ticks"),
        "ppid", "comm",
        F.concat(F.lit("/usr/bin/"), F.col("comm")).alias("command"),
        F.format_string("/repo/u%d", F.col("pid") % 7).alias("cwd"),
        F.sum("k").over(w).alias("ticks"),
        (F.col("k") * 1024).alias("rss_kb"),
        (F.col("k") * 1024 * 5 + F.col("pid")).alias("vsz_kb"),
        F.sum(F.col("k") * 100).over(w).alias("read_bytes"),
        F.sum((F.col("k") % 7) * 1000).over(w).alias("write_bytes"),
        F.col("value").alias("cpu_percent"),
        ((F.col("timestamp_ms") - 1704067200000) / 1000 + 1000).alias("uptime_s"),
    )


def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent transcript rows: user → prompt, assistant → llm response."""
    conv = read_table(spark, sf_dir, "conversations")
    kind = (F.when(F.col("role") == "user", "prompt")
            .when(F.col("role") == "assistant", "llm").otherwise("system"))
    return conv.select(
        F.format_string("c-%d", "conv_id").alias("session_id"),
        "conv_id",
        F.col("turn").alias("position"),
        "role",
        kind.alias("kind"),
        "text",
        (F.col("conv_id") * 3600000 + F.col("turn") * 60000
         + F.char_length("text") % 30000).alias("timestamp_ms"),
        F.substring(F.sha2("text", 256), 1, 12).alias("text_hash"),
    )


def llm_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LLM request/response events for pairing: every purchase is a request
    on thread (user div 15, user % 2); most get a response k*5 s later
    (beyond the 5-minute TTL when k > 60), some carry request ids, some
    requests have neither body nor model (rejected)."""
    raw = raw_events(spark, sf_dir).where(F.col("event_type") == "purchase")
    k = F.col("k")
    base = raw.select(
        "seq", "timestamp_ms", F.expr("pid div 15").alias("pid"), (F.col("pid") % 2).alias("tid"), "k",
        F.when(k % 4 == 0, F.format_string("req-%d", "seq")).alias("request_id"),
        F.when(k % 9 == 0, F.lit(None).cast("string")).otherwise(F.format_string("model-%d", k % 5)).alias("model"),
        ((k % 9 != 0) | (k % 2 == 0)).alias("has_body"))
    req = base.select((F.col("seq") * 2).alias("seq"), "timestamp_ms", "pid", "tid",
                      F.lit("request").alias("kind"), "request_id", "model", "has_body",
                      F.lit(None).cast("int").alias("status_code"))
    resp = base.where(k % 7 != 0).select(
        (F.col("seq") * 2 + 1).alias("seq"), (F.col("timestamp_ms") + k * 5000).alias("timestamp_ms"),
        "pid", "tid", F.lit("response").alias("kind"), "request_id",
        F.lit(None).cast("string").alias("model"), F.lit(True).alias("has_body"),
        F.when(k % 17 == 0, 500).when(k % 13 == 0, 429).otherwise(200).cast("int").alias("status_code"))
    return req.unionByName(resp)


# Fixed values of the call fixture: API hosts and paths by seq.
API_HOSTS = ["api.anthropic.com", "api.openai.com", "generativelanguage.googleapis.com", "h.example.com"]
API_PATHS = ["/v1/messages", "/v1/responses", "/v1/chat/completions", "/v1beta/models/g:generateContent", "/other"]


def llm_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The LLM events with comm, provider, host, path and body: session ids
    at several places of request bodies, three shapes of usage in response
    bodies, and bodies that are no JSON."""
    q = F.expr("seq div 2")
    sid = F.format_string("s-%d", F.col("pid"))
    asked = (F.when(q % 4 == 0, F.concat(F.lit('{"session_id":"'), sid, F.lit('"}')))
             .when(q % 4 == 1, F.concat(F.lit('{"metadata":{"sessionId":"'), sid, F.lit('"},"conversation_id":"c1"}')))
             .when(q % 4 == 2, F.concat(F.lit('{"metadata":{"user_id":"u1_session_'), sid, F.lit('"}}')))
             .otherwise(F.lit('{"messages":[]}')))
    told = (F.when(q % 11 == 0, F.lit("no json {"))
            .when(q % 3 == 0, F.format_string('{"model":"r-%d","usage":{"input_tokens":%d,"output_tokens":%d,"cache_read_input_tokens":3},"stop_reason":"end_turn"}',
                                              q % 4, q % 100, q % 50))
            .when(q % 3 == 1, F.format_string('{"usage":{"prompt_tokens":%d,"completion_tokens":%d},"choices":[{"finish_reason":"stop"}],"id":"x%d"}',
                                              q % 90, q % 40, q % 5))
            .otherwise(F.format_string('{"usageMetadata":{"promptTokenCount":%d,"candidatesTokenCount":%d,"thoughtsTokenCount":2,"totalTokenCount":%d}}',
                                       q % 70, q % 30, q % 200)))
    host = F.element_at(_arr(API_HOSTS), (q % 4 + 1).cast("int"))
    request = F.col("kind") == "request"
    return llm_events(spark, sf_dir).select(
        "*", F.element_at(_arr(COMMS), (F.col("pid") % 5 + 1).cast("int")).alias("comm"),
        F.when(q % 6 == 0, F.lit("given")).alias("provider"), host.alias("host"),
        F.element_at(_arr(API_PATHS), (q % 5 + 1).cast("int")).alias("path"),
        F.when(F.col("has_body"), F.when(request, asked).otherwise(told)).alias("body"))


# Fixed values of the transcript fixture: tool names and shell commands.
TOOLS = ["Bash", "Read", "Edit", "WebFetch"]
COMMANDS = ["cargo test --all", "git commit -m fix", "curl https://h%d.example.com/x", "ls -la /repo",
            "sudo -E python3 run.py > out.txt"]
EPOCH_2024_MS = 1704067200000


def session_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent transcripts as JSONL lines (one file per conversation): user
    prompts (string or text-block content), assistant messages with usage,
    tool_use blocks on a second line of the same message, tool results, and
    system lines. Columns: file, line_no, line."""
    conv = read_table(spark, sf_dir, "conversations")
    c, t = F.col("conv_id"), F.col("turn")
    ts = F.lit(EPOCH_2024_MS) + c * 3600000 + t * 60000 + F.char_length("text") % 30000
    iso = F.date_format(F.timestamp_millis(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    sid = F.format_string("c-%d", c)
    base = conv.select("conv_id", "turn", "role", "text", sid.alias("sid"), iso.alias("iso"),
                       F.format_string("/work/c%d", c % 5).alias("cwd"),
                       F.format_string("/sessions/c-%d.jsonl", c).alias("file"))
    head = [F.col("sid").alias("sessionId"), F.col("cwd"), F.col("iso").alias("timestamp")]
    user = base.where((F.col("role") == "user") & (c % 4 != 2)).select(
        "file", (t * 3).alias("line_no"),
        F.to_json(F.struct(F.lit("user").alias("type"), *head,
                           F.struct(F.lit("user").alias("role"), F.col("text").alias("content")).alias("message")))
        .alias("line"))
    user_blocks = base.where((F.col("role") == "user") & (c % 4 == 2)).select(
        "file", (t * 3).alias("line_no"),
        F.to_json(F.struct(F.lit("user").alias("type"), *head, F.struct(
            F.lit("user").alias("role"),
            F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"))
            .alias("message"))).alias("line"))
    usage = F.struct((t * 10).alias("input_tokens"), F.expr("char_length(text) div 4").alias("output_tokens"),
                     (c % 7).alias("cache_read_input_tokens"))
    msg = lambda content: F.struct(F.format_string("msg-%d-%d", c, t).alias("id"),
                                   F.format_string("claude-sonnet-%d", c % 3).alias("model"),
                                   usage.alias("usage"), content.alias("content"))
    asst = base.where(F.col("role") == "assistant")
    a_text = asst.select("file", (t * 3).alias("line_no"), F.to_json(F.struct(
        F.lit("assistant").alias("type"), *head,
        msg(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))).alias("message")))
        .alias("line"))
    k = (c + t) % 4
    cmd = F.element_at(F.array(*[F.lit(x) for x in COMMANDS]), ((c * 7 + t) % 5 + 1).cast("int"))
    cmd = F.when(F.instr(cmd, "%d") > 0, F.format_string("curl https://h%d.example.com/x", c)).otherwise(cmd)
    tool_input = F.struct(
        F.when(k == 0, cmd).alias("command"),
        F.when(k.isin(1, 2), F.format_string("/repo/d%d/f%d.py", t % 3, c)).alias("file_path"),
        F.when(k == 3, F.format_string("https://docs.example.com/p%d", t)).alias("url"))
    tool_block = F.struct(F.lit("tool_use").alias("type"), F.format_string("tu-%d-%d", c, t).alias("id"),
                          F.element_at(F.array(*[F.lit(x) for x in TOOLS]), (k + 1).cast("int")).alias("name"),
                          tool_input.alias("input"))
    with_tool = asst.where(t % 3 == 1)
    a_tool = with_tool.select("file", (t * 3 + 1).alias("line_no"), F.to_json(F.struct(
        F.lit("assistant").alias("type"), *head, msg(F.array(tool_block)).alias("message"))).alias("line"))
    result = with_tool.where((c + t) % 7 != 0).select("file", (t * 3 + 2).alias("line_no"), F.to_json(F.struct(
        F.lit("user").alias("type"), *head,
        F.struct(F.lit("user").alias("role"), F.array(F.struct(
            F.lit("tool_result").alias("type"), F.format_string("tu-%d-%d", c, t).alias("tool_use_id"),
            F.lit("done").alias("content"))).alias("content")).alias("message"),
        F.struct(((c + t) % 5 == 0).alias("is_error")).alias("toolUseResult"))).alias("line"))
    system = base.where(F.col("role") == "system").select("file", (t * 3).alias("line_no"), F.to_json(F.struct(
        F.lit("system").alias("type"), *head, F.col("text").alias("content"))).alias("line"))
    return user.unionByName(user_blocks).unionByName(a_text).unionByName(a_tool).unionByName(result) \
        .unionByName(system)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    iso = F.date_format(F.timestamp_millis(F.lit(EPOCH_2024_MS) + c * 3600000 + t * 60000), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", iso.alias("timestamp"))


def rollout_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of the rollout dialect (file, line_no, line): model changes,
    user and agent messages in both shapes, function calls and outputs, token
    reports with running counters that begin anew at turn 5."""
    c, t = F.col("conv_id"), F.col("turn")
    base = _turns(spark, sf_dir).withColumn("file", F.format_string("/home/u/.codex/sessions/r-%d.jsonl", c))
    user, asst = F.col("role") == "user", F.col("role") == "assistant"
    sid = F.when(c % 4 != 3, F.format_string("sess-%d", c)).alias("session_id")

    def lines(where, offset, typ, payload):
        body = F.struct(F.lit(typ).alias("type"), "timestamp", payload.alias("payload"))
        return base.where(where).select("file", (t * 10 + offset).alias("line_no"), F.to_json(body).alias("line"))

    def typed(name, *fields):
        return F.struct(F.lit(name).alias("type"), *fields)

    turn = F.struct(F.lit("message").alias("type"), "timestamp", sid, F.array(
        F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("content")),
        F.struct(F.lit("tool_result").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("left out").alias("content"))).alias("content"))
    args = F.when(c % 5 == 0, F.format_string("plain words %d", t)).otherwise(
        F.format_string('{"cmd":"%s"}', F.element_at(F.array(*[F.lit(x) for x in ("cargo test --all", "ls -la /repo", "git commit -m fix")]),
                                                     ((c + t) % 3 + 1).cast("int"))))
    call_id = F.format_string("call-%d-%d", c, t).alias("call_id")
    has_call = asst & ((c + t) % 3 == 1)
    output = F.when(c % 3 == 0, "Process exited with code 0").when(c % 3 == 1, "Process exited with code 2").otherwise("done")
    counter = F.struct(F.when(t >= 5, t * 2).otherwise(t * (t + 1)).alias("input_tokens"), t.alias("output_tokens"),
                       (F.when(t >= 5, t * 2).otherwise(t * (t + 1)) + t).alias("total_tokens"))
    last = F.struct((t * 3).alias("input_tokens"), (c % 11).alias("output_tokens"), (t % 4).alias("cached_input_tokens"),
                    (t * 3 + c % 11).alias("total_tokens"))
    parts = [
        lines(t % 3 == 0, 0, "turn_context", F.struct(F.format_string("model-%d", (c + t) % 4).alias("model"))),
        lines(user & (c % 3 != 0), 1, "event_msg", typed("user_message", F.col("text").alias("message"), sid)),
        base.where(user & (c % 3 == 0)).select("file", (t * 10 + 1).alias("line_no"), F.to_json(turn).alias("line")),
        lines(asst & (t % 4 != 3), 1, "event_msg", typed("agent_message", F.col("text").alias("message"))),
        lines(asst & (t % 4 == 3), 1, "response_item", typed("message", F.col("text").alias("content"))),
        lines(has_call, 2, "response_item", typed("function_call", F.lit("exec_command").alias("name"), args.alias("arguments"), call_id)),
        lines(has_call & ((c + t) % 7 != 0), 3, "response_item", typed("function_call_output", call_id, output.alias("output"))),
        lines(asst & (t % 5 != 4), 4, "event_msg", typed("token_count", F.struct(last.alias("last_token_usage"), counter.alias("total_token_usage")).alias("info"))),
        lines(asst & (t % 3 == 0), 5, "event_msg", typed("token_count", F.struct(counter.alias("total_token_usage")).alias("info"))),
        base.where(t == 0).select("file", F.lit(9).cast("bigint").alias("line_no"), F.lit("{not json").alias("line")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def session_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of the document dialect (file, document): one JSON document
    a conversation; texts plain or in blocks, tokens and models at times missing."""
    c, t = F.col("conv_id"), F.col("turn")
    text, none = F.col("text"), F.lit(None).cast("string")
    blocks = F.array(F.struct(none.alias("type"), text), F.struct(F.lit("tool_use").alias("type"), F.lit("left out").alias("text")))
    tokens = F.when(t % 3 != 2, F.struct((t * 7).alias("input"), (c % 9).alias("output"), (t % 2).alias("cached"), (t * 7 + c % 9).alias("total")))
    call = F.struct(F.format_string("tc-%d-%d", c, t).alias("id"), F.lit("Read").alias("name"), F.format_string("/repo/f%d.py", t).alias("path"))

    def message(content):
        answer = F.col("role") == "assistant"
        return F.to_json(F.struct(
            F.when(answer, "gemini").otherwise(F.col("role")).alias("type"), "timestamp", content.alias("content"),
            F.when(answer & (t % 4 != 3), F.format_string("flash-%d", c % 3)).alias("model"), F.when(answer, tokens).alias("tokens"),
            F.when(answer & ((c + t) % 4 == 1), F.array(call)).alias("toolCalls")))

    x = _turns(spark, sf_dir).select("conv_id", "turn", F.when(c % 2 == 0, message(text)).otherwise(message(blocks)).alias("m"))
    messages = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "m"))), lambda s: s["m"]), ",")
    head = F.when(c % 5 != 0, F.format_string('"sessionId":"doc-%d",', c)).otherwise("")
    return x.groupBy("conv_id").agg(messages.alias("all")).select(
        F.format_string("/home/u/.gemini/tmp/p/chats/session-%d.json", c).alias("file"),
        F.concat(F.lit("{"), head, F.lit('"messages":['), F.col("all"), F.lit("]}")).alias("document"))


def sse_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streamed LLM responses: one SSE body per assistant turn (message_start,
    one text delta per word, message_delta with usage, message_stop); every
    third conversation uses chunked transfer framing."""
    conv = read_table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    c, t = F.col("conv_id"), F.col("turn")
    words = F.split("text", " ")
    n = F.size(words)
    start = F.to_json(F.struct(F.lit("message_start").alias("type"), F.struct(
        F.format_string("msg_%d_%d", c, t).alias("id"), F.format_string("claude-%d", c % 3).alias("model"),
        F.struct((t * 10).alias("input_tokens")).alias("usage")).alias("message")))
    deltas = F.transform(words, lambda w, i: F.to_json(F.struct(
        F.lit("content_block_delta").alias("type"), F.lit(0).alias("index"),
        F.struct(F.lit("text_delta").alias("type"),
                 F.when(i < n - 1, F.concat(w, F.lit(" "))).otherwise(w).alias("text")).alias("delta"))))
    mdelta = F.to_json(F.struct(F.lit("message_delta").alias("type"), F.struct(n.alias("output_tokens")).alias("usage")))
    stop = F.lit('{"type":"message_stop"}')
    evs = F.concat(F.array(F.concat(F.lit("event: message_start\ndata: "), start, F.lit("\n"))),
                   F.transform(deltas, lambda d: F.concat(F.lit("event: content_block_delta\ndata: "), d, F.lit("\n"))),
                   F.array(F.concat(F.lit("event: message_delta\ndata: "), mdelta, F.lit("\n")),
                           F.concat(F.lit("event: message_stop\ndata: "), stop, F.lit("\n"))))
    plain = F.array_join(evs, "\n")
    chunked = F.concat(F.array_join(F.transform(evs, lambda e: F.concat(F.hex(F.length(e)), F.lit("\r\n"), e)),
                                    "\r\n"), F.lit("\r\n0\r\n\r\n"))
    return conv.select((c % 7).alias("pid"), (c % 3 + 1).alias("tid"), (c * 1000 + t).alias("seq"),
                       (F.lit(EPOCH_2024_MS) + c * 3600000 + t * 60000).alias("timestamp_ms"),
                       F.when(c % 3 == 0, chunked).otherwise(plain).alias("body"))


URL_HOST = r"^https?://([^/?#]+)"
URL_PATH = r"^https?://[^/?#]+([^?#]*)"
URL_QUERY = r"\?([^#]*)"


def http_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request/response pairs from raw pages: one request and one response row
    per page, tid = page_id % 16 so several exchanges share a thread."""
    pages = read_table(spark, sf_dir, "pages")
    pid = F.col("page_id") % 7
    m = F.col("page_id") % 4
    method = F.when(m == 0, "POST").when(m == 3, "OPTIONS").otherwise("GET")
    s = F.col("page_id") % 10
    status = F.when(s == 0, 404).when(s == 1, 500).when(s == 7, 304).when(s == 9, 204).otherwise(200)
    ctype = (F.when(F.col("page_id") % 5 == 0, "text/event-stream")
             .when(F.col("page_id") % 5 == 1, "application/json")
             .otherwise("text/html; charset=utf-8"))
    base = pages.select(
        "page_id",
        pid.alias("pid"),
        (F.col("page_id") % 16).alias("tid"),
        F.regexp_extract("url", URL_HOST, 1).alias("host"),
        F.regexp_extract("url", URL_PATH, 1).alias("path"),
        F.regexp_extract("url", URL_QUERY, 1).alias("query"),
        method.alias("method"),
        status.alias("status_code"),
        ctype.alias("content_type"),
        (F.col("page_id") * 1000).alias("req_ms"),
        (F.col("page_id") * 1000 + F.length("html") % 900).alias("resp_ms"),
        "html",
    )
    req = base.select(
        (F.col("page_id") * 2).alias("seq"), "page_id", "pid", "tid",
        F.lit("request").alias("message_type"),
        F.col("req_ms").alias("timestamp_ms"),
        "method", "host", "path", "query", F.lit("HTTP/1.1").alias("protocol"),
        F.lit(None).cast("int").alias("status_code"),
        F.lit(None).cast("string").alias("content_type"),
        F.when(F.col("method") == "POST", F.col("html")).otherwise(F.lit("")).alias("body"))
    resp = base.select(
        (F.col("page_id") * 2 + 1).alias("seq"), "page_id", "pid", "tid",
        F.lit("response").alias("message_type"),
        F.col("resp_ms").alias("timestamp_ms"),
        F.lit(None).cast("string").alias("method"), "host",
        F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("query"),
        F.lit("HTTP/1.1").alias("protocol"),
        F.col("status_code").cast("int").alias("status_code"), "content_type",
        F.when(F.col("status_code").isin(204, 304), F.lit("")).otherwise(F.col("html")).alias("body"))
    return req.unionByName(resp)


# ---------------------------------------------------------------------------
# DuckDB twins of the derivations above (used by oracle SQL). Each entry is a
# CTE body; ``with_fixtures(names, select)`` prefixes the needed ones.

def sse_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, event stream responses and their chunks of two runs: some
    chunks come too late, some from another thread."""
    b = sse_bodies(spark, sf_dir)
    run = F.format_string("run-%d", F.col("seq") % 2).alias("run_id")
    none, t = F.lit(None).cast("string"), F.col("timestamp_ms")
    whole = F.expr("seq div 1000") % 3 == 0

    def rows(df, k, at, tid, kind, content_type, body):
        return df.select(run, (F.col("seq") * 4 + k).alias("seq"), at.alias("timestamp_ms"), tid.alias("tid"), F.lit(kind).alias("type"),
                         content_type.alias("content_type"), body.alias("body"))

    html = F.when(F.col("seq") % 11 == 0, "text/html").otherwise("text/event-stream; charset=utf-8")
    last = F.lit('event: content_block_delta\ndata: {"delta":{"type":"thinking_delta","thinking":"!"}}')
    return (rows(b.where("seq % 2 = 0"), 0, t - 500, F.col("tid"), "request", none, F.lit("ask"))
            .unionByName(rows(b, 1, t, F.col("tid"), "response", html, F.when(whole, F.col("body")).otherwise("")))
            .unionByName(rows(b.where(~whole), 2, t + F.col("seq") % 7 * 1000, F.col("tid"), "sse_chunk", none, F.col("body")))
            .unionByName(rows(b, 3, t + 8000, F.when(F.col("seq") % 5 == 0, F.col("tid") + 1).otherwise(F.col("tid")), "sse_chunk", none, last)))


SQL: dict[str, str] = {
    "raw": f"""SELECT event_id AS seq, epoch_us(ts) // 1000 AS timestamp_ms, user_id AS pid,
        user_id AS tid, user_id // 2 AS ppid, {_sql_list(COMMS)}[user_id % 5 + 1] AS comm,
        event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
    "token_usage": f"""SELECT 'token-' || seq AS id,
        CASE WHEN k % 6 = 4 THEN 'call-' || (seq // 30) || '-' || (seq % 30) ELSE 'call-' || (seq // 3) END AS llm_call_id,
        seq, timestamp_ms, pid, comm, {_sql_list(PROVIDERS)}[k % 3 + 1] AS provider,
        CASE WHEN k % 11 = 0 THEN NULL ELSE 'model-' || (k % 5) END AS model,
        CAST(floor(value * 10) AS BIGINT) AS input_tokens, k AS output_tokens,
        k % 7 AS cache_creation_tokens, (k % 3) * 10 AS cache_read_tokens,
        CAST(floor(value * 10) AS BIGINT) + k + k % 7 + (k % 3) * 10 AS total_tokens,
        {_sql_list(TOKEN_SOURCES)}[k % 6 + 1] AS source, 'view' AS view_source,
        (k % 10) / 10 AS confidence FROM raw""",
    "llm_calls": f"""SELECT 'call-' || (seq // 3) AS id, seq, 's-' || pid AS session_id,
        timestamp_ms AS start_timestamp_ms, timestamp_ms + k * 10 AS end_timestamp_ms, pid, comm,
        {_sql_list(PROVIDERS)}[k % 3 + 1] AS provider, 'model-' || (k % 5) AS model,
        CASE WHEN k % 17 = 0 OR k % 13 = 0 THEN 'error' ELSE 'complete' END AS status,
        CAST(CASE WHEN k % 17 = 0 THEN 500 WHEN k % 13 = 0 THEN 429 ELSE 200 END AS INTEGER) AS status_code,
        'h' || (k % 20) || '.example.com' AS host, '/v1/messages' AS path
        FROM raw WHERE event_type = 'purchase'""",
    "sessions": """SELECT 's-' || pid AS id, 'agent' AS agent_type, min(timestamp_ms) AS start_timestamp_ms,
            max(timestamp_ms) AS end_timestamp_ms, '/repo/u' || (pid % 7) AS cwd FROM raw GROUP BY pid
        UNION ALL
        SELECT 'call-' || conv_id, 'agent_native', conv_id * 3600000 + min(turn) * 60000,
            conv_id * 3600000 + max(turn) * 60000,
            CASE WHEN conv_id % 4 = 3 THEN '' ELSE '/work/c' || (conv_id % 5) END
        FROM conversations GROUP BY conv_id""",
    "canon": """SELECT seq, timestamp_ms, pid, tid, ppid, comm, k, value,
        CASE WHEN event_type IN ('signup', 'error') THEN 'process' WHEN event_type = 'view' THEN 'file'
             WHEN event_type = 'click' THEN 'network' ELSE 'llm' END AS kind,
        CASE event_type WHEN 'signup' THEN 'EXEC' WHEN 'error' THEN 'EXIT' WHEN 'view' THEN 'FILE_OPEN'
             WHEN 'click' THEN 'NET_CONNECT' ELSE 'LLM_REQUEST' END AS event,
        CASE WHEN event_type = 'error' THEN k % 3 END AS exit_code,
        CASE WHEN event_type = 'signup' THEN '/usr/bin/' || comm END AS filename,
        CASE WHEN event_type = 'signup' THEN '/repo/u' || (pid % 7) END AS cwd,
        CASE WHEN event_type = 'view' THEN (CASE WHEN k % 25 = 0 THEN '/etc/passwd' ELSE '/repo/d' || (k % 10) || '/f' || k || '.py' END)
             WHEN event_type = 'click' THEN '/api/v' || (k % 3)
             WHEN event_type = 'purchase' THEN '/v1/messages' END AS path,
        CASE WHEN event_type = 'view' THEN k % 4 END AS flags,
        CASE WHEN event_type = 'click' THEN 'h' || (k % 20) || '.example.com'
             WHEN event_type = 'purchase' THEN 'api' || (k % 3) || '.example.com' END AS host,
        CAST(CASE WHEN event_type = 'click' THEN (CASE WHEN k % 17 = 0 THEN 500 ELSE 200 END)
             WHEN event_type = 'purchase' THEN (CASE WHEN k % 17 = 0 THEN 500 WHEN k % 13 = 0 THEN 429 ELSE 200 END) END AS INTEGER) AS status_code
        FROM raw""",
    "resource_samples": """SELECT seq, timestamp_ms, pid, comm, value AS cpu_percent, k * 10 AS rss_mb FROM raw""",
    "proc_samples": """SELECT seq, timestamp_ms AS sample_ts, pid, pid * 100 AS starttime_ticks, ppid, comm,
        '/usr/bin/' || comm AS command, '/repo/u' || (pid % 7) AS cwd,
        CAST(sum(k) OVER w AS BIGINT) AS ticks, k * 1024 AS rss_kb, k * 1024 * 5 + pid AS vsz_kb,
        CAST(sum(k * 100) OVER w AS BIGINT) AS read_bytes, CAST(sum((k % 7) * 1000) OVER w AS BIGINT) AS write_bytes,
        value AS cpu_percent, (timestamp_ms - 1704067200000) / 1000 + 1000 AS uptime_s
        FROM raw WINDOW w AS (PARTITION BY pid ORDER BY timestamp_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "session_log": """SELECT 'c-' || conv_id AS session_id, conv_id, turn AS position, role,
        CASE WHEN role = 'user' THEN 'prompt' WHEN role = 'assistant' THEN 'llm' ELSE 'system' END AS kind,
        text, conv_id * 3600000 + turn * 60000 + length(text) % 30000 AS timestamp_ms,
        left(sha256(text), 12) AS text_hash FROM conversations""",
    "http_base": f"""SELECT page_id, page_id % 7 AS pid, page_id % 16 AS tid,
        regexp_extract(url, '{URL_HOST}', 1) AS host, regexp_extract(url, '{URL_PATH}', 1) AS path,
        regexp_extract(url, '{URL_QUERY}', 1) AS query,
        CASE WHEN page_id % 4 = 0 THEN 'POST' WHEN page_id % 4 = 3 THEN 'OPTIONS' ELSE 'GET' END AS method,
        CASE page_id % 10 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 7 THEN 304 WHEN 9 THEN 204 ELSE 200 END AS status_code,
        CASE WHEN page_id % 5 = 0 THEN 'text/event-stream' WHEN page_id % 5 = 1 THEN 'application/json'
             ELSE 'text/html; charset=utf-8' END AS content_type,
        page_id * 1000 AS req_ms, page_id * 1000 + length(html) % 900 AS resp_ms, html FROM pages""",
    "http": """SELECT page_id * 2 AS seq, page_id, pid, tid, 'request' AS message_type, req_ms AS timestamp_ms,
            method, host, path, query, 'HTTP/1.1' AS protocol, CAST(NULL AS INTEGER) AS status_code,
            CAST(NULL AS VARCHAR) AS content_type, CASE WHEN method = 'POST' THEN html ELSE '' END AS body
        FROM http_base
        UNION ALL
        SELECT page_id * 2 + 1, page_id, pid, tid, 'response', resp_ms, NULL, host, NULL, NULL, 'HTTP/1.1',
            CAST(status_code AS INTEGER), content_type,
            CASE WHEN status_code IN (204, 304) THEN '' ELSE html END
        FROM http_base""",
}

_CMDS_SQL = "[" + ", ".join("'" + x + "'" for x in COMMANDS) + "]"
_TOOLS_SQL = "[" + ", ".join("'" + x + "'" for x in TOOLS) + "]"
SQL["jsonl_base"] = f"""SELECT conv_id AS c, turn AS t, role, text, 'c-' || conv_id AS sid,
        strftime(make_timestamp(({EPOCH_2024_MS} + conv_id * 3600000 + turn * 60000 + length(text) % 30000) * 1000),
                 '%Y-%m-%dT%H:%M:%S.%gZ') AS iso,
        '/work/c' || (conv_id % 5) AS cwd, '/sessions/c-' || conv_id || '.jsonl' AS file,
        (conv_id + turn) % 4 AS k,
        CASE WHEN strpos({_CMDS_SQL}[(conv_id * 7 + turn) % 5 + 1], '%d') > 0
             THEN 'curl https://h' || conv_id || '.example.com/x' ELSE {_CMDS_SQL}[(conv_id * 7 + turn) % 5 + 1] END AS cmd
    FROM conversations"""
SQL["session_jsonl"] = f"""
    SELECT file, t * 3 AS line_no, json_object('type', 'user', 'sessionId', sid, 'cwd', cwd, 'timestamp', iso,
        'message', json_object('role', 'user', 'content', text))::VARCHAR AS line
    FROM jsonl_base WHERE role = 'user' AND c % 4 <> 2
    UNION ALL
    SELECT file, t * 3, json_object('type', 'user', 'sessionId', sid, 'cwd', cwd, 'timestamp', iso,
        'message', json_object('role', 'user', 'content', json_array(json_object('type', 'text', 'text', text))))::VARCHAR
    FROM jsonl_base WHERE role = 'user' AND c % 4 = 2
    UNION ALL
    SELECT file, t * 3, json_object('type', 'assistant', 'sessionId', sid, 'cwd', cwd, 'timestamp', iso,
        'message', json_object('id', 'msg-' || c || '-' || t, 'model', 'claude-sonnet-' || (c % 3),
            'usage', json_object('input_tokens', t * 10, 'output_tokens', length(text) // 4, 'cache_read_input_tokens', c % 7),
            'content', json_array(json_object('type', 'text', 'text', text))))::VARCHAR
    FROM jsonl_base WHERE role = 'assistant'
    UNION ALL
    SELECT file, t * 3 + 1, json_object('type', 'assistant', 'sessionId', sid, 'cwd', cwd, 'timestamp', iso,
        'message', json_object('id', 'msg-' || c || '-' || t, 'model', 'claude-sonnet-' || (c % 3),
            'usage', json_object('input_tokens', t * 10, 'output_tokens', length(text) // 4, 'cache_read_input_tokens', c % 7),
            'content', json_array(json_object('type', 'tool_use', 'id', 'tu-' || c || '-' || t,
                'name', {_TOOLS_SQL}[k + 1],
                'input', CASE WHEN k = 0 THEN json_object('command', cmd)
                              WHEN k IN (1, 2) THEN json_object('file_path', '/repo/d' || (t % 3) || '/f' || c || '.py')
                              ELSE json_object('url', 'https://docs.example.com/p' || t) END))))::VARCHAR
    FROM jsonl_base WHERE role = 'assistant' AND t % 3 = 1
    UNION ALL
    SELECT file, t * 3 + 2, json_object('type', 'user', 'sessionId', sid, 'cwd', cwd, 'timestamp', iso,
        'message', json_object('role', 'user', 'content', json_array(json_object('type', 'tool_result',
            'tool_use_id', 'tu-' || c || '-' || t, 'content', 'done'))),
        'toolUseResult', json_object('is_error', (c + t) % 5 = 0))::VARCHAR
    FROM jsonl_base WHERE role = 'assistant' AND t % 3 = 1 AND (c + t) % 7 <> 0
    UNION ALL
    SELECT file, t * 3, json_object('type', 'system', 'sessionId', sid, 'cwd', cwd, 'timestamp', iso,
        'content', text)::VARCHAR
    FROM jsonl_base WHERE role = 'system'"""

SQL["sse_bodies"] = f"""SELECT conv_id % 7 AS pid, conv_id % 3 + 1 AS tid, conv_id * 1000 + turn AS seq,
        {EPOCH_2024_MS} + conv_id * 3600000 + turn * 60000 AS timestamp_ms,
        CASE WHEN conv_id % 3 = 0
             THEN array_to_string(list_transform(evs, lambda e: printf('%X', length(e)) || chr(13) || chr(10) || e),
                                  chr(13) || chr(10)) || chr(13) || chr(10) || '0' || chr(13) || chr(10) || chr(13) || chr(10)
             ELSE array_to_string(evs, chr(10)) END AS body
    FROM (SELECT conv_id, turn,
            list_concat(
              ['event: message_start' || chr(10) || 'data: ' || json_object('type', 'message_start', 'message',
                  json_object('id', 'msg_' || conv_id || '_' || turn, 'model', 'claude-' || (conv_id % 3),
                              'usage', json_object('input_tokens', turn * 10)))::VARCHAR || chr(10)],
              list_transform(ws, lambda w, i: 'event: content_block_delta' || chr(10) || 'data: ' ||
                  json_object('type', 'content_block_delta', 'index', 0, 'delta', json_object('type', 'text_delta',
                      'text', CASE WHEN i < len(ws) THEN w || ' ' ELSE w END))::VARCHAR || chr(10)),
              ['event: message_delta' || chr(10) || 'data: ' || json_object('type', 'message_delta',
                  'usage', json_object('output_tokens', len(ws)))::VARCHAR || chr(10),
               'event: message_stop' || chr(10) || 'data: {{"type":"message_stop"}}' || chr(10)]) AS evs
          FROM (SELECT *, string_split(text, ' ') AS ws FROM conversations WHERE role = 'assistant'))"""

SQL["llm_base"] = """SELECT seq, timestamp_ms, pid // 15 AS pid, pid % 2 AS tid, k,
        CASE WHEN k % 4 = 0 THEN 'req-' || seq END AS request_id, CASE WHEN k % 9 <> 0 THEN 'model-' || (k % 5) END AS model,
        (k % 9 <> 0 OR k % 2 = 0) AS has_body FROM raw WHERE event_type = 'purchase'"""
SQL["llm_events"] = """SELECT seq * 2 AS seq, timestamp_ms, pid, tid, 'request' AS kind, request_id, model, has_body,
            CAST(NULL AS INTEGER) AS status_code FROM llm_base
        UNION ALL SELECT seq * 2 + 1, timestamp_ms + k * 5000, pid, tid, 'response', request_id, NULL, true,
            CASE WHEN k % 17 = 0 THEN 500 WHEN k % 13 = 0 THEN 429 ELSE 200 END FROM llm_base WHERE k % 7 <> 0"""
SQL["llm_traffic"] = f"""SELECT seq, timestamp_ms, pid, tid, kind, request_id, model, has_body, status_code,
        {_sql_list(COMMS)}[pid % 5 + 1] AS comm, CASE WHEN q % 6 = 0 THEN 'given' END AS provider,
        {_sql_list(API_HOSTS)}[q % 4 + 1] AS host, {_sql_list(API_PATHS)}[q % 5 + 1] AS path,
        CASE WHEN NOT has_body THEN NULL WHEN kind = 'request' THEN CASE q % 4
            WHEN 0 THEN '{{"session_id":"s-' || pid || '"}}'
            WHEN 1 THEN '{{"metadata":{{"sessionId":"s-' || pid || '"}},"conversation_id":"c1"}}'
            WHEN 2 THEN '{{"metadata":{{"user_id":"u1_session_s-' || pid || '"}}}}' ELSE '{{"messages":[]}}' END
        WHEN q % 11 = 0 THEN 'no json {{'
        WHEN q % 3 = 0 THEN '{{"model":"r-' || (q % 4) || '","usage":{{"input_tokens":' || (q % 100) || ',"output_tokens":' || (q % 50)
            || ',"cache_read_input_tokens":3}},"stop_reason":"end_turn"}}'
        WHEN q % 3 = 1 THEN '{{"usage":{{"prompt_tokens":' || (q % 90) || ',"completion_tokens":' || (q % 40)
            || '}},"choices":[{{"finish_reason":"stop"}}],"id":"x' || (q % 5) || '"}}'
        ELSE '{{"usageMetadata":{{"promptTokenCount":' || (q % 70) || ',"candidatesTokenCount":' || (q % 30)
            || ',"thoughtsTokenCount":2,"totalTokenCount":' || (q % 200) || '}}}}' END AS body
        FROM (SELECT *, seq // 2 AS q FROM llm_events)"""
SQL["fleet"] = "SELECT 'run-' || (seq % 2) AS run_id, 'm-' || (k % 2) AS machine, * FROM canon"

SQL["sse_timeline"] = """
    SELECT 'run-' || (seq % 2) AS run_id, seq * 4 AS seq, timestamp_ms - 500 AS timestamp_ms, tid, 'request' AS type, NULL AS content_type, 'ask' AS body
    FROM sse_bodies WHERE seq % 2 = 0
    UNION ALL SELECT 'run-' || (seq % 2), seq * 4 + 1, timestamp_ms, tid, 'response', CASE WHEN seq % 11 = 0 THEN 'text/html' ELSE 'text/event-stream; charset=utf-8' END,
        CASE WHEN seq // 1000 % 3 = 0 THEN body ELSE '' END FROM sse_bodies
    UNION ALL SELECT 'run-' || (seq % 2), seq * 4 + 2, timestamp_ms + seq % 7 * 1000, tid, 'sse_chunk', NULL, body FROM sse_bodies WHERE seq // 1000 % 3 <> 0
    UNION ALL SELECT 'run-' || (seq % 2), seq * 4 + 3, timestamp_ms + 8000, CASE WHEN seq % 5 = 0 THEN tid + 1 ELSE tid END, 'sse_chunk', NULL,
        'event: content_block_delta' || chr(10) || 'data: {"delta":{"type":"thinking_delta","thinking":"!"}}' FROM sse_bodies"""

# CTE dependencies, in definition order.
SQL_DEPS = {
    "raw": [], "token_usage": ["raw"], "llm_calls": ["raw"], "sessions": ["raw"],
    "canon": ["raw"], "fleet": ["canon"], "llm_base": ["raw"], "llm_events": ["llm_base"], "llm_traffic": ["llm_events"], "resource_samples": ["raw"], "proc_samples": ["raw"],
    "session_log": [], "http_base": [], "http": ["http_base"],
    "jsonl_base": [], "session_jsonl": ["jsonl_base"], "sse_bodies": [], "sse_timeline": ["sse_bodies"],
}


def with_fixtures(names: list[str], select: str, extra_ctes: list[tuple[str, str]] = (),
                  recursive: bool = False) -> str:
    """Build ``WITH <fixture CTEs>, <extra CTEs> <select>`` for DuckDB."""
    order: list[str] = []

    def visit(n):
        for d in SQL_DEPS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({q})" for n, q in extra_ctes]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" if parts else "") + select
