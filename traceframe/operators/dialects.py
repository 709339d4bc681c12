"""The transcript dialects beside the message lines of ``sessionlog``.

* ``rollout``: JSON lines whose ``payload`` holds the event (user and agent
  messages, function calls and outputs, running token counters, model changes).
* ``document``: one JSON document a file, with all messages of the session.

Both give the three child tables of ``sessionlog.session_events`` (prompts,
tools, responses); responses also have ``total_tokens``. What a line takes from
the lines before it (the model, the response that a late token report fills)
comes from two-level scans over narrow rows keyed by file, so neither a long
session nor its texts meet in one task. A document is read whole, as its format
demands.

Defined cases: lines and documents that are no JSON objects are skipped; a
session without an id is named after its file; empty texts are no prompts and
no responses; missing counts are 0; an empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import short_hash
from ..functions.scan import prev_value, running_last
from .canonical import nesting, texts_below
from .correlate import clean_prompt_text
from .sessionlog import command_from_input, described_tools, session_events, status_from_output
from .sessions import attach_token_reports

BLOCK = 1024

# Folders and names that tell the dialect of a file, keys of ids and texts.
HOME_FOLDERS = [".claude/projects", ".codex/sessions", ".gemini/tmp"]
MESSAGES, ROLLOUT, DOCUMENT = "messages", "rollout", "document"
SESSION_KEYS = ["sessionId", "session_id", "payload.session_id", "payload.sessionId"]
CONVERSATION_KEYS = ["conversation_id", "conversationId", "thread_id", "threadId", "payload.conversation_id",
                     "payload.conversationId", "payload.thread_id", "payload.threadId"]
TEXT_KEYS = ("text", "content", "message", "input", "prompt")
NOT_SAID = ("tool_use", "function_call", "tool_result")
DEFAULT_MODEL = {ROLLOUT: "codex", DOCUMENT: "gemini"}


def dialect(path: Column) -> Column:
    """The dialect of a transcript file, null for other files."""
    lines = path.endswith(".jsonl")
    name = F.substring_index(path, "/", -1)
    return (F.when(path.contains("/.claude/") & lines, MESSAGES)
            .when(path.contains("/.codex/") & lines, ROLLOUT)
            .when(path.contains("/.gemini/") & path.contains("/chats/") & name.startswith("session-") & name.endswith(".json"), DOCUMENT)
            .when(path.contains("/codex/") & path.contains("sessions") & lines, ROLLOUT)
            .when(path.contains("/claude/") & path.contains("projects") & lines, MESSAGES))


def home_roots(home: str) -> list[str]:
    """The folders of a home folder that hold transcripts. (Spark lists no
    hidden folders below a root, so each is a root of its own.)"""
    return [f"{home.rstrip('/')}/{folder}" for folder in HOME_FOLDERS]


def transcript_files(spark: SparkSession, roots: list[str], newest: int | None = None) -> DataFrame:
    """Path, dialect, modification time and size of the transcripts under
    the existing folders ``roots``, from a listing that reads no content; with
    ``newest`` only that many."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").load(roots)
             .select(F.col("path").alias("file"), "modificationTime", "length").withColumn("dialect", dialect(F.col("file"))))
    files = files.where(F.col("dialect").isNotNull())
    if newest is not None:
        files = files.orderBy(F.col("modificationTime").desc(), F.col("file")).limit(newest)
    return files


def read_documents(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(file, document) of the JSON documents under ``roots``."""
    return (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "session-*.json").text(roots, wholetext=True)
            .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("document")))


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def _get(v: str, path: str, kind: str = "string") -> Column:
    return F.expr(f"try_variant_get({v}, '$.{path}', '{kind}')")


def _string(v: str, path: str) -> Column:
    """A member that is a string; null for any other kind."""
    return F.when(F.expr(f"schema_of_variant(try_variant_get({v}, '$.{path}', 'variant'))") == "STRING", _get(v, path))


def _count(v: str, path: str) -> Column:
    return F.coalesce(F.greatest(_get(v, path, "bigint"), F.lit(0)), F.lit(0)).cast("bigint")


def _millis(v: str) -> Column:
    return F.expr(f"unix_millis(try_to_timestamp(try_variant_get({v}, '$.timestamp', 'string')))")


def _once(rows: DataFrame, **made: Column) -> DataFrame:
    """Adds columns that are computed once a row: as the output of a generator
    they are not copied into the filters and expressions that read them."""
    x = rows.withColumn("_made", F.explode(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))
    return x.select(*[c for c in rows.columns if c not in made], *[F.col(f"_made.{n}").alias(n) for n in made])


def _first_id(keys: list[str]) -> Column:
    return F.coalesce(*[F.nullif(_string("v", k), F.lit("")) for k in keys])


def said(v: Column) -> Column:
    """The texts of a message at any depth, tool calls and results left out."""
    return clean_prompt_text(F.array_join(texts_below(F.array(v), nesting(F.to_json(v)), TEXT_KEYS, NOT_SAID), " "))


def content_text(v: Column) -> Column:
    """The text of a response: a string, the joined texts of its blocks (thoughts
    among them, tool calls and results not), or the text of one object."""
    kind = F.schema_of_variant(v)
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))

    def member(e: Column, name: str) -> Column:
        m = F.try_variant_get(e, f"$.{name}", "variant")
        return F.when(F.schema_of_variant(m) == "STRING", F.try_variant_get(e, f"$.{name}", "string"))

    def block(e: Column) -> Column:
        typ = F.coalesce(member(e, "type"), F.lit(""))
        return (F.when(F.schema_of_variant(e) == "STRING", F.try_variant_get(e, "$", "string"))
                .when(typ.isin(*NOT_SAID), F.lit(None).cast("string"))
                .when(typ == "thinking", F.nullif(member(e, "thinking"), F.lit("")))
                .otherwise(F.coalesce(member(e, "text"), member(e, "content"))))

    text = (F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
            .when(kind.startswith("ARRAY"), F.array_join(F.array_compact(F.transform(items, block)), "\n"))
            .when(kind.startswith("OBJECT"), F.coalesce(member(v, "text"), member(v, "content"))))
    return F.coalesce(text, F.lit(""))


def rollout_lines(lines: DataFrame) -> DataFrame:
    """Parsed lines (file, line_no, line) of rollouts with session id and kind."""
    x = _once(lines.select("file", F.col("line_no").cast("bigint").alias("position"), "line"), v=F.expr("try_parse_json(line)")).drop("line")
    own = F.coalesce(_first_id(SESSION_KEYS), _first_id(CONVERSATION_KEYS))
    x = _once(x.where(F.expr("schema_of_variant(v) LIKE 'OBJECT%'")), id=own, typ=F.coalesce(_get("v", "type"), F.lit("")),
              inner=F.coalesce(_get("v", "payload.type"), F.lit("")), timestamp_ms=_millis("v"))
    ids = x.select("file", "position", "id").where("id is not null").groupBy("file").agg(F.max_by("id", "position").alias("session_id"))
    typ, inner = F.col("typ"), F.col("inner")
    event, item = typ == "event_msg", typ == "response_item"
    kind = (F.when(typ == "turn_context", "context")
            .when(event & inner.isin("token_count", "token_usage"), "report")
            .when(event & (inner == "user_message"), "prompt")
            .when(typ.isin("message", "input", "user"), "turn")
            .when((event & (inner == "agent_message")) | (item & (inner == "message")), "response")
            .when(item & (inner == "function_call"), "call")
            .when(item & (inner == "function_call_output"), "output")
            .when(typ.contains("user"), "early"))
    x = x.withColumn("kind", kind).where("kind is not null").join(ids, "file", "left")
    return x.select("file", "position", "kind", "inner", "v", F.coalesce("session_id", _stem(F.col("file"))).alias("session_id"), "timestamp_ms")


def _message() -> Column:
    return clean_prompt_text(F.coalesce(_string("v", "payload.message"), _string("v", "payload.content")))


def _rollout_log(parsed: DataFrame) -> DataFrame:
    """Model changes, responses and token reports without their texts, each with
    the model then in force."""
    report = F.col("kind") == "report"
    x = _once(parsed.where(F.col("kind").isin("context", "response", "report")),
              text=F.when(F.col("kind") == "response", _message()), info=F.expr(
                  "coalesce(try_variant_get(v, '$.payload.info', 'variant'), try_variant_get(v, '$.payload.usage', 'variant'), "
                  "try_variant_get(v, '$.payload', 'variant'))"))
    total_usage = F.expr("try_variant_get(info, '$.total_token_usage', 'variant')")
    x = _once(x, usage=F.coalesce(F.expr("try_variant_get(info, '$.last_token_usage', 'variant')"), total_usage, F.col("info")),
              counter=F.when(report & (F.col("inner") == "token_count"), total_usage))
    total = F.greatest(_count("usage", "total_tokens"), _count("info", "total_tokens"), _count("info", "tokens"))
    counts = {"input_tokens": _count("usage", "input_tokens"), "output_tokens": _count("usage", "output_tokens"),
              "cache_tokens": _count("usage", "cached_input_tokens"), "total_tokens": total}
    x = x.where((F.col("kind") != "response") | F.col("text").isNotNull()).select(
        "file", "session_id", "position", "kind", "timestamp_ms",
        F.when(F.col("kind") == "context", _string("v", "payload.model")).alias("changed"),
        F.when(report, short_hash(F.to_json("usage"))).otherwise(short_hash(F.col("text"))).alias("text_hash"),
        *[F.when(report, c).otherwise(F.lit(0).cast("bigint")).alias(n) for n, c in counts.items()],
        F.when(F.col("counter").isNotNull(), F.struct(*[_count("counter", n).alias(n) for n in ("input_tokens", "output_tokens", "total_tokens")]))
        .alias("counter"))
    x = running_last(x, ["file"], F.expr(f"position div {BLOCK}"), ["position"], F.col("changed"), "model")
    return x.where("kind != 'context'").drop("changed")


def rollout_events(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """P1, rollout lines (file, line_no, line): (prompts, tools, responses).

    A token report fills the response before it if that has no tokens, else it
    is a response of its own (W13). A line of an unknown user type is a prompt
    only as the first one of its file. Status comes from the last output of a
    call id in the file (W12)."""
    parsed = rollout_lines(lines)
    p = (_once(parsed.where(F.col("kind").isin("prompt", "turn", "early")),
               text=F.when(F.col("kind") == "prompt", _message()).otherwise(said(F.col("v"))))
         .where("text is not null").select("file", "session_id", "position", "timestamp_ms", "kind", "text"))
    first = p.groupBy("file").agg(F.min("position").alias("first"))
    prompts = (p.join(first, "file").where("kind != 'early' or position = first")
               .select("session_id", "position", "timestamp_ms", "text", short_hash(F.col("text")).alias("text_hash")))

    given = F.expr("try_variant_get(v, '$.payload.arguments', 'variant')")
    raw = F.when(F.schema_of_variant(given) == "STRING", _get("v", "payload.arguments"))
    args = F.when(raw.isNull(), given).otherwise(F.coalesce(F.try_parse_json(raw), F.try_parse_json(F.to_json(F.struct(raw.alias("text"))))))
    calls = _once(parsed.where("kind = 'call'"), tool_name=F.coalesce(_string("v", "payload.name"), F.lit("?")),
                  call_id=_string("v", "payload.call_id"), _input=args)
    calls = _once(calls.select("file", "session_id", "position", "timestamp_ms", "tool_name", "call_id", "_input"),
                  command=command_from_input("_input"), input_path=F.coalesce(_string("_input", "file_path"), _string("_input", "path"))).drop("_input")
    outputs = (parsed.where("kind = 'output'").select("file", "position", _string("v", "payload.call_id").alias("call_id"),
                                                      status_from_output(_string("v", "payload.output")).alias("status"))
               .groupBy("file", "call_id").agg(F.max_by("status", "position").alias("status")))
    tools = described_tools(calls.join(outputs, ["file", "call_id"], "left")
                            .withColumn("status", F.coalesce("status", F.lit("observed"))).drop("file"))

    log = _rollout_log(parsed)
    counts = ["input_tokens", "output_tokens", "cache_tokens", "total_tokens"]
    settled = attach_token_reports(log.select(F.col("file").alias("session_id"), "position", "kind", *counts))
    llm = (settled.withColumnRenamed("session_id", "file").drop("source")
           .join(log.select("file", "position", "session_id", "timestamp_ms", "model", "text_hash"), ["file", "position"])
           .select("session_id", F.format_string("%s:%d", "session_id", "position").alias("message_id"), "position", "timestamp_ms",
                   F.coalesce("model", F.lit(DEFAULT_MODEL[ROLLOUT])).alias("model"), *counts, "text_hash"))
    return prompts, tools, llm


def rollout_usage(lines: DataFrame) -> DataFrame:
    """Tokens of each session and model from the running counters of its
    rollout: the latest counter seen under the model, and in ``added_*`` what
    the counters grew by under it. A counter below the one before it began anew
    and counts whole."""
    names = ["input_tokens", "output_tokens", "total_tokens"]
    x = _rollout_log(rollout_lines(lines)).where("counter is not null").select(
        "file", "session_id", "position", F.coalesce("model", F.lit("unknown")).alias("model"), "counter")
    x = prev_value(x, ["file"], F.expr(f"position div {BLOCK}"), ["position"], "counter", "before")
    grown = [F.when(F.col(f"counter.{n}") >= F.coalesce(F.col(f"before.{n}"), F.lit(0)), F.col(f"counter.{n}") - F.coalesce(F.col(f"before.{n}"), F.lit(0)))
             .otherwise(F.col(f"counter.{n}")) for n in names]
    out = x.groupBy("session_id", "model").agg(F.max_by("counter", F.struct("position", "file")).alias("_last"),
                                               *[F.sum(g).cast("bigint").alias(f"added_{n}") for n, g in zip(names, grown)])
    return out.select("session_id", "model", *[F.col(f"_last.{n}").alias(n) for n in names], *[f"added_{n}" for n in names])


def document_events(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """P1, JSON documents (file, document): (prompts, tools, responses). The
    place of a message in its document is its position; a tool call's command
    is looked for in the call itself."""
    x = _once(documents.select("file", "document"), v=F.expr("try_parse_json(document)")).drop("document")
    x = (x.where(F.expr("schema_of_variant(v) LIKE 'OBJECT%'"))
         .select(F.coalesce(_string("v", "sessionId"), _stem(F.col("file"))).alias("session_id"),
                 F.posexplode(_get("v", "messages", "array<variant>")).alias("position", "m")))
    x = _once(x.withColumn("position", F.col("position").cast("bigint")), type=_get("m", "type"), timestamp_ms=_millis("m"),
              content=F.expr("coalesce(try_variant_get(m, '$.content', 'variant'), m)"))

    prompts = (_once(x.where("type = 'user'"), text=said(F.col("content"))).where("text is not null")
               .select("session_id", "position", "timestamp_ms", "text", short_hash(F.col("text")).alias("text_hash")))

    answers = x.where(F.col("type").isin("gemini", "assistant", "model"))
    calls = answers.select("session_id", "position", "timestamp_ms", F.explode(_get("m", "toolCalls", "array<variant>")).alias("c"))
    paths = [_string("c", f"{at}{k}") for at in ("", "args.") for k in ("file_path", "path", "filepath")]
    calls = _once(calls, tool_name=F.coalesce(_string("c", "name"), F.lit("?")), call_id=_string("c", "id"),
                  command=command_from_input("c"), input_path=F.coalesce(*paths)).drop("c")
    tools = described_tools(calls.withColumn("status", F.lit("observed")))

    counted = F.coalesce(F.expr("schema_of_variant(try_variant_get(m, '$.tokens', 'variant')) LIKE 'OBJECT%'"), F.lit(False))
    llm = _once(answers, text=content_text(F.col("content"))).where((F.trim("text") != "") | counted).select(
        "session_id", F.format_string("%s:%d", "session_id", "position").alias("message_id"), "position", "timestamp_ms",
        F.coalesce(_string("m", "model"), F.lit(DEFAULT_MODEL[DOCUMENT])).alias("model"),
        _count("m", "tokens.input").alias("input_tokens"), _count("m", "tokens.output").alias("output_tokens"),
        _count("m", "tokens.cached").alias("cache_tokens"), _count("m", "tokens.total").alias("total_tokens"),
        short_hash(F.col("text")).alias("text_hash"))
    return prompts, tools, llm


def transcript_events(lines: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """P1 over files of all dialects: (prompts, tools, responses) with the
    dialect of each row, told by the path of its file."""
    of = dialect(F.col("file"))
    parts = [(MESSAGES, session_events(lines.where(of == MESSAGES))), (ROLLOUT, rollout_events(lines.where(of == ROLLOUT))),
             (DOCUMENT, document_events(documents.where(of == DOCUMENT)))]
    out = []
    for child in range(3):
        rows = None
        for name, tables in parts:
            t = tables[child].withColumn("dialect", F.lit(name))
            if child == 2 and "total_tokens" not in t.columns:
                t = t.withColumn("total_tokens", F.lit(0).cast("bigint"))
            t = t.withColumn("position", F.col("position").cast("bigint"))
            rows = t if rows is None else rows.unionByName(t)
        out.append(rows)
    return tuple(out)
