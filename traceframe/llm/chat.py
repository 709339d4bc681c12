"""Chat formatting: tool calls linked to their results, in DataFrame functions.

Calls and results are hash-joined by conversation and call identifier. A call
may come after another (its ``after`` identifier); topological depths are found
by pointer doubling, in as many joins as the longest chain has binary digits,
so one conversation may hold any share of the rows. Arguments are validated
against schemas of the tools, and every message is written as canonical JSON:
fields in order, no white space, numbers in shortest form.

Messages in order of (depth, turn) have each result after its call and each
call after the result of the one it follows; no conversation is gathered in
one place to number them.

Defined cases: null texts become JSON null; a call without identifier gets
status ``no_id``; of calls with one identifier the first (turn, then JSON)
counts and the others are ``duplicate``; unparsable arguments are ``bad_json``;
a tool without schema is ``unknown_tool``; missing, mistyped or unknown fields
are ``invalid``; a call that follows an unknown identifier starts a chain;
calls on or after a cycle are ``cycle`` and have no depth; a result without its
call is ``orphan``; a valid call without result is ``unanswered``; repeated
rows are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Tool schemas: field -> (JSON type, required).
SCHEMAS = {
    "answer": {"question": ("string", True), "chars": ("integer", True)},
    "summarise": {"question": ("string", True), "chars": ("integer", True), "limit": ("integer", False)},
}
_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN",
          "object": "OBJECT.*", "array": "ARRAY.*"}


def canonical(json: Column) -> Column:
    """The JSON text with sorted fields and without white space; null if it does not parse."""
    return F.to_json(F.try_parse_json(json))


def check_arguments(name: Column, arguments: Column, schemas: dict = SCHEMAS) -> Column:
    """Null if valid, else the status."""
    value = F.try_parse_json(arguments)
    out = F.lit("unknown_tool")
    for tool, fields in schemas.items():
        good = F.size(F.array_except(F.json_object_keys(arguments), F.array(*[F.lit(f) for f in fields]))) == 0
        for field, (kind, required) in fields.items():
            found = F.schema_of_variant(F.try_variant_get(value, f"$['{field}']", "variant"))
            fits = found.rlike(f"^({_TYPES[kind]})$")
            good = good & (F.coalesce(fits, F.lit(False)) if required else F.coalesce(fits, F.lit(True)))
        bad = (F.when(value.isNull(), F.lit("bad_json")).when(~F.schema_of_variant(value).startswith("OBJECT"), F.lit("invalid"))
               .when(F.coalesce(good, F.lit(False)), F.lit(None).cast("string")).otherwise(F.lit("invalid")))
        out = F.when(name == tool, bad).otherwise(out)
    return out


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth) for unique calls (conv_id, call_id, after):
    the number of calls before a call in its chain; null on or after a cycle."""
    calls = written(calls.select("conv_id", "call_id", "after"))
    known = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("known"))
    at = written(calls.join(known, ["conv_id", "after"], "left")
                 .select("conv_id", "call_id", F.when(F.col("known"), F.col("after")).alias("to"),
                         F.when(F.col("known"), 1).otherwise(0).cast("long").alias("depth")))
    most = calls.groupBy("conv_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    for _ in range(int(most).bit_length()):
        if at.where("to is not null").isEmpty():
            break
        up = at.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("up"), F.col("depth").alias("above"))
        at = written(at.join(up, ["conv_id", "to"], "left")
                     .select("conv_id", "call_id", F.col("up").alias("to"), (F.col("depth") + F.coalesce("above", F.lit(0))).alias("depth")))
    return at.select("conv_id", "call_id", F.when(F.col("to").isNull(), F.col("depth")).alias("depth"))


def quoted(c: Column) -> Column:
    """A string as JSON, null as ``null``."""
    out = F.to_json(F.array(c.cast("string")), {"ignoreNullFields": "false"})
    return out.substr(F.lit(2), F.length(out) - 2)


def message_json(kind: Column, call_id: Column, name: Column, arguments: Column, content: Column) -> Column:
    """Canonical JSON of a message; arguments that do not parse go in as a string."""
    inner = F.coalesce(canonical(arguments), quoted(arguments))
    call = F.concat(F.lit('{"role":"assistant","tool_calls":[{"function":{"arguments":'), inner, F.lit(',"name":'), quoted(name),
                    F.lit('},"id":'), quoted(call_id), F.lit(',"type":"function"}]}'))
    result = F.concat(F.lit('{"content":'), quoted(content), F.lit(',"role":"tool","tool_call_id":'), quoted(call_id), F.lit("}"))
    plain = F.concat(F.lit('{"content":'), quoted(content), F.lit(',"role":'), quoted(kind), F.lit("}"))
    return F.when(kind == "call", call).when(kind == "result", result).otherwise(plain)


def link_calls(messages: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """Messages (conv_id, turn, kind, call_id, after, name, arguments, content)
    with kind call, result or a role; to (conv_id, turn, kind, call_id, depth,
    status, json). Depth is 0 for plain messages, odd for calls and even for results."""
    key = ["conv_id", "call_id"]
    messages = messages.select(*key, "turn", "kind", "after", "name", "arguments", "content")
    calls = messages.where("kind = 'call' and call_id is not null")
    first = calls.groupBy(*key).agg(F.min(F.struct("turn", "arguments", "name", "after")).alias("f"))
    first = written(first.select(*key, "f.turn", "f.arguments", "f.after"))
    answers = (messages.where("kind = 'result' and call_id is not null").groupBy(*key).agg(F.lit(True).alias("answered")))
    linked = written(first.select(*key, F.col("turn").alias("f_turn"), F.xxhash64("arguments").alias("f_arguments"), F.lit(True).alias("found"))
                     .join(depths(first), key).join(answers, key, "left"))
    rows = messages.join(linked, key, "left")
    is_first = F.col("turn").eqNullSafe(F.col("f_turn")) & (F.xxhash64("arguments") == F.col("f_arguments"))
    call_status = (F.when(F.col("call_id").isNull(), "no_id").when(~is_first, "duplicate")
                   .when(check_arguments(F.col("name"), F.col("arguments"), schemas).isNotNull(), check_arguments(F.col("name"), F.col("arguments"), schemas))
                   .when(F.col("depth").isNull(), "cycle").when(F.col("answered").isNull(), "unanswered").otherwise("ok"))
    status = (F.when(F.col("kind") == "call", call_status)
              .when((F.col("kind") == "result") & F.col("found").isNull(), "orphan").otherwise("ok"))
    depth = (F.when(F.col("kind") == "call", F.col("depth") * 2 + 1).when(F.col("kind") == "result", F.col("depth") * 2 + 2)
             .otherwise(F.lit(0).cast("long")))
    return rows.select("conv_id", "turn", "kind", "call_id", depth.alias("depth"), status.alias("status"),
                       message_json(*[F.col(c) for c in ("kind", "call_id", "name", "arguments", "content")]).alias("json"))


def from_conversations(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) as messages: a user's turn is a call,
    after that two turns before; an assistant's turn is the result of the call
    one turn before; other roles are plain messages."""
    call_of = lambda back: F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    user, chars = F.col("role") == "user", F.coalesce(F.length("text"), F.lit(0))
    long = chars > 200
    arguments = F.concat(F.lit('{"question": '), quoted(F.col("text")), F.lit(', "chars": '), chars.cast("string"),
                         F.when(long, F.lit(', "limit": 100')).otherwise(""), F.lit("}"))
    return turns.select(
        "conv_id", "turn", F.when(user, "call").when(F.col("role") == "assistant", "result").otherwise(F.coalesce("role", F.lit(""))).alias("kind"),
        F.when(user, call_of(0)).when(F.col("role") == "assistant", call_of(1)).alias("call_id"), F.when(user, call_of(2)).alias("after"),
        F.when(user, F.when(long, "summarise").otherwise("answer")).alias("name"), F.when(user, arguments).alias("arguments"),
        F.col("text").alias("content"))


CONVERSATIONS_SQL = """
WITH RECURSIVE m AS (
  SELECT conv_id, turn, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE coalesce(role, '') END AS kind,
         CASE role WHEN 'user' THEN 'call-' || conv_id || '-' || turn WHEN 'assistant' THEN 'call-' || conv_id || '-' || (turn - 1) END AS call_id,
         CASE WHEN role = 'user' THEN 'call-' || conv_id || '-' || (turn - 2) END AS after,
         CASE WHEN length(text) > 200 THEN 'summarise' ELSE 'answer' END AS name,
         '{"chars":' || coalesce(length(text), 0) || CASE WHEN length(text) > 200 THEN ',"limit":100' ELSE '' END
           || ',"question":' || coalesce(to_json(text)::VARCHAR, 'null') || '}' AS arguments,
         text, coalesce(to_json(text)::VARCHAR, 'null') AS content
  FROM conversations),
first AS (SELECT DISTINCT ON (conv_id, call_id) conv_id, call_id, turn, arguments, after FROM m WHERE kind = 'call'
          ORDER BY conv_id, call_id, turn, content, length(text)),
d AS (
  SELECT f.conv_id, f.call_id, CAST(0 AS BIGINT) AS depth FROM first f
  WHERE NOT EXISTS (SELECT 1 FROM first g WHERE g.conv_id = f.conv_id AND g.call_id = f.after)
  UNION ALL
  SELECT f.conv_id, f.call_id, d.depth + 1 FROM first f JOIN d ON d.conv_id = f.conv_id AND d.call_id = f.after),
answered AS (SELECT DISTINCT conv_id, call_id FROM m WHERE kind = 'result')
SELECT m.conv_id, m.turn, m.kind, m.call_id,
       CASE m.kind WHEN 'call' THEN d.depth * 2 + 1 WHEN 'result' THEN d.depth * 2 + 2 ELSE 0 END AS depth,
       CASE WHEN m.kind = 'call' THEN CASE WHEN m.arguments <> f.arguments OR m.turn IS DISTINCT FROM f.turn THEN 'duplicate'
                                           WHEN m.text IS NULL THEN 'invalid' WHEN a.call_id IS NULL THEN 'unanswered' ELSE 'ok' END
            WHEN m.kind = 'result' AND f.call_id IS NULL THEN 'orphan' ELSE 'ok' END AS status,
       CASE m.kind WHEN 'call' THEN '{"role":"assistant","tool_calls":[{"function":{"arguments":' || m.arguments || ',"name":"' || m.name
                                    || '"},"id":"' || m.call_id || '","type":"function"}]}'
                   WHEN 'result' THEN '{"content":' || m.content || ',"role":"tool","tool_call_id":"' || m.call_id || '"}'
                   ELSE '{"content":' || m.content || ',"role":"' || m.kind || '"}' END AS json
FROM m LEFT JOIN first f ON f.conv_id = m.conv_id AND f.call_id = m.call_id
       LEFT JOIN d ON d.conv_id = m.conv_id AND d.call_id = m.call_id
       LEFT JOIN answered a ON a.conv_id = m.conv_id AND a.call_id = m.call_id
"""
