"""Column builders shared by batch and streaming jobs.

Every helper returns a ``Column`` made of built-in functions so it stays in
whole-stage generated code; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token source priorities, best first (unlisted sources = 5).
TOKEN_SOURCE_PRIORITY = {
    "response_usage": 0,
    "orphan_response_usage": 1,
    "gemini_cli_stdout_stats": 2,
    "claude_telemetry": 3,
    "agent_native_session": 4,
}

# open(2) flag bits used by the writable-open test.
O_ACCMODE = 0o3
O_CREAT = 0o100
O_TRUNC = 0o1000
O_APPEND = 0o2000


def token_source_priority(source: Column) -> Column:
    expr = None
    for name, prio in TOKEN_SOURCE_PRIORITY.items():
        expr = (F.when(source == name, F.lit(prio)) if expr is None
                else expr.when(source == name, F.lit(prio)))
    return expr.otherwise(F.lit(5))


def empty_to_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))


def is_writable_open(flags: Column) -> Column:
    """F8: ``flags & O_ACCMODE != 0 or flags & (O_CREAT|O_TRUNC|O_APPEND) != 0``."""
    f = F.coalesce(flags.cast("bigint"), F.lit(0))
    return ((f.bitwiseAND(O_ACCMODE) != 0)
            | (f.bitwiseAND(O_CREAT | O_TRUNC | O_APPEND) != 0))


def file_directory(path: Column) -> Column:
    """Parent directory of a path: ``/`` for a name at the root, ``.`` for a bare name."""
    bare = F.regexp_replace(path, r"(?<=.)/+$", "")
    up = F.regexp_replace(F.regexp_extract(bare, r"^(.*?)/+[^/]*$", 1), r"(?<=.)/+$", "")
    return (F.when(~bare.contains("/") | (bare == "/"), F.lit(".")).when(up == "", F.lit("/")).otherwise(up))


def short_hash(text: Column, n: int = 12) -> Column:
    """First ``n`` hex chars of sha256."""
    return F.substring(F.sha2(text, 256), 1, n)


# Unicode control characters other than \n, \r and \t make a payload binary.
_BINARY_CHARS = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]"


def detect_data_type(text: Column) -> Column:
    """X8: 'text' unless the string holds control characters, then 'binary'."""
    return F.when(F.coalesce(text, F.lit("")).rlike(_BINARY_CHARS), F.lit("binary")).otherwise(F.lit("text"))


def data_to_string(text: Column) -> Column:
    """Text as is; binary as 'HEX:' + lower-case hex of its UTF-8 bytes."""
    return F.when(detect_data_type(text) == "text", text).otherwise(
        F.concat(F.lit("HEX:"), F.lower(F.hex(F.encode(text, "UTF-8")))))


def short_session_id(sid: Column) -> Column:
    """Last path component without '.jsonl'; longer than 12 characters →
    first 6 + '.' + last 5; empty → 'session'."""
    t = F.trim(F.coalesce(sid, F.lit("")))
    comp = F.element_at(F.split(t, r"[/\\]"), -1)
    comp = F.regexp_replace(comp, r"(\.jsonl)+$", "")
    short = F.when(F.char_length(comp) <= 12, comp).otherwise(
        F.concat(F.substring(comp, 1, 6), F.lit("."), F.substring(comp, -5, 5)))
    return F.when(t == "", F.lit("session")).otherwise(short)


def sanitize_identifier(value: Column) -> Column:
    """Every character outside ASCII letters and digits becomes '-'."""
    return F.regexp_replace(value, "[^A-Za-z0-9]", "-")


# Agent executable names and package paths that identify an agent.
AGENT_EXEC_NAMES = [("claude", "claude"), ("claude-code", "claude"), ("codex", "codex"), ("codex-cli", "codex"),
                    ("gemini", "gemini"), ("gemini-cli", "gemini"), ("opencode", "opencode"), ("aider", "aider"),
                    ("goose", "goose"), ("openclaw", "openclaw")]
AGENT_PACKAGE_PATHS = [(["@anthropic-ai/claude-code", "/claude-code/"], "claude"),
                       (["@openai/codex", "/codex-linux-"], "codex"),
                       (["@google/gemini-cli", "/gemini-cli/"], "gemini")]
_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LO = "abcdefghijklmnopqrstuvwxyz"


def _exec_token_label(token: Column) -> Column:
    t = F.regexp_replace(token, "^['\"]+|['\"]+$", "")
    low = F.translate(t, _UP, _LO)
    base = F.try_element_at(F.split(low, "/"), F.lit(-1))
    e = None
    for name, label in AGENT_EXEC_NAMES:
        e = F.when(base == name, label) if e is None else e.when(base == name, label)
    e = e.when(base.startswith("openclaw-"), "openclaw")
    for needles, label in AGENT_PACKAGE_PATHS:
        cond = None
        for n in needles:
            c = low.contains(n)
            cond = c if cond is None else cond | c
        e = e.when(cond, label)
    return F.when(t != "", e)


def known_agent_label(comm: Column, command: Column) -> Column:
    """A known agent from the comm or the command line (argv0, else the first
    path-like argument), else null."""
    toks = F.filter(F.split(F.trim(F.coalesce(command, F.lit(""))), r"\s+"), lambda x: x != "")
    argv0 = _exec_token_label(F.try_element_at(toks, F.lit(1)))
    rest = F.filter(F.slice(toks, F.lit(2), F.size(toks)),
                    lambda x: F.regexp_replace(x, "^['\"]+|['\"]+$", "").contains("/"))
    rest_label = F.try_element_at(F.filter(F.transform(rest, _exec_token_label), lambda x: x.isNotNull()), F.lit(1))
    return F.coalesce(_exec_token_label(F.coalesce(comm, F.lit(""))), F.when(F.size(toks) > 0, F.coalesce(argv0, rest_label)))


def agent_label(comm: Column, command: Column) -> Column:
    """A known agent, else the comm (unless empty/'unknown'), else the
    first word of the command, else 'agent'."""
    toks = F.filter(F.split(F.trim(F.coalesce(command, F.lit(""))), r"\s+"), lambda x: x != "")
    c = F.coalesce(comm, F.lit(""))
    return F.coalesce(known_agent_label(comm, command), F.when((c != "") & (c != "unknown"), c),
                      F.when(F.size(toks) > 0, F.try_element_at(toks, F.lit(1))), F.lit("agent"))


def tree_event_type(audit_type: Column, action: Column) -> Column:
    """prompt/response (llm), file, process, stdio, system, else ssl."""
    return (F.when(audit_type == "llm", F.when(action == "request", "prompt").otherwise("response"))
            .when(audit_type.isin("file", "process", "stdio", "system"), audit_type).otherwise("ssl"))


def event_name(audit_type: Column, action: Column) -> Column:
    """EXEC / EXIT / upper-cased process action, FILE_WRITE, LLM_CALL,
    else the upper-cased audit type."""
    return (F.when(audit_type == "process", F.when(action == "exec", "EXEC").when(action == "exit", "EXIT")
                   .otherwise(F.upper(F.coalesce(action, F.lit("PROCESS")))))
            .when(audit_type == "file", "FILE_WRITE").when(audit_type == "llm", "LLM_CALL")
            .otherwise(F.upper(audit_type)))


def event_search_text(*cols: Column) -> Column:
    """The non-empty fields joined by spaces, lower-cased."""
    return F.lower(F.concat_ws(" ", *[F.nullif(c.cast("string"), F.lit("")) for c in cols]))
