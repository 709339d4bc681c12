"""Transcript dialects: hand-made lines and documents with every special case."""

import json
import os
import uuid

import pytest

from traceframe.operators import dialects as D

R = "/h/.codex/sessions/2026/r1.jsonl"
LINES, DOCS = "file string, line_no long, line string", "file string, document string"


def _lines(spark, rows, file=R):
    return spark.createDataFrame([(file, i, x if isinstance(x, str) or x is None else json.dumps(x)) for i, x in enumerate(rows)], LINES)


def _event(kind, **payload):
    return {"type": "event_msg", "timestamp": "2026-01-01T00:00:00.500Z", "payload": {"type": kind, **payload}}


def _item(kind, **payload):
    return {"type": "response_item", "payload": {"type": kind, **payload}}


def _usage(total, **more):
    return {"info": {"last_token_usage": {"input_tokens": total - 1, "output_tokens": 1, "total_tokens": total}, **more}}


def test_rollout_reports_models_and_calls(spark):
    rows = [
        _event("token_count", **_usage(5)),                                     # 0 no response yet: a row of its own
        {"type": "turn_context", "payload": {"model": "m1", "session_id": "s1"}},
        _event("user_message", message="  do\n it "),                           # 2
        _event("agent_message", message="first"),                               # 3 filled by 5
        _event("token_count", info=None),                                       # 4 nothing to count
        _event("token_count", **_usage(7)),                                     # 5
        _event("token_count", **_usage(9)),                                     # 6 second report: own row
        {"type": "turn_context", "payload": {"model": "m2"}},
        _item("message", content="second"),                                     # 8 stays without tokens
        _item("function_call", name="shell.exec_command", arguments='{"cmd":"ls -la"}', call_id="a"),
        _item("function_call", arguments="not json", call_id="b"),
        _item("function_call", name="x", arguments={"path": "/p"}),
        _item("function_call_output", call_id="a", output="Process exited with code 1"),
        _item("function_call_output", call_id="a", output="Process exited with code 0"),
        {"type": "message", "content": [{"text": "deep"}, {"type": "tool_result", "content": "no"}, {"content": [{"text": "er"}]}]},
        {"type": "user_input", "text": "not the first prompt"},
        _event("user_message", message="   "), "{broken", "[1]", "", None,
    ]
    prompts, tools, llm = D.rollout_events(_lines(spark, rows))
    assert [(r.session_id, r.position, r.text) for r in prompts.orderBy("position").collect()] == [("s1", 2, "do it"), ("s1", 14, "deep er")]
    assert prompts.first().timestamp_ms == 1767225600500
    got = [(r.position, r.model, r.total_tokens, r.input_tokens) for r in llm.orderBy("position").collect()]
    assert got == [(0, "codex", 5, 4), (3, "m1", 7, 6), (6, "m1", 9, 8), (8, "m2", 0, 0)]
    got = [(r.tool_name, r.command, r.status, r.input_path) for r in tools.orderBy("position").collect()]
    assert got == [("shell.exec_command", "ls -la", "ok", None), ("?", "not json", "observed", None), ("x", "/p", "observed", "/p")]


def test_unknown_user_line_is_a_prompt_only_as_the_first(spark):
    first = [{"type": "user_input", "text": "one"}, {"type": "user_input", "text": "two"}, _event("user_message", message="three")]
    prompts, _, _ = D.rollout_events(_lines(spark, first))
    assert [(r.session_id, r.text) for r in prompts.orderBy("position").collect()] == [("r1", "one"), ("r1", "three")]


def test_counters_that_begin_anew(spark):
    def report(i, o):
        return _event("token_count", info={"total_token_usage": {"input_tokens": i, "output_tokens": o, "total_tokens": i + o}})
    context = {"type": "turn_context", "payload": {"model": "m1"}}
    rows = D.rollout_usage(_lines(spark, [report(10, 1), context, report(30, 2), report(5, 1), report(6, 3)])).orderBy("model").collect()
    assert [(r.model, r.input_tokens, r.total_tokens, r.added_input_tokens, r.added_total_tokens) for r in rows] == [
        ("m1", 6, 9, 26, 30), ("unknown", 10, 11, 10, 11)]


def test_document(spark):
    doc = {"sessionId": "d1", "messages": [
        {"type": "user", "content": [{"text": "a"}, {"text": "b"}]},
        {"type": "gemini", "timestamp": "2026-01-01T00:00:01Z", "model": "f", "content": [{"type": "thinking", "thinking": "hm"}, "x", {"type": "tool_use", "text": "n"}],
         "tokens": {"input": 3, "output": -2, "total": 4}, "toolCalls": [{"name": "read_file", "id": "t", "args": {"file_path": "/f"}}, {}]},
        {"type": "model", "text": " "}, {"type": "assistant", "text": "alone"}, {"type": "info", "content": "skip"}]}
    rows = [("/h/.gemini/tmp/chats/session-1.json", json.dumps(doc)), ("/q/session-2.json", "{}"), ("/q/session-3.json", "no"), ("/q/session-4.json", None),
            ("/q/session-5.json", '{"messages":[{"type":"user","content":"z"}]}')]
    prompts, tools, llm = D.document_events(spark.createDataFrame(rows, DOCS))
    assert {(r.session_id, r.position, r.text) for r in prompts.collect()} == {("d1", 0, "a b"), ("session-5", 0, "z")}
    assert [(r.position, r.model, r.input_tokens, r.output_tokens, r.total_tokens) for r in llm.orderBy("position").collect()] == [
        (1, "f", 3, 0, 4), (3, "gemini", 0, 0, 0)]
    assert {(r.tool_name, r.input_path, r.status) for r in tools.collect()} == {("read_file", "/f", "observed"), ("?", None, "observed")}


def test_all_dialects_by_path_and_empty_tables(spark):
    said = json.dumps({"type": "user", "sessionId": "c1", "message": {"content": "hello"}})
    lines = spark.createDataFrame([("/h/.claude/projects/a.jsonl", 0, said), (R, 0, json.dumps(_event("user_message", message="hi"))),
                                   ("/tmp/other.jsonl", 0, said)], LINES)
    docs = spark.createDataFrame([("/h/.gemini/x/chats/session-9.json", '{"messages":[{"type":"user","content":"hey"}]}')], DOCS)
    got = {(r.dialect, r.session_id, r.text) for r in D.transcript_events(lines, docs)[0].collect()}
    assert got == {("messages", "c1", "hello"), ("rollout", "r1", "hi"), ("document", "session-9", "hey")}
    empty = D.transcript_events(lines.limit(0), docs.limit(0))
    assert [t.count() for t in empty] == [0, 0, 0]
    assert D.rollout_usage(lines.limit(0)).count() == 0


@pytest.mark.parametrize("newest,want", [(None, 3), (2, 2)])
def test_discovery(spark, tmp_path, newest, want):
    names = [".claude/projects/a.jsonl", ".codex/sessions/b.jsonl", ".gemini/tmp/chats/session-c.json", ".gemini/tmp/session-d.json", ".gemini/tmp/chats/e.json", "notes.txt"]
    for n in names:
        os.makedirs(os.path.dirname(tmp_path / n), exist_ok=True)
        (tmp_path / n).write_text('{"messages":[]}' + uuid.uuid4().hex)
    files = D.transcript_files(spark, D.home_roots(str(tmp_path)), newest).collect()
    assert len(files) == want and {f.dialect for f in files} <= {"messages", "rollout", "document"}
    if newest is None:
        assert {r.file.split("/")[-1] for r in D.read_documents(spark, D.home_roots(str(tmp_path))).collect()} == {"session-c.json", "session-d.json"}


def test_time_profile_with_tools(spark):
    from traceframe.operators import profiles as PR
    sessions = spark.createDataFrame([("s", "a", "fix")], "session_id string, agent string, session_tag string")
    prompts = spark.createDataFrame([("s", 0, 0, 1000, "ask")], "session_id string, position long, prompt_index long, timestamp_ms long, tag string")
    llm = spark.createDataFrame([("s", 4, 0, 9000, "say", "v/m")],
                                "session_id string, position long, prompt_index long, timestamp_ms long, tag string, model string")
    tools = spark.createDataFrame([("s", 1, 0, 3000, "Bash", "shell", "bash", ["bash", "cargo"]), ("s", 2, 0, 6000, "Bash", "shell", "", None),
                                   ("s", 3, 0, None, "Edit", "edit", "edit", [])],
                                  "session_id string, position long, prompt_index long, timestamp_ms long, tool_name string, category string, "
                                  "command_name string, process_chain array<string>")
    got = {r.stack: r.weight for r in PR.fold_stacks(PR.time_profile_samples(sessions, prompts, llm, "p", tools)).collect()}
    base = "project:p;agent:a;session:fix;prompt:ask"
    assert got == {f"{base};kind:prompt": 2, f"{base};kind:tool;tool:bash;cmd:bash;proc:bash;proc:cargo": 3, f"{base};kind:tool;tool:bash": 3,
                   f"{base};kind:llm;call:llm/say;model:m": 1}
