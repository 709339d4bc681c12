"""Golden cases of the reference's unit tests, re-expressed as DataFrame tests."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from traceframe.functions import exprs as X
from traceframe.functions.scan import next_value, running_last, running_sum
from traceframe.operators import audit as A
from traceframe.operators import process as P
from traceframe.operators import profiles as PR
from traceframe.operators import sessions as S
from traceframe.operators import tokens as T
from traceframe.operators import traffic as H

TOKEN_SCHEMA = ("id string, llm_call_id string, timestamp_ms bigint, pid bigint, comm string, provider string, "
                "model string, input_tokens bigint, output_tokens bigint, cache_creation_tokens bigint, "
                "cache_read_tokens bigint, total_tokens bigint, source string, confidence double")
CALL_SCHEMA = "id string, seq bigint, session_id string, pid bigint, start_timestamp_ms bigint"
SESSION_SCHEMA = "id string, cwd string"
NODE_SCHEMA = "id string, pid bigint, cwd string"


def tok(spark, rows):
    return spark.createDataFrame(rows, TOKEN_SCHEMA)


def test_token_priority_prefers_response_usage(spark):
    tokens = tok(spark, [
        ("t1", "call-1", 1, 1, "c", "p", "m", 10, 5, 0, 0, 15, "response_usage", None),
        ("t2", "call-1", 2, 1, "c", "p", "m", 100, 50, 0, 0, 150, "agent_native_session", 0.9),
    ])
    calls = spark.createDataFrame([("call-1", 1, "s1", 1, 1)], CALL_SCHEMA)
    sess = spark.createDataFrame([("s1", "")], SESSION_SCHEMA)
    out = T.token_summary(tokens, calls, sess, None, "model").collect()
    assert [(r["group"], r["total_tokens"], r["calls"]) for r in out] == [("m", 15, 1)]


def test_effective_tokens_one_row_per_key(spark):
    rows = []
    for i in range(200):
        rows.append((f"t{i}", f"call-{i % 17}" if i % 5 else "", i, 1, "c", "p", "m", i, 1, 0, 0, i + 1,
                     random.choice(["response_usage", "claude_telemetry", "other"]), random.random()))
    eff = T.effective_tokens(tok(spark, rows))
    keys = eff.groupBy("token_key").count().where("count > 1").count()
    assert keys == 0
    assert eff.count() == 17 + 40  # 17 call ids + 40 rows without a call id


def test_tokens_by_dir_session_prefix(spark):
    tokens = tok(spark, [
        ("t1", "sess-1-a", 1, None, "c", "p", "m", 10, 4, 1, 2, 17, "response_usage", None),
        ("t2", "sess-1-b", 2, None, "c", "p", "m", 7, 3, 1, 2, 13, "response_usage", None),
    ])
    calls = spark.createDataFrame([], CALL_SCHEMA)
    sess = spark.createDataFrame([("sess-1", "/repo/one"), ("sess", "/repo/other")], SESSION_SCHEMA)
    nodes = spark.createDataFrame([], NODE_SCHEMA)
    out = T.token_summary(tokens, calls, sess, nodes, "dir").collect()
    r = out[0]
    # 'sess' is also a dash-prefix of 'sess-1-a'; the smallest matching id wins
    assert len(out) == 1 and r["group"] == "/repo/other"
    sess2 = spark.createDataFrame([("sess-1", "/repo/one")], SESSION_SCHEMA)
    r = T.token_summary(tokens, calls, sess2, nodes, "dir").collect()[0]
    assert (r["group"], r["input_tokens"], r["output_tokens"], r["cache_creation_tokens"],
            r["cache_read_tokens"], r["total_tokens"], r["calls"], r["sessions"]) == \
        ("/repo/one", 17, 7, 2, 4, 30, 2, 1)


def test_tokens_by_dir_process_and_missing(spark):
    tokens = tok(spark, [
        ("t1", "call-1", 1, 42, "c", "p", "m", 20, 4, 0, 0, 24, "response_usage", None),
        ("t2", "", 2, 7, "c", "p", "m", 5, 5, 0, 0, 10, "response_usage", None),
    ])
    calls = spark.createDataFrame([("call-1", 1, "s-1", 42, 1)], CALL_SCHEMA)
    sess = spark.createDataFrame([("s-1", "")], SESSION_SCHEMA)
    nodes = spark.createDataFrame([("process-42-1", 42, "/repo/saved")], NODE_SCHEMA)
    out = {r["group"]: (r["total_tokens"], r["sessions"])
           for r in T.token_summary(tokens, calls, sess, nodes, "dir").collect()}
    assert out == {"/repo/saved": (24, 1), "unknown": (10, 0)}


def test_pid_reuse_gets_new_instance(spark):
    canon = spark.createDataFrame([
        (1, 1000, 42, "EXEC"), (2, 2000, 42, "EXIT"), (3, 3000, 42, "EXEC"), (4, 500, 7, "EXIT")],
        "seq bigint, timestamp_ms bigint, pid bigint, event string")
    ids = {r["seq"]: r["instance_id"] for r in P.process_instances(canon, bucket_ms=1000).collect()}
    assert ids[1] == ids[2] == "process-42-1000"
    assert ids[3] == "process-42-3000"
    assert ids[4] == "process-7-500"  # lone EXIT gets its own id


def test_writable_open_flags(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (0o100,), (0o1000,), (0o2000,), (0o4000,)], "flags bigint")
    got = [r[0] for r in df.select(X.is_writable_open(F.col("flags"))).collect()]
    assert got == [False, True, True, True, True, True, False]


def test_time_stack_weights(spark):
    ev = spark.createDataFrame([("s", 1000, 0, 0), ("s", 3000, 1, 1), ("s", 8000, 2, 2)],
                               "session_id string, timestamp_ms bigint, kind_rank int, position bigint")
    got = [r["duration_s"] for r in S.event_durations(ev, block_ms=2000).orderBy("timestamp_ms").collect()]
    assert got == [2, 5, 1]


def test_safe_frame(spark):
    df = spark.createDataFrame([("Hello World!",), ("__x__",), ("",), ("a/b:c+d",), ("Ünïcode",)], "t string")
    got = [r[0] for r in df.select(PR.safe_frame_value(F.col("t"))).collect()]
    assert got == ["hello_world", "x", "unknown", "a/b:c+d", "n_code"]


def test_flame_tree_conserves_totals(spark):
    stacks = spark.createDataFrame([("a;b;c", 3), ("a;b", 2), ("a;d", 5), ("e", 1)], "stack string, weight bigint")
    tree = PR.flame_tree(stacks)
    top = tree.where("depth = 1").agg(F.sum("value")).first()[0]
    assert top == 11
    vals = {r["node"]: r["value"] for r in tree.collect()}
    assert vals["a"] == 10 and vals["a;b"] == 5 and vals["a;b;c"] == 3


def test_edge_samples_top_bottom_disjoint(spark):
    df = spark.createDataFrame([(1, f"h{i:02d}", i) for i in range(20)] + [(2, "x", 1), (2, "y", 2)],
                               "g int, key string, score int")
    out = A.edge_samples(df, ["g"], "score", "key", 5).collect()
    g1 = [r for r in out if r["g"] == 1]
    assert sorted(r["score"] for r in g1 if r["rank_kind"] == "top") == [15, 16, 17, 18, 19]
    assert sorted(r["score"] for r in g1 if r["rank_kind"] == "bottom") == [0, 1, 2, 3, 4]
    assert {r["rank_kind"] for r in out if r["g"] == 2} == {"all"}


def test_normalize_path(spark):
    df = spark.createDataFrame([("/v1/users/123/items?x=1",),
                                ("/a/550e8400-e29b-41d4-a716-446655440000/b",),
                                ("/h/abcdefabcdefabcdefabcdef01",)], "p string")
    got = [r[0] for r in df.select(H.normalize_path(F.col("p"))).collect()]
    assert got == ["/v1/users/{{id}}/items", "/a/{{uuid}}/b", "/h/{{hash}}"]


def test_http_parse_and_auth_strip(spark):
    txt = "POST /v1/messages?beta=1 HTTP/1.1\r\nHost: api.example.com\r\nAuthorization: Bearer x\r\n" \
          "Content-Type: application/json\r\n\r\n{\"a\": 1}"
    df = spark.createDataFrame([(1, txt)], "seq bigint, payload string")
    r = H.strip_auth_headers(H.parse_http(df)).first()
    assert (r["method"], r["path"], r["protocol"]) == ("POST", "/v1/messages?beta=1", "HTTP/1.1")
    assert r["headers"] == {"host": "api.example.com", "content-type": "application/json"}
    assert r["body"] == "{\"a\": 1}"


def test_pair_by_tid_last_request_wins(spark):
    rows = [(1, 1, "request", 100, "GET", "/a", "h", None, None, ""), (2, 1, "request", 200, "GET", "/b", "h", None, None, ""),
            (3, 1, "response", 300, None, None, "h", 200, "t", "x"), (4, 1, "response", 400, None, None, "h", 200, "t", "y")]
    df = spark.createDataFrame(rows, "seq bigint, tid bigint, message_type string, timestamp_ms bigint, method string, "
                                     "path string, host string, status_code int, content_type string, body string")
    pairs = H.pair_by_tid(df).collect()
    assert [(p["req_seq"], p["resp_seq"]) for p in pairs] == [(2, 3)]


def _rand_df(spark, n=500):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 3), i, rnd.randint(0, 10_000), rnd.choice([None, None, rnd.randint(0, 9)]))
            for i in range(n)]
    return spark.createDataFrame(rows, "k int, seq int, t bigint, v int")


def test_running_scans_match_plain_windows(spark):
    df = _rand_df(spark)
    w = Window.partitionBy("k").orderBy("t", "seq")
    wr = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = df.select("seq", F.sum(F.coalesce("v", F.lit(0))).over(wr).alias("s"),
                      F.last("v", ignorenulls=True).over(wr).alias("l"),
                      F.lead("t").over(w).alias("n"))
    rs = running_sum(df, ["k"], F.expr("t div 700"), ["t", "seq"], F.coalesce("v", F.lit(0)), "s")
    rl = running_last(df, ["k"], F.expr("t div 700"), ["t", "seq"], F.col("v"), "l")
    nv = next_value(df, ["k"], F.expr("t div 700"), ["t", "seq"], "t", "n")
    got = rs.select("seq", "s").join(rl.select("seq", "l"), "seq").join(nv.select("seq", "n"), "seq")
    a = sorted(tuple(r) for r in plain.collect())
    b = sorted(tuple(r) for r in got.select("seq", "s", "l", "n").collect())
    assert a == b


def test_prompt_index_reactivates_repeated_prompt(spark):
    log = spark.createDataFrame([
        ("s", 0, "prompt", "h0"), ("s", 1, "llm", "r1"), ("s", 2, "prompt", "h1"),
        ("s", 3, "llm", "r2"), ("s", 4, "prompt", "h0"), ("s", 5, "llm", "r3")],
        "session_id string, position bigint, kind string, text_hash string")
    got = [r["prompt_index"] for r in S.assign_prompt_index(log, block=2).orderBy("position").collect()]
    assert got == [0, 0, 1, 1, 0, 0]


def test_tag_rules_and_presets(spark):
    df = spark.createDataFrame([("Please FIX the parser",), ("why?",), ("nothing here",)], "t string")
    rules = S.parse_rules(["prompt:question=\\?$"])
    got = [r[0] for r in df.select(S.tag_expr("prompt", F.col("t"), rules, True)).collect()]
    assert got == ["debug", "question", "unmatched"]


def test_http_filter_expressions(spark):
    from traceframe.functions.filters import compile_http_filter
    rows = [("request", "GET", "/health", None), ("request", "POST", "/api?x=1", None),
            ("response", None, None, 404), ("response", None, None, 200)]
    df = spark.createDataFrame(rows, "message_type string, method string, path string, status_code int") \
        .withColumn("headers", F.create_map()).withColumn("body", F.lit(""))

    def hits(expr):
        return [r[0] for r in df.select(compile_http_filter(expr)).collect()]
    assert hits("request.path=/health") == [True, False, False, False]
    assert hits("request.method=GET") == [True, False, False, False]
    assert hits("response.status_code=404") == [False, False, True, False]
    assert hits("request.method=GET | response.status_code=404") == [True, False, True, False]
    assert hits("x=1") == [False, True, False, False]
    assert hits("") == [False, False, False, False]


def test_sse_round_trip_and_chunked(spark):
    from traceframe.operators import sse as SSE
    from traceframe.sources import fixtures as FX
    sf = "/root/testdata/sf0.001"
    merged = SSE.reassemble_sse(SSE.sse_events(FX.sse_bodies(spark, sf)))
    got = {r["first_seq"]: (r["text"], r["complete"]) for r in merged.collect()}
    conv = FX.read_table(spark, sf, "conversations").where("role = 'assistant'").collect()
    want = {r["conv_id"] * 1000 + r["turn"]: r["text"] for r in conv}
    assert {k: v[0] for k, v in got.items()} == want
    assert all(v[1] for v in got.values())
    body = "1a\r\nevent: ping\ndata: [DONE]\n\r\n0\r\n\r\n"
    df = spark.createDataFrame([(body,)], "body string")
    ev = SSE.sse_events(df).collect()
    assert [(r["event"], r["data"], r["is_json"]) for r in ev] == [("ping", "[DONE]", False)]


def test_cluster_tags_invariants(spark):
    import re
    from traceframe.operators import tagging as TG
    from traceframe.sources import fixtures as FX
    prompts = FX.session_log(spark, "/root/testdata/sf0.001").where("kind = 'prompt'").select("text")
    out = TG.tag_cluster(prompts, "text", k=3).collect()
    assert len(out) == prompts.where("length(trim(text)) >= 3").count()
    assert all(re.fullmatch(r"[^\W_]{3,12}|cluster\d+", r["tag"]) for r in out)
    assert {r["cluster"] for r in out} <= {0, 1, 2}


def test_prompt_line_diff(spark):
    from traceframe.operators.sessions import line_diff_counts, prompt_diffs
    assert line_diff_counts("a\nb\nc", "a\nx\nc\nd") == (2, 1)
    assert line_diff_counts("same", "same") == (0, 0)
    assert line_diff_counts("", "x") is None
    df = spark.createDataFrame([("s", 0, "a\nb"), ("s", 1, "a\nb\nc"), ("s", 2, "c"), ("t", 0, "z")],
                               "session_id string, position bigint, text string")
    got = sorted((r["position"], r["added_lines"], r["removed_lines"]) for r in prompt_diffs(df, block=2).collect())
    assert got == [(1, 1, 0), (2, 0, 2)]


def test_line_diff_against_the_full_table_and_long_prompts():
    import random
    import time

    from traceframe.operators.sessions import line_diff_counts
    rng = random.Random(2)
    for _ in range(300):
        a, b = (["".join(rng.choice("abc") for _ in range(rng.randint(0, 2))) for _ in range(rng.randint(1, 14))] for _ in range(2))
        x, y = [t for t in a if t], [t for t in b if t]
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, s in enumerate(x):
            for j, t in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if s == t else max(best[i][j + 1], best[i + 1][j])
        kept = best[-1][-1]
        got = line_diff_counts("\n".join(a), "\n".join(b))
        assert got == (None if not "\n".join(a) or not "\n".join(b) else (len(y) - kept, len(x) - kept))
    lines = [f"line {i}" for i in range(100_000)]
    other = list(lines)
    for _ in range(2_000):
        other[rng.randrange(len(other))] = "changed"
    other = other[30_000:] + other[:30_000]
    t0 = time.time()
    added, removed = line_diff_counts("\n".join(lines), "\n".join(other))
    assert added == removed and 30_000 <= added < 34_000 and time.time() - t0 < 60


def test_sse_chunks_join_their_response(spark):
    from traceframe.operators import sse as SSE

    def delta(t):
        return f'event: content_block_delta\ndata: {{"delta":{{"type":"text_delta","text":"{t}"}}}}\n\n'

    stream, own = "text/event-stream", delta("own ")
    rows = [("m", 1, 0, 1, "request", None, "q"), ("m", 2, 100, 1, "response", stream, f"{len(own):x}\r\n{own}\r\n0\r\n\r\n"),
            ("m", 3, 5_100, 1, "sse_chunk", None, delta("a") + delta("b")), ("m", 4, 10_100, 1, "sse_chunk", None, delta("c")),
            ("m", 5, 15_101, 1, "sse_chunk", None, delta("late")), ("m", 6, 15_200, 1, "sse_chunk", None, delta("none")),
            ("m", 7, 16_000, 2, "response", stream, None), ("m", 8, 16_100, 1, "sse_chunk", None, delta("other thread")),
            ("m", 9, 16_200, 2, "sse_chunk", None, delta("ended")), ("m", 10, 17_000, 1, "response", "text/html", "<p>"),
            ("m", 11, 17_100, 1, "sse_chunk", None, delta("no stream")), ("n", 1, 16_050, 2, "response", stream, "x"),
            ("n", 2, 16_060, 2, "sse_chunk", None, delta('{\\"k\\": 1}'))]
    df = spark.createDataFrame(rows, "machine string, seq long, timestamp_ms long, tid long, type string, content_type string, body string")
    for bucket in (50, 3_600_000):
        out = {(r.machine, r.seq): (r.body, r.chunks, r.end_ms, r.is_json) for r in SSE.merge_sse_chunks(df, bucket_ms=bucket, scope=["machine"]).collect()}
        assert out == {("m", 1): ("q", 0, 0, False), ("m", 2): ("own abc", 2, 10_100, False), ("m", 7): (None, 0, 16_000, False),
                       ("m", 10): ("<p>", 0, 17_000, False), ("n", 1): ('{"k": 1}', 1, 16_060, True)}


def test_usage_shapes(spark):
    from traceframe.operators import canonical as CN
    bodies = ['{"usage":{"prompt_tokens": 3, "completion_tokens": 4}}',
              '{"usage":{"input_tokens": 5, "output_tokens": 6, "cache_read_input_tokens": 2}}',
              '{"usageMetadata":{"promptTokenCount": 11, "candidatesTokenCount": 4, "totalTokenCount": 15}}',
              '{"usageMetadata":{"promptTokenCount": 11, "candidatesTokenCount": 4, "thoughtsTokenCount": 5}}',
              '{"usage":{"input_tokens": "12"}}', 'not json']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    r = {x["i"]: x for x in CN.token_usage(df).collect()}
    assert r[0]["total_tokens"] == 7
    assert (r[1]["usage"]["input_tokens"], r[1]["usage"]["output_tokens"], r[1]["usage"]["cache_read_tokens"]) == (5, 6, 2)
    assert (r[2]["usage"]["input_tokens"], r[2]["usage"]["output_tokens"], r[2]["total_tokens"]) == (11, 4, 15)
    assert (r[3]["usage"]["output_tokens"], r[3]["total_tokens"]) == (9, 20)
    assert r[4]["usage"]["input_tokens"] == 0  # numeric strings are not token counts
    assert r[5]["total_tokens"] == 0
    sse = spark.createDataFrame([("m", '{"usageMetadata":{"promptTokenCount":11,"candidatesTokenCount":4,"totalTokenCount":15}}'),
                                 ("m", '{"type":"ping"}')], "k string, data string")
    u = CN.sse_usage(sse, ["k"]).first()
    assert (u["input_tokens"], u["output_tokens"], u["total_tokens"]) == (11, 4, 15)


def test_agent_labels_and_short_ids(spark):
    rows = [("node", "node /opt/npm/@anthropic-ai/claude-code/cli.js"), ("unknown", "\"/usr/bin/codex-cli\" exec"),
            ("bash", "bash -c ls"), ("", ""), ("openclaw-x", "")]
    df = spark.createDataFrame(rows, "comm string, command string")
    got = [r[0] for r in df.select(X.agent_label(F.col("comm"), F.col("command"))).collect()]
    assert got == ["claude", "codex", "bash", "agent", "openclaw"]
    ids = spark.createDataFrame([("/a/b/0123456789abcdef.jsonl",), ("short.jsonl",), ("  ",)], "s string")
    assert [r[0] for r in ids.select(X.short_session_id(F.col("s"))).collect()] == ["012345.bcdef", "short", "session"]


def test_ssl_filter_grammar(spark):
    from traceframe.functions.filters import compile_ssl_filter
    df = spark.createDataFrame([("SSL_read", 10, 1.5, True, "GET /\r\n"), ("SSL_write", 99, 9.0, False, "\x01\x02")],
                               "function string, len bigint, latency_ms double, is_handshake boolean, data string")

    def hits(e):
        return [r[0] for r in df.select(compile_ssl_filter(e, df.columns)).collect()]
    assert hits("len>=99") == [False, True]
    assert hits("function!=SSL_read & (len<50 | latency_ms>8.5)") == [False, True]
    assert hits("data~GET /\\r\\n") == [True, False]
    assert hits("data.type=binary") == [False, True]
    assert hits("function>SSL") == [False, False]  # ordering on strings never matches
    assert hits("is_handshake=true") == [True, False]
    assert hits("") == [False, False]


def test_session_process_matching(spark):
    from traceframe.operators import matching as MT
    sess = spark.createDataFrame([
        ("s1", "claude", "/p/s1.jsonl", 10_000, "/w", 0), ("s2", "claude", "/p/s2.jsonl", 20_000, "/w", 1),
        ("s3", "claude", "/p/s3.jsonl", 30_000, "/w", 2), ("s4", "codex", "/p/s4.jsonl", 5_000, "/x", 3)],
        "session_id string, agent string, path string, end_ms bigint, cwd string, ord int")
    procs = spark.createDataFrame([
        (101, 1, "claude", 0, "/w", 0), (102, 2, "claude", 19_000, "/w", 1), (103, 3, "claude", 29_500, "/w", 2),
        (104, 4, "codex", 100_000, "/x", 0)],
        "root_pid bigint, starttime_ticks bigint, agent string, start_ms bigint, cwd string, ord int")
    ev = spark.createDataFrame([(101, "/p/s2.jsonl", "proc_fd"), (101, "/p/s2.jsonl", "ebpf_file")],
                               "root_pid bigint, path string, trace string")
    got = {r["session_id"]: (r["root_pid"], r["evidence"], r["confidence"]) for r in MT.match_sessions(sess, procs, ev).collect()}
    # s2 has eBPF evidence on 101; s1 and s3 fall back to the nearest same-cwd process;
    # s4's only candidate started more than 30 s after the session ended
    assert got["s2"] == (101, "ebpf_file", 0.95)
    assert got["s3"] == (103, "recent_cwd", 0.55)
    assert got["s1"] == (102, "recent_cwd", 0.55)
    assert "s4" not in got


def test_session_process_matching_against_the_greedy_order(spark):
    """Many sessions and processes of one directory, shared paths, bound and evidenced processes, on two machines."""
    import random

    from traceframe.operators import matching as MT
    rng = random.Random(21)
    sess, procs, ev, bound = [], [], [], []
    for m in ("m1", "m2"):
        n = 45
        order = rng.sample(range(n), n)
        sess += [(m, f"s{i}", rng.choice(["claude", "codex"]), f"/p/{i // 2}.jsonl", rng.randrange(0, 400) * 1000, rng.choice(["/w", "/w", "/v", "", None]), order[i]) for i in range(n)]
        order = rng.sample(range(n), n)
        procs += [(m, 100 + i, i, rng.choice(["claude", "codex"]), rng.choice([None] + [rng.randrange(0, 400) * 1000] * 9), rng.choice(["/w", "/w", "/v", None]), order[i]) for i in range(n)]
        ev += [(m, 100 + rng.randrange(n), f"/p/{rng.randrange(n // 2)}.jsonl", rng.choice(["ebpf_file", "proc_fd"])) for _ in range(25)]
        bound += [(m, 100 + i, i, f"/p/{rng.randrange(n // 2)}.jsonl") for i in rng.sample(range(n), 12)]
    want = set()
    for m in ("m1", "m2"):
        by_pid, bind = {}, {p: path for mm, p, _, path in bound if mm == m}
        for mm, p, path, trace in ev:
            if mm == m:
                have = by_pid.setdefault(p, {})
                have[path] = "ebpf_file" if "ebpf_file" in (trace, have.get(path)) else "proc_fd"
        ranked = []
        for _, sid, agent, path, end, cwd, so in (s for s in sess if s[0] == m):
            for _, pid, _, pagent, start, pcwd, po in (p for p in procs if p[0] == m):
                if agent != pagent or (start is not None and end + 30_000 < start):
                    continue
                if pid in by_pid:
                    trace = by_pid[pid].get(path)
                else:
                    trace = "sticky_binding" if bind.get(pid) == path else None
                if trace:
                    ranked.append((0, so, po, 0, 0, sid, pid, trace))
                if pid not in by_pid and pid not in bind and cwd and cwd == pcwd and start is not None:
                    ranked.append((1, abs(end - start), -end, so, po, sid, pid, "recent_cwd"))
        used = set()
        for *_, sid, pid, trace in sorted(ranked):
            if sid not in used and pid not in used:
                used |= {sid, pid}
                want.add((m, sid, pid, trace))
    got = MT.match_sessions(
        spark.createDataFrame(sess, "machine string, session_id string, agent string, path string, end_ms bigint, cwd string, ord int"),
        spark.createDataFrame(procs, "machine string, root_pid bigint, starttime_ticks bigint, agent string, start_ms bigint, cwd string, ord int"),
        spark.createDataFrame(ev, "machine string, root_pid bigint, path string, trace string"),
        spark.createDataFrame(bound, "machine string, root_pid bigint, starttime_ticks bigint, bound_path string"), ["machine"]).collect()
    assert {(r.machine, r.session_id, r.root_pid, r.evidence) for r in got} == want and len(got) == len(want)
    assert {t for *_, t in want} == set(MT.CONFIDENCE)


def test_path_groups(spark):
    from traceframe.operators import sessionlog as SL
    rows = [("/repo/src/main.rs", "/repo"), ("/repo/collector/src/view/mod.rs", "/repo"), ("/tmp/x.log", "/repo"),
            ("/home/u/.ssh/id", "/repo"), ("/etc/hosts", "/repo"), ("src/lib.rs", "/repo"),
            ("/repo/~/.codex/config", "/x"), ("", "/repo"), ("/repo", "/repo")]
    df = spark.createDataFrame(rows, "p string, r string")
    got = [r[0] for r in df.select(SL.path_group(F.col("p"), F.col("r"))).collect()]
    assert got == ["src/main.rs", "collector/src/view", "external/tmp", "external/home", "external/path",
                   "src/lib.rs", "external/codex", "none", "repo"]
    cmd = spark.createDataFrame([("Bash", None, "cat src/a.py -n http://x /tmp/q", "/repo")],
                                "n string, ip string, c string, r string")
    g = cmd.select(SL.path_groups(F.col("n"), F.col("ip"), F.col("c"), F.col("r"))).first()[0]
    assert g == ["external/tmp", "src/a.py"]


def test_prompt_keys_with_repeated_index(spark):
    df = spark.createDataFrame([("s", 0, "h0"), ("s", 0, "h1"), ("s", 1, "h2")],
                               "session_id string, prompt_index bigint, text_hash string")
    got = sorted((r["prompt_key"], r["key_kind"]) for r in PR.prompt_keys(df).collect())
    assert got == [("0:h0", "duplicate_non_keyed"), ("0:h1", "duplicate_non_keyed"), ("1:h2", "unique")]


def test_pipeline_and_views(spark):
    from traceframe.plans.api import Pipeline, register_tables
    df = spark.range(10)
    p = Pipeline(lambda d: d.where("id % 2 = 0")).then(lambda d: d.selectExpr("id * 10 AS x"))
    register_tables(spark, {"evens": p(df)})
    assert spark.sql("SELECT sum(x) FROM evens").first()[0] == 200


def test_process_chain_and_response_text(spark):
    from traceframe.operators.correlate import response_text
    from traceframe.operators.sessionlog import command_basename, process_chain, shell_words
    nested = "git log"
    for _ in range(5):
        nested = "sh -c '" + nested.replace("\\", "\\\\").replace("'", "\\'") + "'"
    cases = [("sudo -E bash -lc 'cd /x && \"/usr/bin/python3\" run.py'", ["bash", "cd"]),
             # a wrapper skips one following option only: "timeout 5" names the program "5"
             ("timeout 5 sh -c \"curl https://h\"", ["5"]), ("nohup sh -c \"curl https://h\"", ["sh", "curl"]), ("", []), (None, []),
             ("bash -c 'git status'", ["bash", "git"]), ("'/usr/bin/my tool' x", ["my tool"]), ("/home/me", ["external"]), ("bash -c", ["bash"]),
             ("sudo", []), ("a\\ b c", ["a b"]), (nested, ["sh"] * 5 + ["git"])]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string")
    got = {r.i: r.p for r in df.select("i", process_chain(F.col("c")).alias("p")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
    words = spark.createDataFrame([("env \"a b\"'c d' '' e\\ f 'open",)], "c string").select(shell_words(F.col("c"))).first()[0]
    assert words == ["env", "a bc d", "e f", "open"]
    assert df.where("i = 6").select(command_basename(F.col("c"))).first()[0] == "my tool"
    bodies = [('{"content":[{"type":"text","text":"a"},{"type":"tool_use"},{"type":"text","text":"b"}]}', "a b"),
              ('{"choices":[{"message":{"content":"hi"}}]}', "hi"), ("plain", "plain"), ('{"content":"x"}', "x"), (None, ""), ("", ""),
              ('{"choices":[]}', '{"choices":[]}')]
    b = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(bodies)], "i int, b string")
    got = {r.i: r.t for r in b.select("i", response_text(F.col("b")).alias("t")).collect()}
    assert [got[i] for i in range(len(bodies))] == [want for _, want in bodies]


def test_prompt_text_at_any_depth(spark):
    import json
    from traceframe.operators.canonical import extract_prompt_text
    deep = "core"
    for i in range(40):
        deep = [deep] if i % 2 else {"parts": [{"text": f"t{i}"}, {"content": deep}]}
    bodies = [({"prompt": " a  b "}, "a b"), ({"messages": [{"content": "x"}, {"content": [{"text": "y [ {"}, {"type": "z"}, "w"]}, "v"]}, "x y [ { w v"),
              ({"contents": [{"parts": [{"text": "p"}]}], "messages": [{"content": "m"}]}, "m p"), ({"prompt": "<session> q </session>"}, "q"),
              ({"messages": []}, None), ([1], None), ({"messages": [deep]}, " ".join(f"t{i}" for i in range(38, -1, -2)) + " core")]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, (b, _) in enumerate(bodies)] + [(99, None), (98, "no json")], "i int, b string")
    got = {r.i: r.t for r in df.select("i", extract_prompt_text(F.col("b")).alias("t")).collect()}
    assert [got[i] for i in range(len(bodies))] == [want for _, want in bodies] and got[99] is None and got[98] is None


def test_codex_exec_prompts(spark):
    from traceframe.operators.correlate import exec_prompts
    rows = [("/usr/bin/codex", 'codex exec --json -m gpt-5 "fix  the\ntests"'),
            ("/usr/bin/codex", "codex exec --unknown hi"),
            ("/a/node_modules/codex", 'codex exec "x"'),
            ("/usr/bin/codex", "codex run"),
            ("/usr/bin/codex", "codex exec -C /repo --ephemeral 'ship it'")]
    df = spark.createDataFrame([(i, 1000 + i, 7, "codex", t, c) for i, (t, c) in enumerate(rows)],
                               "i int, timestamp_ms bigint, pid bigint, comm string, target string, full_command string") \
        .withColumn("audit_type", F.lit("process")).withColumn("action", F.lit("exec"))
    got = sorted((r["timestamp_ms"], r["text_content"]) for r in exec_prompts(df).collect())
    assert got == [(1000, "fix the tests"), (1004, "ship it")]
