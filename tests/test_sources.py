"""Sources and sinks round trips: JSONL scan with dead letters, saved tables,
run listing, snapshot/CSV/folded/trace writers."""

import os
import tempfile

from pyspark.sql import functions as F

from traceframe.operators import profiles as PR
from traceframe.sources import sinks as SK
from traceframe.sources import trace as TR


def _scratch():
    return tempfile.mkdtemp(prefix="tf-src-", dir="/tmp")


def test_read_trace_jsonl_with_dead_letters(spark):
    d = _scratch()
    with open(os.path.join(d, "a.jsonl"), "w") as f:
        f.write('{"timestamp": 5, "pid": 1, "comm": "bash", "data": {"x": 1}}\n')
        f.write('not json\n')
        f.write('{"timestamp": 6, "comm": "bash"}\n')
        f.write('{"timestamp": "7", "pid": 2, "comm": "sh"}\n')
        f.write('{"timestamp": 8, "pid": 3, "comm": "sh"}\n')
    ev, diag = TR.split_valid(TR.read_trace(spark, d))
    assert sorted(r["pid"] for r in ev.collect()) == [1, 3]
    got = sorted((r["reason"], r["parse_error_count"]) for r in diag.collect())
    assert got == [("invalid json", 1), ("missing pid", 2), ("missing timestamp", 3)]


def test_saved_tables_defaults_and_run_listing(spark):
    root = _scratch()
    run = os.path.join(root, "run-1")
    spark.createDataFrame([("a1", 1, None)], "id string, timestamp_ms bigint, status string") \
        .write.parquet(os.path.join(run, "audit_events"))
    t = TR.read_trace_tables(spark, run)
    assert set(t) == {"audit_events"}
    r = t["audit_events"].first()
    assert r["status"] == "observed" and r["view_source"] == "view"
    runs = TR.list_runs(spark, root, "*.parquet").collect()
    assert [x["run"] for x in runs] == ["run-1"]
    assert set(TR.read_trace_tables(spark, f"file://{run}/")) == {"audit_events"}  # the same by its address
    assert [x["run"] for x in TR.list_runs(spark, f"file://{root}", "*.parquet").collect()] == ["run-1"]
    assert TR.read_trace_tables(spark, os.path.join(root, "none")) == {}


def test_writers(spark):
    d = _scratch()
    stacks = spark.createDataFrame([("a;b", 2), ("a;c", 1)], "stack string, weight bigint")
    PR.write_folded(stacks, os.path.join(d, "folded"))
    lines = sorted(r[0] for r in spark.read.text(os.path.join(d, "folded")).collect())
    assert lines == ["a;b 2", "a;c 1"]
    SK.write_event_csv(stacks, os.path.join(d, "csv"))
    assert spark.read.option("header", True).csv(os.path.join(d, "csv")).count() == 2
    spans = spark.createDataFrame([("t", "s1", 5, 1, "x"), ("t", "s2", 9, 2, "y")],
                                  "trace_id string, span_id string, start_unix_nano bigint, status_code int, name string")
    SK.write_traces(spans, os.path.join(d, "traces"), 2)
    assert spark.read.json(os.path.join(d, "traces")).count() == 2
    s = SK.spans_to_traces(spans).first()
    assert (s["span_count"], s["error_spans"], s["root_name"]) == (2, 1, "x")
    SK.export_snapshot({"audit_events": spark.createDataFrame([("a", 1)], "id string, timestamp_ms bigint")},
                       os.path.join(d, "snap"))
    assert spark.read.parquet(os.path.join(d, "snap", "audit_events")).count() == 1


def test_session_log_discovery_newest_first(spark):
    import time
    from traceframe.operators.sessionlog import session_events
    from traceframe.operators.sessions import read_session_logs
    root = _scratch()
    os.makedirs(os.path.join(root, "proj"))
    for i, name in enumerate(["old.jsonl", "new.jsonl"]):
        with open(os.path.join(root, "proj", name), "w") as f:
            f.write('{"type":"user","sessionId":"s%d","timestamp":"2024-01-01T00:00:0%d.000Z",'
                    '"message":{"role":"user","content":"hello %d"}}\n' % (i, i, i))
        time.sleep(1.1)
    with open(os.path.join(root, "proj", "notes.txt"), "w") as f:
        f.write("ignored\n")
    lines = read_session_logs(spark, root, "*.jsonl", newest=1)
    assert [r["file"].split("/")[-1] for r in lines.collect()] == ["new.jsonl"]
    prompts, _, _ = session_events(lines)
    assert [r["text"] for r in prompts.collect()] == ["hello 1"]
