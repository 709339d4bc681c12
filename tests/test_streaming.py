"""Batch = stream equivalence for the streaming operators (R5, R8, R9) and
golden pairing cases (J1)."""

import os
import tempfile

from pyspark.sql import functions as F

from traceframe.operators import audit as A
from traceframe.operators import monitor as M
from traceframe.operators import pairing as PA
from traceframe.operators import process as P
from traceframe.operators import resources as R
from traceframe.sources import fixtures as FX
from traceframe.streaming import stream as ST

SF = "/root/testdata/sf0.001"


def _scratch():
    return tempfile.mkdtemp(prefix="tf-test-", dir="/tmp")


def _as_stream(spark, df, parts=3, order="timestamp_ms"):
    """Files in time order (a live source delivers roughly in time order)."""
    d = os.path.join(_scratch(), "in")
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    step = (hi - lo) // parts + 1
    for i in range(parts):  # one file per time range, written in order
        (df.where((F.col(order) >= lo + i * step) & (F.col(order) < lo + (i + 1) * step))
         .coalesce(1).sortWithinPartitions(order).write.mode("append").parquet(d))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(d)


def _run_memory(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


EV_SCHEMA = ("seq bigint, timestamp_ms bigint, pid bigint, tid bigint, kind string, request_id string, "
             "model string, has_body boolean, status_code int")


def _pair(spark, rows):
    return {r["id"]: r for r in PA.pair_llm_calls(spark.createDataFrame(rows, EV_SCHEMA)).collect()}


def test_pairing_health(spark):
    out = _pair(spark, [(1, 1000, 1, 1, "request", None, "m", True, None),
                        (2, 1500, 1, 1, "response", None, None, True, 200),
                        (3, 2000, 1, 2, "request", None, "m", True, None),
                        (4, 2500, 1, 2, "response", None, None, True, 503),
                        (5, 3000, 1, 3, "request", None, "m", True, None)])
    assert (out["llm-1"]["status"], out["llm-1"]["confidence"]) == ("complete", 0.75)
    assert (out["llm-3"]["status"], out["llm-3"]["error_type"]) == ("error", "http_503")
    assert out["llm-5"]["status"] == "pending"


def test_pairing_request_id_ttl_and_ambiguity(spark):
    out = _pair(spark, [(1, 0, 1, 1, "request", "a", "m", True, None),
                        (2, 10, 1, 1, "request", "b", "m", True, None),
                        (3, 20, 1, 1, "response", "b", None, True, 200),   # id match
                        (4, 30, 1, 1, "request", None, "m", True, None),
                        (5, 40, 1, 1, "response", None, None, True, 200),  # two pending → orphan
                        (6, 400_000, 1, 1, "response", None, None, True, 200),  # all expired → orphan
                        (7, 400_010, 1, 1, "request", None, None, False, None),  # rejected
                        (8, 400_020, 1, None, "response", None, None, True, 500)])  # no thread → orphan
    assert (out["llm-orphan-8"]["status"], out["llm-orphan-8"]["error_type"], out["llm-orphan-8"]["tid"]) == ("error", "http_500", None)
    assert out["llm-2"]["confidence"] == 0.95 and out["llm-2"]["response_seq"] == 3
    assert out["llm-orphan-5"]["confidence"] == 0.35
    assert out["llm-orphan-6"]["confidence"] == 0.35
    assert out["llm-1"]["status"] == "pending" and "llm-7" not in out


def _queue(rows, ttl=PA.PENDING_TTL_MS, cap=PA.MAX_PENDING):
    """The calls of one thread by one long queue."""
    names = [c.split()[0] for c in EV_SCHEMA.split(", ")]
    events = [dict(zip(names, r)) | {"ts": r[1]} for r in sorted(rows, key=lambda r: (r[1], r[0]))]
    return {r["id"]: r for r in PA.settle([], events, ttl, cap)[0]}


def test_pairing_of_a_busy_thread_by_blocks_equals_one_queue(spark):
    import random
    rng = random.Random(12)
    rows, t = [], 0
    for seq in range(1, 1201):  # never five minutes of rest, requests waiting over many blocks
        t += rng.choice([0, 1_000, 20_000, 70_000])
        name = rng.choice([None, None, f"r{rng.randint(seq // 8, seq // 8 + 4)}"])
        if rng.random() < .55:
            rows.append((seq, t, 1, 1, "request", name, rng.choice([None, "m"]), rng.random() < .8, None))
        else:
            rows.append((seq, t, 1, 1, rng.choice(["response", "response", "http_response"]), name, None, True, rng.choice([None, 200, 500])))
    want = _queue(rows)
    assert sum(r["status"] == "complete" for r in want.values()) > 100
    for block in (30_000, 600_000):
        out = PA.pair_llm_calls(spark.createDataFrame(rows, EV_SCHEMA), block_ms=block, scope=[]).collect()
        assert {r.id: r.asDict() for r in out} == want and len(out) == len(want)
    both = spark.createDataFrame([(m, *r) for m in ("m1", "m2") for r in rows[:300]], f"machine string, {EV_SCHEMA}")
    got = PA.pair_llm_calls(both, scope=["machine"]).collect()
    part = _queue(rows[:300])
    assert all({r.id: r.status for r in got if r.machine == m} == {i: r["status"] for i, r in part.items()} for m in ("m1", "m2"))
    assert PA.pair_llm_calls(both.where("pid > 5"), scope=["machine"]).collect() == []


def test_pairing_stream_equals_batch(spark):
    ev = FX.llm_events(spark, SF)
    batch = {r["id"]: (r["request_seq"], r["response_seq"], r["status"]) for r in PA.pair_llm_calls(ev).collect()}
    _run_memory(PA.pair_llm_calls_stream(_as_stream(spark, ev)), "pair_out")
    rows = spark.sql("SELECT * FROM pair_out").collect()
    final = {}
    for r in rows:  # pending rows are superseded by the pair row of the same id
        if r["id"] not in final or r["status"] != "pending":
            final[r["id"]] = (r["request_seq"], r["response_seq"], r["status"])
    assert final == batch


def test_monitor_stream_equals_batch(spark):
    d = R.cpu_io_delta(FX.proc_samples(spark, SF)).withColumn(
        "session_id", F.format_string("s-%d", F.col("pid") % 10))
    batch = {(r["session_id"], r["window_start"]): (r["cpu_ms"], r["read_bytes"], r["last_seen_ms"])
             for r in M.monitor_windows(d, 2000).collect()}
    _run_memory(ST.monitor_stream(_as_stream(spark, d, order="sample_ts")), "mon_out", "complete")
    got = {(r["session_id"], r["window_start"]): (r["cpu_ms"], r["read_bytes"], r["last_seen_ms"])
           for r in spark.sql("SELECT * FROM mon_out").collect()}
    assert got == batch


def test_materialize_stream_equals_batch(spark):
    canon = FX.canonical_events(spark, SF)
    out, ck = _scratch(), _scratch()
    q = ST.materialize_stream(_as_stream(spark, canon), out, ck)
    q.awaitTermination()
    tables = ST.read_materialized(spark, out)
    a = sorted(tuple(r) for r in tables["audit_events"].select("id", "status", "target").collect())
    b = sorted(tuple(r) for r in P.audit_from_events(canon).select("id", "status", "target").collect())
    assert a == b
    nt = tables["network_targets"].select("host", "path", "count").collect()
    nb = A.network_targets(A.network_rows(canon)).select("host", "path", "count").collect()
    assert sorted(map(tuple, nt)) == sorted(map(tuple, nb))


def _rows(df, cols=None):
    return sorted(tuple(map(str, r)) for r in df.select(*(cols or sorted(df.columns))).collect())


def test_store_commits_replays_and_compacts(spark):
    from traceframe.streaming import tables as TB
    canon = FX.canonical_events(spark, SF).where("seq < 3000")
    out = _scratch()
    parts = [canon.where(F.col("seq") % 6 == i) for i in range(6)]
    for i in (0, 1, 2):
        TB.materialize_batch(parts[i], out, i)
    store = TB.Store(spark, out)
    before = store.folders("audit_events")
    TB.materialize_batch(parts[5], out, 1)  # delivered again: skipped
    store._write("audit_events", P.audit_from_events(parts[5]))  # failed before its commit: not seen
    assert store.folders("audit_events") == before and len(before) == 3
    store.compact(files=2)
    assert len(store.folders("audit_events")) == 1 and store.committed(2) and not store.committed(3)
    TB.materialize_batch(parts[0], out, 2)
    for i in (3, 4, 5):
        TB.materialize_batch(parts[i], out, i)
    assert len(store.folders("audit_events")) == 4
    store.compact()
    store.compact()  # nothing new
    assert len(store.folders("audit_events")) == 1 and len(store._entries()) == 5  # the state before stays readable
    got = TB.read_materialized(spark, out)
    assert _rows(got["audit_events"]) == _rows(P.audit_from_events(canon))
    assert _rows(got["network_targets"]) == _rows(A.network_targets(A.network_rows(canon)))
    assert _rows(got["process_nodes"]) == _rows(P.process_nodes(canon))
    empty = _scratch()
    TB.materialize_batch(canon.limit(0), empty, 0)
    assert set(TB.read_materialized(spark, _scratch()).values()) == {None} and TB.Store(spark, empty).committed(0)


def test_samples_and_calls_materialize(spark):
    from traceframe.streaming import tables as TB
    samples = FX.resource_samples(spark, SF).withColumnRenamed("cpu_percent", "cpu")
    traffic = FX.llm_traffic(spark, SF).where("seq < 3000")
    for rows, types, want in (
            (samples, TB.SAMPLE_ROWS, {"resource_samples": R.resource_rows(samples), "resource_stats": R.resource_stats(R.resource_rows(samples))}),
            (traffic, TB.CALL_ROWS, TB._call_tables(traffic))):
        out = _scratch()
        TB.materialize_stream(_as_stream(spark, rows), out, _scratch(), row_types=types, compact_every=2).awaitTermination()
        got = TB.read_materialized(spark, out, types)
        assert {n: _rows(t) for n, t in got.items()} == {n: _rows(t) for n, t in want.items()}
