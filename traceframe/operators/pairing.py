"""LLM request ↔ response pairing per (pid, tid), and the call rows.

The pairing is a queue per thread (arrival order, at most 16 pending requests,
5-minute TTL): whether a response finds its request depends on what was taken
before. A thread is cut into blocks of time, and all blocks are settled at
once, each with the requests that wait when it begins. These are not known at
first and taken as none; a block passes on what still waits at its end, and
the blocks that got something else than assumed are settled again, until
nothing changes. A request waits five minutes, so this takes two or three
rounds (and never more than the thread has blocks); the result is that of one
long queue, but no task holds more than a block. Only narrow columns go
through the queue; hosts, paths, bodies and tokens are joined on afterwards by
the numbers of request and response.
"""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import discard, stored
from . import canonical as CN

BLOCK_MS = 10 * 60 * 1000
PENDING_TTL_MS = 5 * 60 * 1000
MAX_PENDING = 16

CALL_SCHEMA = ("id string, pid bigint, tid bigint, request_seq bigint, response_seq bigint, "
               "start_timestamp_ms bigint, end_timestamp_ms bigint, model string, status string, "
               "status_code int, error_type string, confidence double")

EVENT_COLS = ["seq", "timestamp_ms", "pid", "tid", "kind", "request_id", "model", "has_body", "status_code"]


def _call(request: dict | None, response: dict | None, confidence: float | None) -> dict:
    """The call row of a request, of a response nobody asked for, or of both."""
    first, code = request or response, response["status_code"] if response else None
    failed = code is not None and code >= 400
    models = [e["model"] for e in (request, response) if e and e["model"] is not None]
    return {"id": f"llm-{request['seq']}" if request else f"llm-orphan-{response['seq']}",
            "pid": first["pid"], "tid": first["tid"],
            "request_seq": request["seq"] if request else None, "response_seq": response["seq"] if response else None,
            "start_timestamp_ms": first["ts"], "end_timestamp_ms": response["ts"] if response else None,
            "model": next(iter(models), "unknown" if response else None),
            "status": "pending" if response is None else "error" if failed else "complete",
            "status_code": code, "error_type": f"http_{int(code)}" if failed else None, "confidence": confidence}


def settle(waiting: list[dict], events, ttl_ms: int = PENDING_TTL_MS, cap: int = MAX_PENDING) -> tuple[list[dict], list[dict]]:
    """Rows of the calls that ``events`` of one thread begin or end, and the
    requests that still wait. A request waits ``ttl_ms``, and only the latest
    ``cap`` do (an older one stays a pending call). A response with an id takes
    the first waiting request of that id; one without takes the only waiting
    request, if there is just one."""
    rows: list[dict] = []
    for ev in events:
        waiting = [r for r in waiting if r["ts"] >= ev["ts"] - ttl_ms]
        if ev["kind"] == "request" and (ev["has_body"] or ev["model"] is not None):
            rows.append(_call(ev, None, None))
            waiting = [*waiting, ev][-cap:]
        elif ev["kind"] == "response" or (ev["kind"] == "http_response" and waiting):
            asked = ev["request_id"]
            fits = waiting if asked is None else [r for r in waiting if r["request_id"] == asked][:1]
            request = fits[0] if len(fits) == 1 else None
            rows.append(_call(request, ev, 0.35 if request is None else 0.75 if asked is None else 0.95))
            waiting = [r for r in waiting if r is not request]
    return rows, waiting


def _rows(pdf: pd.DataFrame):
    for r in pdf.itertuples(index=False):
        yield {"seq": int(r.seq), "ts": int(r.timestamp_ms), "pid": int(r.pid), "tid": int(r.tid),
               "kind": r.kind, "request_id": None if pd.isna(r.request_id) else r.request_id,
               "model": None if pd.isna(r.model) else r.model, "has_body": bool(r.has_body),
               "status_code": None if pd.isna(r.status_code) else int(r.status_code)}


def _table(rows: list[dict]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in CALL_SCHEMA.split(", ")])
    for c in ("pid", "tid", "request_seq", "response_seq", "start_timestamp_ms", "end_timestamp_ms"):
        pdf[c] = pdf[c].astype("Int64")
    return pdf.astype({"status_code": "Int32", "confidence": "float64"})


WAIT_SCHEMA = "place int, request_id string, has_body boolean"


def _settle_blocks(scope: list[str], ttl_ms: int, cap: int, schema: pa.Schema):
    """Rows of the calls of each block, and with ``place`` the requests that still wait at its end.
    A task gets its events sorted by block; it holds one block at a time, and a call of Python serves many."""
    keys = [*scope, "pid", "tid", "block"]

    def settle_block(own: dict, events: list[dict]) -> list[dict]:
        begun = sorted((e for e in events if e["place"] is not None), key=lambda e: e["place"])
        rows, waiting = settle(begun, sorted((e for e in events if e["place"] is None), key=lambda e: (e["ts"], e["seq"])), ttl_ms, cap)
        # the pending row of a request is replaced by its pair row (same id, later)
        rows = list({r["id"]: r for r in rows}.values())
        rows += [{"pid": w["pid"], "tid": w["tid"], "request_seq": w["seq"], "start_timestamp_ms": w["ts"], "model": w["model"],
                  "request_id": w["request_id"], "has_body": w["has_body"], "place": i} for i, w in enumerate(waiting)]
        return [r | own for r in rows]

    def settle_blocks(batches):
        own, events = None, []
        for batch in batches:
            out = []
            for e in batch.to_pylist():
                e["ts"] = e["timestamp_ms"]
                block = {c: e[c] for c in keys}
                if block != own:
                    out += settle_block(own, events) if events else []
                    own, events = block, []
                events.append(e)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if events:
            yield pa.RecordBatch.from_pylist(settle_block(own, events), schema)

    return settle_blocks


def _without_thread(events: DataFrame, scope: list[str] = ()) -> DataFrame:
    """Responses without a thread id can be paired with nothing: orphan calls."""
    code = F.col("status_code")
    none = lambda kind: F.lit(None).cast(kind)
    return events.where("pid is not null and tid is null and kind = 'response'").select(
        *scope, F.format_string("llm-orphan-%d", "seq").alias("id"), F.col("pid").cast("bigint"), none("bigint").alias("tid"),
        none("bigint").alias("request_seq"), F.col("seq").cast("bigint").alias("response_seq"),
        F.col("timestamp_ms").alias("start_timestamp_ms"), F.col("timestamp_ms").alias("end_timestamp_ms"),
        F.coalesce("model", F.lit("unknown")).alias("model"), F.when(code >= 400, "error").otherwise("complete").alias("status"),
        code.cast("int").alias("status_code"), F.when(code >= 400, F.format_string("http_%d", code)).alias("error_type"),
        F.lit(0.35).cast("double").alias("confidence"))


def pair_llm_calls(events: DataFrame, ttl_ms: int = PENDING_TTL_MS, block_ms: int = BLOCK_MS, cap: int = MAX_PENDING,
                   scope: list[str] = ()) -> DataFrame:
    """Which request and response make a call.

    ``events``: seq, timestamp_ms, pid, tid, kind ('request' | 'response' |
    'http_response'), request_id, model, has_body, status_code, and the
    ``scope`` columns; ``seq`` is unique in a scope. Output: one row per
    accepted request (paired or 'pending') and one per orphan response (those
    without a thread id included). Events without pid make no call.
    """
    scope = list(scope)
    keys = [*scope, "pid", "tid", "block"]
    e = events.where("pid is not null and tid is not null").select(*scope, *EVENT_COLS).withColumn("block", F.expr(f"timestamp_ms div {int(block_ms)}"))
    e = stored(e.withColumn("pid", F.col("pid").cast("bigint")).withColumn("tid", F.col("tid").cast("bigint")).withColumn("place", F.lit(None).cast("int")))
    follow = Window.partitionBy(*keys[:-1]).orderBy("block")  # one row a block
    blocks = stored(e.groupBy(*keys).agg(F.min("timestamp_ms").alias("first"))
                    .select(*keys, F.lead("block").over(follow).alias("next"), F.lead("first").over(follow).alias("next_first")))
    types = dict(e.dtypes)
    schema = "".join(f"`{c}` {types[c]}, " for c in scope) + f"{CALL_SCHEMA}, {WAIT_SCHEMA}, block bigint"
    step = _settle_blocks(scope, ttl_ms, cap, to_arrow_schema(StructType.fromDDL(schema)))
    settled, carried, todo = None, None, None
    while todo is None or not todo.isEmpty():
        rows = e if todo is None else e.join(todo, keys, "left_semi").unionByName(carried.join(todo, keys, "left_semi"))
        made = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(step, schema)
        after = stored(made if settled is None else settled.join(todo, keys, "left_anti").unionByName(made))
        passed = stored(after.where("place is not null").join(blocks, keys)
                        .where(F.col("start_timestamp_ms") >= F.col("next_first") - ttl_ms)
                        .select(*scope, F.col("request_seq").alias("seq"), F.col("start_timestamp_ms").alias("timestamp_ms"), "pid", "tid",
                                F.lit("request").alias("kind"), "request_id", "model", "has_body", F.lit(None).cast("int").alias("status_code"),
                                F.col("next").alias("block"), "place"))
        new = _digest(passed, keys).withColumnRenamed("digest", "_new")
        old = (_digest(carried, keys) if carried is not None else new.limit(0).withColumnRenamed("_new", "digest"))
        later = stored(new.join(old, keys, "full").where(~F.col("_new").eqNullSafe(F.col("digest"))).select(*keys))
        discard(*[t for t in (settled, carried, todo) if t is not None])
        settled, carried, todo = after, passed, later
    calls = [c.split()[0] for c in CALL_SCHEMA.split(", ")]
    # A request that still waited at the end of its block has its pair row in a later one.
    best = F.max_by(F.struct(*calls[1:]), F.col("response_seq").isNotNull())
    paired = settled.where("place is null").groupBy(*scope, "id").agg(best.alias("call")).select(*scope, "id", "call.*")
    return paired.unionByName(_without_thread(events, scope))


def _digest(waiting: DataFrame, keys: list[str]) -> DataFrame:
    return waiting.groupBy(*keys).agg(F.sum(F.xxhash64("seq", "place").cast("decimal(38,0)")).alias("digest"))


def call_rows(events: DataFrame, pairs: DataFrame, scope: list[str] = ()) -> DataFrame:
    """The llm_calls table: ``pairs`` with session, conversation, comm,
    provider, model, kind, host, path, bodies, finish reason and tokens.

    ``events`` also hold comm, provider, host, path and body (JSON text; other
    text is no body). A field comes from the request, and of an orphan from the
    response; the provider, failing that, from the host. Ids of session and
    conversation are looked for in the request first; usage, finish reason and
    a missing model in the response."""
    scope = list(scope)

    def side(name: str, **also: Column) -> DataFrame:
        """What the events of one kind say, taken from their bodies before any row is shuffled."""
        kind = F.col("kind") == "request"
        body = events.where(kind if name == "request" else ~kind).withColumn("_v", F.expr("try_parse_json(body)"))
        usage = F.expr("coalesce(try_variant_get(_v, '$.usage'), try_variant_get(_v, '$.usageMetadata'))")
        fields = {c: F.col(c) for c in ("comm", "provider", "host", "path", "model")} | {
            "session": CN.session_id_from_body("_v"), "conversation": CN.conversation_id_from_body("_v")} | also
        # Behind a generator: filters over the tokens would otherwise copy the parser into each condition.
        said = F.struct(F.when(F.col("_v").isNotNull(), F.col("body")).alias(name), *[c.alias(f"{name}_{n}") for n, c in fields.items()])
        return (body.withColumn("_u", usage).select(*scope, F.col("seq").cast("bigint").alias(f"{name}_seq"), F.explode(F.array(said)).alias("_s"))
                .select(*scope, f"{name}_seq", "_s.*"))

    asked = side("request")
    told = side("response", inner=CN.extract_model("_v"), finish=CN.finish_reason("_v"), usage=F.when(F.col("_u").isNotNull(), CN.usage_struct("_u")))
    x = pairs.join(asked, [*scope, "request_seq"], "left").join(told, [*scope, "response_seq"], "left")
    orphan = F.col("request_seq").isNull()

    def first(c: str) -> Column:
        return F.when(orphan, F.col(f"response_{c}")).otherwise(F.col(f"request_{c}"))

    model = F.coalesce("request_model", F.when(orphan, F.col("response_model")), "response_inner", "response_model",
                       F.when(F.col("response_seq").isNotNull(), F.lit("unknown")))
    counts = ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens"]
    parts = [F.coalesce(F.col(f"response_usage.{c}"), F.lit(0).cast("bigint")) for c in counts]
    total = F.coalesce(F.col("response_usage.total_override"), sum(parts[1:], parts[0]))
    return x.select(
        *scope, "id", F.coalesce("request_session", "response_session").alias("session_id"),
        F.coalesce("request_conversation", "response_conversation").alias("conversation_id"),
        "request_seq", "response_seq", "start_timestamp_ms", "end_timestamp_ms", "pid", "tid", F.coalesce(first("comm"), F.lit("")).alias("comm"),
        F.coalesce(first("provider"), CN.provider_from_host(first("host"))).alias("provider"), model.alias("model"),
        CN.call_kind(first("path")).alias("call_kind"), "status", "error_type", F.col("response_finish").alias("finish_reason"),
        first("host").alias("host"), first("path").alias("path"), "status_code", *[p.alias(c) for p, c in zip(parts, counts)],
        total.alias("total_tokens"), "request", "response", "confidence")


def call_token_rows(calls: DataFrame, scope: list[str] = ()) -> DataFrame:
    """Token rows of the calls that have usage, one each (``token-{call id}``, source response_usage)."""
    counts = ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "total_tokens"]
    used = " OR ".join(f"{c} > 0" for c in counts)
    return calls.where(used).select(
        *scope, F.concat(F.lit("token-"), F.col("id")).alias("id"), F.col("id").alias("llm_call_id"), F.col("response_seq").alias("seq"),
        F.col("end_timestamp_ms").alias("timestamp_ms"), "pid", "comm", "provider", "model", *counts,
        F.lit("response_usage").alias("source"), F.lit("view").alias("view_source"), "confidence")


def pair_llm_calls_stream(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Streaming pairing with per-(pid, tid) state.

    The pending queue is the group state (JSON text); an event-time timeout
    of the TTL drops a queue nobody touched for 5 minutes. Rows are emitted
    as calls are decided (append mode); pending rows are emitted when the
    request arrives and superseded downstream by the pair row of the same id.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, pdfs, state):
        waiting = json.loads(state.get[0]) if state.exists else []
        rows, last = [], 0
        if chunks := [c for c in pdfs if len(c)]:
            pdf = pd.concat(chunks).sort_values(["timestamp_ms", "seq"], kind="stable")
            rows, waiting = settle(waiting, _rows(pdf))
            last = int(pdf["timestamp_ms"].iloc[-1])
        if waiting and not state.hasTimedOut:
            state.update((json.dumps(waiting),))
            state.setTimeoutTimestamp(max(last + PENDING_TTL_MS, int(state.getCurrentWatermarkMs()) + 1))
        elif state.exists:
            state.remove()
        if rows:
            yield _table(rows)

    e = (events.select(*EVENT_COLS).where("pid is not null and tid is not null")
         .withColumn("event_time", F.timestamp_millis("timestamp_ms"))
         .withWatermark("event_time", watermark))
    paired = e.groupBy("pid", "tid").applyInPandasWithState(
        step, CALL_SCHEMA, "pending string", "append", GroupStateTimeout.EventTimeTimeout)
    return paired.unionByName(_without_thread(events.select(*EVENT_COLS)))
