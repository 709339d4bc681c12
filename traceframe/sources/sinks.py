"""Sinks and export tables: snapshot, GenAI spans, span trees, CSV, folded
stacks, and the replace-by-id upserts (S7–S11, S12–S16)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import tokens as T


def upsert_replace(target: DataFrame, updates: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Rows of ``updates`` replace rows of ``target`` with the same key
    (the later arrival by ``order`` wins)."""
    return T.latest_calls(target.unionByName(updates, allowMissingColumns=True), key, order)


def upsert_network_targets(target: DataFrame, updates: DataFrame) -> DataFrame:
    """Counts add, first = min, last = max, keyed (pid or 0, host, path)."""
    rows = target.unionByName(updates, allowMissingColumns=True)
    if "seq" not in rows.columns:
        rows = rows.withColumn("seq", F.col("first_timestamp_ms"))
    return A.network_targets(rows)


def upsert_sessions(target: DataFrame, updates: DataFrame) -> DataFrame:
    """Min start, max end, model unless 'unknown', max tokens and confidence."""
    rows = target.unionByName(updates, allowMissingColumns=True)
    real_model = F.when(F.col("model").isNotNull() & (F.col("model") != "unknown"), F.col("seq"))
    return rows.groupBy("id").agg(
        F.min("start_timestamp_ms").alias("start_timestamp_ms"),
        F.max("end_timestamp_ms").alias("end_timestamp_ms"),
        F.coalesce(F.max_by("model", real_model), F.max_by("model", "seq")).alias("model"),
        F.max("input_tokens").alias("input_tokens"), F.max("output_tokens").alias("output_tokens"),
        F.max("total_tokens").alias("total_tokens"), F.max("confidence").alias("confidence"))


def genai_spans(calls: DataFrame, service: str = "traceframe", trace_col: str = "id") -> DataFrame:
    """One client span per finished call with GenAI attributes; error
    status for HTTP codes >= 400. Span id = 16 hex chars of sha256 of the
    call id, trace id = 32 hex chars of sha256 of ``trace_col`` (deterministic
    ids instead of random ones, so re-runs produce the same spans)."""
    finished = calls.where(F.col("end_timestamp_ms").isNotNull())
    attrs = F.array_compact(F.array(
        F.struct(F.lit("gen_ai.operation.name").alias("key"), F.lit("chat").alias("value")),
        F.struct(F.lit("gen_ai.provider.name").alias("key"), F.col("provider").alias("value")),
        F.struct(F.lit("server.address").alias("key"), F.col("host").alias("value")),
        F.when(F.col("model").isNotNull(), F.struct(F.lit("gen_ai.request.model").alias("key"),
                                                    F.col("model").alias("value"))),
        F.when(F.col("status_code").isNotNull(), F.struct(F.lit("http.response.status_code").alias("key"),
                                                          F.col("status_code").cast("string").alias("value"))),
    ))
    h = F.sha2(F.col("id"), 256)
    return finished.select(
        F.substring(F.sha2(F.col(trace_col), 256), 1, 32).alias("trace_id"), F.substring(h, 33, 16).alias("span_id"),
        F.lit(service).alias("service_name"),
        F.concat(F.lit("chat "), F.coalesce("model", F.lit("unknown"))).alias("name"),
        F.lit(3).alias("kind"),
        (F.col("start_timestamp_ms") * 1_000_000).alias("start_unix_nano"),
        (F.col("end_timestamp_ms") * 1_000_000).alias("end_unix_nano"),
        F.when(F.col("status_code") >= 400, 2).otherwise(1).alias("status_code"),
        F.when(F.col("status_code") >= 400, F.format_string("HTTP %d", "status_code")).alias("status_message"),
        attrs.alias("attributes"),
        "id")


def spans_to_traces(spans: DataFrame) -> DataFrame:
    """Per-trace summary (span count, first span, errors, root name).
    Aggregates only — a trace is never collected into one row; the span
    documents themselves are written clustered by trace (``write_traces``)."""
    return (spans.groupBy("trace_id")
            .agg(F.count(F.lit(1)).alias("span_count"),
                 F.min("start_unix_nano").alias("first_start_unix_nano"),
                 F.count_if(F.col("status_code") == 2).cast("bigint").alias("error_spans"),
                 F.min_by("name", F.struct("start_unix_nano", "span_id")).alias("root_name")))


def write_traces(spans: DataFrame, path: str, partitions: int | None = None) -> None:
    """S13 sink: span JSON lines clustered by trace and ordered by start time
    within it (readers group consecutive lines)."""
    n = partitions or spans.sparkSession.sparkContext.defaultParallelism
    (spans.repartition(n, "trace_id").sortWithinPartitions("trace_id", "start_unix_nano", "span_id")
     .write.mode("overwrite").json(path))


def write_event_csv(df: DataFrame, path: str) -> None:
    """CSV export with header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def export_snapshot(tables: dict[str, DataFrame], path: str, audit_limit: int | None = None) -> None:
    """Every table as parquet under ``path``; of the audit rows only the
    last ``audit_limit``, if the caller sets it."""
    for name, df in tables.items():
        if name == "audit_events" and audit_limit is not None:
            df = A.audit_tail(df, audit_limit)
        df.write.mode("overwrite").parquet(os.path.join(path, name))


def span_summary(spans: DataFrame) -> DataFrame:
    """Span counts by kind, mean latency of client spans (ms), distinct
    models and trace ids (counts; the id lists are an export concern)."""
    dur = (F.col("end_unix_nano") - F.col("start_unix_nano")) / 1_000_000
    model = F.regexp_extract("name", r"^chat (.*)$", 1)
    return spans.agg(
        F.count(F.lit(1)).alias("total_spans"),
        F.count_if(F.col("kind") == 3).alias("request_spans"),
        F.count_if(F.col("kind") == 2).alias("response_spans"),
        F.coalesce(F.round(F.avg(F.when((F.col("kind") == 3) & (dur > 0), dur)), 4), F.lit(0.0)).alias("average_latency_ms"),
        F.count_distinct(F.when(F.col("kind") == 3, F.nullif(model, F.lit("")))).alias("models"),
        F.count_distinct("trace_id").alias("traces"))
