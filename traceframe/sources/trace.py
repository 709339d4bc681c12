"""Trace sources: JSONL event logs (batch or stream), envelope validation with
dead letters, saved-run tables and run listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scan import running_sum

# Default values when a saved table lacks a column (additive schema evolution).
COLUMN_DEFAULTS = {"status": "observed", "view_source": "view", "source": "unknown"}

ORDER_BLOCK = 1 << 16  # line numbers of one step of the running count

SAVED_TABLES = ["llm_calls", "token_usage", "audit_events", "process_nodes", "tool_calls",
                "network_targets", "resource_samples"]


def read_trace(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """One JSON event per line (``*.jsonl``/``*.log`` under ``path``).

    Columns: ``line`` (text), ``file`` (source path), ``line_order`` (order of
    the line within the scan: increasing within each file) and ``v`` (the
    parsed variant, null for a bad line). ``stream=True`` gives the same
    columns as a streaming DataFrame.
    """
    reader = spark.readStream if stream else spark.read
    for k, v in options.items():
        reader = reader.option(k, v)
    raw = reader.text(path)
    raw = raw.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    if not stream:
        raw = raw.withColumn("line_order", F.monotonically_increasing_id())
    return raw.withColumn("v", F.expr("try_parse_json(line)"))


def _is_u64(v: str, path: str):
    t = F.expr(f"schema_of_variant(variant_get({v}, '$.{path}'))")
    val = F.expr(f"try_variant_get({v}, '$.{path}', 'bigint')")
    return F.coalesce((t == "BIGINT") & (val >= 0), F.lit(False))


def split_valid(lines: DataFrame, runner: str = "process", ts_field: str = "timestamp",
                order_col: str = "line_order", file_col: str = "file") -> tuple[DataFrame, DataFrame]:
    """Envelope validation. A line needs an unsigned integer ``ts_field``,
    an unsigned integer ``pid`` and a string ``comm``; otherwise it becomes a
    diagnostic row (source 'diagnostic', reason, running error count per
    file). Returns (events, diagnostics).

    The running count is a two-level scan keyed by file and blocks of its
    lines, so no single task orders the whole log, however lines are numbered.
    """
    v = "v"
    ok_json = F.col(v).isNotNull()
    ok_ts = _is_u64(v, ts_field)
    ok_pid = _is_u64(v, "pid")
    ok_comm = F.coalesce(F.expr(f"schema_of_variant(variant_get({v}, '$.comm'))") == "STRING", F.lit(False))
    reason = (F.when(~ok_json, "invalid json").when(~ok_ts, f"missing {ts_field}")
              .when(~ok_pid, "missing pid").when(~ok_comm, "missing comm"))
    # The checks stand behind a generator: as a plain column, the filters below would copy the parser into each of them.
    x = lines.withColumn("_reason", F.explode(F.array(reason)))
    events = x.where(F.col("_reason").isNull()).select(
        F.expr(f"variant_get({v}, '$.{ts_field}', 'bigint')").alias("timestamp"),
        F.lit(runner).alias("source"),
        F.expr(f"variant_get({v}, '$.pid', 'bigint')").alias("pid"),
        F.expr(f"variant_get({v}, '$.comm', 'string')").alias("comm"),
        F.expr(f"variant_get({v}, '$.data')").alias("data"),
        *[c for c in (order_col, file_col) if c in lines.columns])
    bad = x.where(F.col("_reason").isNotNull()).select(
        F.coalesce(F.expr(f"try_variant_get({v}, '$.timestamp_ns', 'bigint')"),
                   F.expr(f"try_variant_get({v}, '$.timestamp', 'bigint')")).alias("timestamp"),
        F.lit("diagnostic").alias("source"),
        F.coalesce(F.expr(f"try_variant_get({v}, '$.pid', 'bigint')"), F.lit(0).cast("bigint")).alias("pid"),
        F.coalesce(F.expr(f"try_variant_get({v}, '$.comm', 'string')"), F.lit(runner)).alias("comm"),
        F.lit("runner_parse_error").alias("type"), F.lit(runner).alias("runner"),
        F.col("_reason").alias("reason"),
        F.col("line").alias("raw"),
        *[c for c in (order_col, file_col) if c in lines.columns])
    if order_col in lines.columns:
        bad = running_sum(bad, [file_col], F.expr(f"{order_col} div {ORDER_BLOCK}"), [order_col],
                          F.lit(1).cast("bigint"), "parse_error_count")
    diag = bad.select("timestamp", "source", "pid", "comm", "type", "runner", "reason",
                      *(["parse_error_count"] if "parse_error_count" in bad.columns else []), "raw",
                      *[c for c in (order_col, file_col) if c in lines.columns])
    return events, diag


def _folder(spark: SparkSession, path: str):
    """A folder's file system and its path there, on any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(at)


def read_trace_tables(spark: SparkSession, run_dir: str, schemas: dict | None = None) -> dict[str, DataFrame]:
    """S3: the saved tables of one run (parquet folders named after the
    tables). Missing tables are skipped; missing columns get defaults."""
    out = {}
    fs, at = _folder(spark, run_dir)
    saved = {s.getPath().getName() for s in fs.listStatus(at)} if fs.exists(at) else set()
    for name in SAVED_TABLES:
        p = f"{run_dir.rstrip('/')}/{name}"
        if name not in saved:
            continue
        df = spark.read.schema(schemas[name]).parquet(p) if schemas and name in schemas else spark.read.parquet(p)
        for col, default in COLUMN_DEFAULTS.items():
            if col not in df.columns and name in ("audit_events", "process_nodes", "token_usage"):
                df = df.withColumn(col, F.lit(default))
            elif col in df.columns:
                df = df.withColumn(col, F.coalesce(F.col(col), F.lit(default)))
        out[name] = df
    return out


def list_runs(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Saved runs under ``root`` (one folder per run), newest first.
    Only file metadata is read (``binaryFile`` with the content pruned)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", pattern).load(root).select("path", "modificationTime", "length"))
    home = _folder(spark, root)[1].toUri().getPath().rstrip("/")
    plain = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")  # without scheme and authority
    run = F.when(plain.startswith(f"{home}/"), F.regexp_extract(F.substring(plain, len(home) + 2, 1 << 30), "^([^/]+)/", 1))
    return (files.withColumn("run", run).where(F.col("run") != "")
            .groupBy("run").agg(F.max("modificationTime").alias("modified"), F.sum("length").alias("bytes"),
                                F.count(F.lit(1)).alias("files"))
            .orderBy(F.col("modified").desc(), F.col("run").asc()))
