"""Structured Streaming forms of the operators.

Stateless operators (canonicalisation, HTTP parsing, filters) run unchanged on
streaming DataFrames. Stateful ones use event-time watermarks: tumbling
monitor windows (R9), session windows for file-open collapse (R6), and
per-thread pairing state (R5, in ``operators.pairing``). R8, the materialised
tables, is in ``streaming.tables``.

Late data: the reference processes in arrival order and never drops events;
with a watermark, rows later than the watermark are dropped by Spark. The
default watermark (10 minutes) is longer than the 5-minute pairing TTL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import materialize_batch, materialize_stream, read_materialized  # noqa: F401

DEFAULT_WATERMARK = "10 minutes"


def read_table_stream(spark: SparkSession, sf_dir: str, name: str, schema: StructType,
                      max_files: int = 1) -> DataFrame:
    """A streaming scan of one table of ``sf_dir`` (new files are new data)."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir))


def with_event_time(df: DataFrame, ms_col: str = "timestamp_ms", watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    return df.withColumn("event_time", F.timestamp_millis(F.col(ms_col))).withWatermark("event_time", watermark)


def monitor_stream(samples: DataFrame, window: str = "2 seconds", watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """Tumbling monitor windows per session over a sample stream
    (cpu_ms/io sums, peak RSS, processes, first/last sample)."""
    s = with_event_time(samples, "sample_ts", watermark)
    return (s.groupBy("session_id", F.window("event_time", window).alias("w"))
            .agg(F.sum("cpu_ms").cast("bigint").alias("cpu_ms"),
                 F.max("rss_kb").alias("max_rss_kb"),
                 F.sum("read_delta").cast("bigint").alias("read_bytes"),
                 F.sum("write_delta").cast("bigint").alias("write_bytes"),
                 F.approx_count_distinct("pid").alias("processes"),
                 F.min("sample_ts").alias("first_seen_ms"),
                 F.max("sample_ts").alias("last_seen_ms"))
            .select("session_id", (F.unix_millis(F.col("w.start"))).alias("window_start"),
                    "cpu_ms", "max_rss_kb", "read_bytes", "write_bytes", "processes",
                    "first_seen_ms", "last_seen_ms"))


def collapse_file_opens_stream(opens: DataFrame, window_ms: int = 60_000,
                               watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """R6 on a stream: session windows with a ``window_ms + 1`` ms gap; a
    collapsed row is emitted once the watermark passes its session end."""
    s = with_event_time(opens, "timestamp_ms", watermark)
    gap = f"{int(window_ms) + 1} milliseconds"
    return (s.groupBy("pid", "path", F.session_window("event_time", gap).alias("sw"))
            .agg(F.min_by("flags", F.struct("timestamp_ms", "seq")).alias("flags"),
                 F.count(F.lit(1)).alias("count"),
                 F.min("timestamp_ms").alias("first_timestamp_ms"),
                 F.max("timestamp_ms").alias("last_timestamp_ms"))
            .drop("sw"))
