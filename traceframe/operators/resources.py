"""Resource samples: peaks, per-process stats, CPU/IO deltas, family rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scan import prev_value

TICKS_PER_SECOND = 100


def resource_rows(samples: DataFrame, cpu_col: str = "cpu", rss_col: str = "rss_mb") -> DataFrame:
    """numbers may arrive as strings; negative RSS clamps to 0."""
    cpu = F.expr(f"try_cast(cast({cpu_col} as string) as double)")
    rss = F.expr(f"try_cast(cast({rss_col} as string) as double)")
    return samples.select(
        "seq", "timestamp_ms", "pid", "comm",
        cpu.alias("cpu_percent"),
        F.floor(F.greatest(rss, F.lit(0.0))).cast("bigint").alias("rss_mb"))


def resource_peaks(samples: DataFrame) -> DataFrame:
    """Max CPU, max RSS (clamped at 0) and sample count."""
    return samples.agg(
        F.coalesce(F.max("cpu_percent"), F.lit(0.0)).alias("max_cpu_percent"),
        F.coalesce(F.max(F.greatest(F.col("rss_mb"), F.lit(0))), F.lit(0)).cast("bigint").alias("max_rss_mb"),
        F.count(F.lit(1)).alias("samples"))


def resource_stats(samples: DataFrame) -> DataFrame:
    """Per (pid, comm) average/max CPU and memory, sample count."""
    return samples.groupBy("pid", "comm").agg(
        F.round(F.avg("cpu_percent"), 4).alias("avg_cpu_percent"),
        F.max("cpu_percent").alias("max_cpu_percent"),
        F.round(F.avg("rss_mb"), 4).alias("avg_rss_mb"),
        F.max("rss_mb").alias("max_rss_mb"),
        F.count(F.lit(1)).alias("samples"))


def cpu_io_delta(proc: DataFrame, tps: int = TICKS_PER_SECOND, bucket_ms: int = 3_600_000) -> DataFrame:
    """CPU percent, CPU ms and IO deltas between consecutive samples of a
    process instance (pid, starttime). The first sample uses the lifetime
    average ``ticks / tps / (uptime - start / tps)``; deltas never go negative. The
    previous sample comes from a two-level lag, so an instance is no single
    window.
    """
    last = ["ticks", "sample_ts", "read_bytes", "write_bytes"]
    proc = prev_value(proc.withColumn("_now", F.struct(*last)), ["pid", "starttime_ticks"], F.expr(f"sample_ts div {int(bucket_ms)}"),
                      ["sample_ts", "seq"], "_now", "_last")
    prev_ts = F.col("_last.sample_ts")
    d_ticks = F.greatest(F.col("ticks") - F.col("_last.ticks"), F.lit(0))
    d_wall_s = (F.col("sample_ts") - prev_ts) / 1000
    lifetime = (F.col("ticks") / tps) / F.greatest(
        F.col("uptime_s") - F.col("starttime_ticks") / tps, F.lit(0.001)) * 100
    cpu = F.when(prev_ts.isNotNull() & (d_wall_s > 0), (d_ticks / tps) / d_wall_s * 100).otherwise(lifetime)
    return proc.select(
        "seq", "sample_ts", "pid", "starttime_ticks", "rss_kb",
        F.round(cpu, 4).alias("cpu_percent"),
        F.coalesce(d_ticks * (1000 // tps), F.lit(0)).cast("bigint").alias("cpu_ms"),
        F.coalesce(F.greatest(F.col("read_bytes") - F.col("_last.read_bytes"), F.lit(0)), F.lit(0))
         .cast("bigint").alias("read_delta"),
        F.coalesce(F.greatest(F.col("write_bytes") - F.col("_last.write_bytes"), F.lit(0)), F.lit(0))
         .cast("bigint").alias("write_delta"))


def family_metrics(proc: DataFrame, lineage: DataFrame, snapshot_ms: int = 60_000,
                   cpu_threshold: float = 80.0, rss_threshold_mb: float = 1024.0) -> DataFrame:
    """Per root process and snapshot the summed CPU%, RSS and VSZ of its family.

    Samples are aligned to ``snapshot_ms`` buckets (the latest sample of each
    pid per bucket stands for that snapshot), then summed over the family
    given by ``lineage`` (pid → root_pid), and flagged above the thresholds.
    """
    snap = (proc.withColumn("snapshot", F.expr(f"sample_ts div {int(snapshot_ms)}"))
            .groupBy("pid", "snapshot")
            .agg(F.max_by(F.struct("cpu_percent", "rss_kb", "vsz_kb"), F.struct("sample_ts", "seq")).alias("_l")))
    fam = snap.join(lineage.select("pid", "root_pid"), "pid")
    out = fam.groupBy("root_pid", "snapshot").agg(
        F.round(F.sum("_l.cpu_percent"), 4).alias("cpu_percent"),
        (F.sum("_l.rss_kb") / 1024).alias("rss_mb"),
        (F.sum("_l.vsz_kb") / 1024).alias("vsz_mb"),
        F.count(F.lit(1)).alias("processes"))
    return out.withColumn("alert", (F.col("cpu_percent") > cpu_threshold)
                          | (F.col("rss_mb") > rss_threshold_mb))
