"""Timeline views: time distribution, gaps, anomalies, simultaneous events,
event-log summary, even sampling, display events and facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import global_index, prev_value
from ..session import stored


def _top_per(df: DataFrame, part: list[str], key: str, n: int, weight: str | None = None) -> DataFrame:
    """Counter-style top ``n`` values of ``key`` per ``part``: count desc, then
    first occurrence (``seq``). A row counts once, or ``weight`` times."""
    g = df.groupBy(*part, key).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("count"), F.min("seq").alias("_first"))
    w = Window.partitionBy(*part).orderBy(F.col("count").desc(), F.col("_first").asc())
    return g.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)


def time_buckets(events: DataFrame, bucket_s: int = 60, top: int = 10, top_sources: int = 3) -> DataFrame:
    """Events per bucket of ``bucket_s`` seconds since the first event
    (the start is a scalar subquery), the ``top`` busiest buckets with their
    ``top_sources`` sources as 'src:count' text."""
    t0 = events.agg(F.min("timestamp_ms")).scalar()
    e = events.withColumn("bucket", F.floor((F.col("timestamp_ms") - t0) / (bucket_s * 1000)).cast("bigint"))
    counts = e.groupBy("bucket").agg(F.count(F.lit(1)).alias("count"))
    topb = counts.orderBy(F.col("count").desc(), F.col("bucket").asc()).limit(top)
    srcs = _top_per(e.join(topb.select("bucket"), "bucket", "left_semi"), ["bucket"], "source", top_sources)
    summ = (srcs.groupBy("bucket")
            .agg(F.array_sort(F.collect_list(F.struct("_r", F.format_string("%s:%d", "source", "count").alias("t"))))
                 .alias("_s"))
            .select("bucket", F.array_join(F.col("_s.t"), ", ").alias("sources")))
    return topb.join(summ, "bucket", "left").withColumn("minute", F.col("bucket") * bucket_s / 60)


def time_summary(events: DataFrame, bucket_s: int = 60) -> DataFrame:
    """A26 + W7: duration, active and possible buckets, coverage, and the
    inactivity gaps between consecutive active buckets. The gap window runs
    over the per-bucket table (bounded by time span / bucket size)."""
    t0 = events.agg(F.min("timestamp_ms")).scalar()
    e = events.withColumn("bucket", F.floor((F.col("timestamp_ms") - t0) / (bucket_s * 1000)).cast("bigint"))
    active = e.groupBy("bucket").agg(F.max("timestamp_ms").alias("_m"))
    gaps = active.withColumn("_gap", F.col("bucket") - F.lag("bucket").over(Window.orderBy("bucket")) - 1)
    g = gaps.agg(
        F.count(F.lit(1)).alias("active_buckets"),
        ((F.max("_m") - t0) / 1000).alias("duration_s"),
        F.count_if(F.col("_gap") > 0).alias("gaps"),
        F.round(F.avg(F.when(F.col("_gap") > 0, F.col("_gap") * bucket_s)), 4).alias("avg_gap_s"),
        F.max(F.when(F.col("_gap") > 0, F.col("_gap") * bucket_s)).alias("max_gap_s"),
        F.coalesce(F.sum(F.when(F.col("_gap") > 0, F.col("_gap") * bucket_s)), F.lit(0)).alias("inactive_s"))
    total = F.floor(F.col("duration_s") / bucket_s).cast("bigint") + 1
    return g.select("duration_s", "active_buckets", total.alias("total_buckets"),
                    F.round(F.col("active_buckets") / total * 100, 4).alias("coverage_pct"),
                    "gaps", "avg_gap_s", "max_gap_s", "inactive_s")


def time_anomalies(events: DataFrame, max_lines: int = 10, min_gap_ms: int = 3_600_000,
                   block: int = 1 << 16) -> DataFrame:
    """Consecutive events of one (pid, tid) in line order that are at
    most ``max_lines`` lines apart but more than ``min_gap_ms`` apart in time."""
    x = prev_value(events, ["pid", "tid"], F.expr(f"seq div {block}"), ["seq"], "seq", "prev_seq")
    x = prev_value(x, ["pid", "tid"], F.expr(f"seq div {block}"), ["seq"], "timestamp_ms", "prev_ts")
    return (x.where(F.col("prev_seq").isNotNull()
                    & (F.col("seq") - F.col("prev_seq") <= max_lines)
                    & (F.abs(F.col("timestamp_ms") - F.col("prev_ts")) > min_gap_ms))
            .select("pid", "tid", "prev_seq", "seq", (F.abs(F.col("timestamp_ms") - F.col("prev_ts"))).alias("gap_ms")))


def simultaneous(events: DataFrame) -> DataFrame:
    """Groups of more than one event with the same pid, tid and second."""
    return (events.groupBy("pid", "tid", F.expr("timestamp_ms div 1000").alias("second"))
            .agg(F.count(F.lit(1)).alias("events"), F.min("seq").alias("first_seq"))
            .where(F.col("events") > 1))


def event_log_summary(flat: DataFrame, top: int = 5) -> DataFrame:
    """Totals, per-source counts, top commands and pids, time range, as
    (category, key, value) rows."""
    at = F.when(F.col("timestamp_ms") > 0, F.col("timestamp_ms"))
    # One pass over the log; all that follows is read from its counts.
    counted = stored(flat.groupBy("source", "comm", "pid", F.col("error").isNotNull().alias("bad")).agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"), F.min(at).alias("a"), F.max(at).alias("b")))
    valid = counted.where(~F.col("bad"))
    tot = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("bad"), F.col("n"))), F.lit(0)).alias("errors"))

    def row(cat, key, val):
        return F.struct(F.lit(cat).alias("category"), F.lit(key).alias("key"), val.cast("bigint").alias("value"))

    totals = tot.select(F.explode(F.array(
        row("totals", "total", F.col("total")), row("totals", "valid", F.col("total") - F.col("errors")),
        row("totals", "errors", F.col("errors")))).alias("r")).select("r.*")
    src = valid.groupBy(F.col("source").alias("key")).agg(F.sum("n").alias("value")) \
        .select(F.lit("source").alias("category"), "key", "value")
    comm = _top_per(valid.where(F.col("comm").isNotNull() & (F.col("comm") != "")).withColumn("_all", F.lit(1)),
                    ["_all"], "comm", top, "n").select(F.lit("comm").alias("category"), F.col("comm").alias("key"),
                                                       F.col("count").alias("value"))
    pid = _top_per(valid.where(F.col("pid") > 0).withColumn("_all", F.lit(1)), ["_all"], "pid", top, "n") \
        .select(F.lit("pid").alias("category"), F.col("pid").cast("string").alias("key"), F.col("count").alias("value"))
    rng = valid.agg(F.min("a").alias("a"), F.max("b").alias("b")) \
        .select(F.explode(F.array(row("range", "start_ms", F.col("a")),
                                  row("range", "end_ms", F.col("b")))).alias("r")).select("r.*")
    return totals.unionByName(src).unionByName(comm).unionByName(pid).unionByName(rng)


def sample_evenly(df: DataFrame, k: int = 20, bucket_ms: int = 3_600_000) -> DataFrame:
    """``k`` rows spread evenly over the time-ordered trace (every
    ``n div k``-th row); all rows when n <= k. Row positions come from a
    two-level running count, not a single-partition window."""
    n = df.agg(F.count(F.lit(1))).scalar()
    x = global_index(df, F.expr(f"timestamp_ms div {bucket_ms}"), ["timestamp_ms", "seq"], "_i")
    step = F.greatest(F.floor(n / k), F.lit(1))
    keep = (n <= k) | (((F.col("_i") % step) == 0) & ((F.col("_i") / step) < k))
    return x.where(keep).withColumnRenamed("_i", "sample_index")


def timeline_groups(events: DataFrame) -> DataFrame:
    """U4: per source: first/last time, count and relative position (0..1)
    within the whole range."""
    lo = events.agg(F.min("timestamp_ms")).scalar()
    hi = events.agg(F.max("timestamp_ms")).scalar()
    span = F.greatest(hi - lo, F.lit(1))
    g = events.groupBy("source").agg(F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"),
                                     F.count(F.lit(1)).alias("events"))
    return g.select("source", "start_ms", "end_ms", "events",
                    F.round((F.col("start_ms") - lo) / span, 6).alias("start_pos"),
                    F.round((F.col("end_ms") - lo) / span, 6).alias("end_pos"))


def filter_display_events(df: DataFrame, source: str | None = None, comm: str | None = None,
                          pid: int | None = None, text: str | None = None) -> DataFrame:
    """F16: exact source/comm/pid filters and a case-insensitive full-text
    match over all displayed fields."""
    cond = F.lit(True)
    if source:
        cond = cond & (F.col("source") == source)
    if comm:
        cond = cond & (F.col("comm") == comm)
    if pid is not None:
        cond = cond & (F.col("pid") == pid)
    if text:
        blob = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns]))
        cond = cond & blob.contains(text.lower())
    return df.where(cond)


def filter_options(events: DataFrame, facets=("kind", "model", "source", "comm")) -> DataFrame:
    """distinct values per facet as (facet, value) rows, sorted."""
    out = None
    for f in facets:
        part = events.where(F.col(f).isNotNull()).select(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out.distinct().orderBy("facet", "value")
