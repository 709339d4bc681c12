"""Skew-safe running scans per key.

A plain ``Window.partitionBy(key).orderBy(t)`` scan puts all rows of a key in
one task; if one pid or session owns a third of the data, that task owns a
third of the job. These helpers split the scan in two levels:

1. a local window over ``(key, bucket)`` where ``bucket`` is a coarse,
   order-compatible column (e.g. ``timestamp_ms div 60000``), so no task sees
   more than one bucket of one key;
2. a carry computed on the per-(key, bucket) aggregate table (one row per
   bucket, so far smaller) and joined back on ``(key, bucket)``.

The result equals the single-window scan exactly, because buckets are
contiguous ranges of the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, keys: list[str], bucket: Column, order: list[str],
                value: Column, out: str, inclusive: bool = True) -> DataFrame:
    """Running sum of ``value`` per ``keys`` in ``order`` (``bucket`` must be a
    non-decreasing function of ``order``)."""
    x = df.withColumn("_bk", bucket).withColumn("_v", value)
    w_local = (Window.partitionBy(*keys, "_bk").orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.withColumn("_local", F.sum("_v").over(w_local))
    blocks = x.groupBy(*keys, "_bk").agg(F.sum("_v").alias("_bsum"))
    w_blk = (Window.partitionBy(*keys).orderBy("_bk")
             .rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("_carry", F.coalesce(F.sum("_bsum").over(w_blk), F.lit(0))).drop("_bsum")
    x = x.join(blocks, keys + ["_bk"], "left")
    total = F.col("_carry") + F.col("_local")
    if not inclusive:
        total = total - F.col("_v")
    return x.withColumn(out, total).drop("_bk", "_v", "_local", "_carry")


def running_last(df: DataFrame, keys: list[str], bucket: Column, order: list[str],
                 value: Column, out: str) -> DataFrame:
    """Last non-null ``value`` at or before each row per ``keys`` in ``order``."""
    x = df.withColumn("_bk", bucket).withColumn("_v", value)
    w_local = (Window.partitionBy(*keys, "_bk").orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.withColumn("_local", F.last("_v", ignorenulls=True).over(w_local))
    ordkey = F.struct(*[F.col(c) for c in order])
    blocks = (x.groupBy(*keys, "_bk")
              .agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), ordkey)).alias("_blast")))
    w_blk = (Window.partitionBy(*keys).orderBy("_bk")
             .rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("_carry", F.last("_blast", ignorenulls=True).over(w_blk)).drop("_blast")
    x = x.join(blocks, keys + ["_bk"], "left")
    return x.withColumn(out, F.coalesce("_local", "_carry")).drop("_bk", "_v", "_local", "_carry")


def next_value(df: DataFrame, keys: list[str], bucket: Column, order: list[str],
               value: str, out: str) -> DataFrame:
    """``lead(value)`` per ``keys`` in ``order``, two-level: the local lead
    within (key, bucket), else the first value of the next non-empty bucket."""
    x = df.withColumn("_bk", bucket)
    w_local = Window.partitionBy(*keys, "_bk").orderBy(*order)
    x = x.withColumn("_local", F.lead(value).over(w_local))
    ordkey = F.struct(*[F.col(c) for c in order])
    blocks = x.groupBy(*keys, "_bk").agg(F.min_by(value, ordkey).alias("_bfirst"))
    w_blk = Window.partitionBy(*keys).orderBy("_bk")
    blocks = blocks.withColumn("_carry", F.lead("_bfirst").over(w_blk)).drop("_bfirst")
    x = x.join(blocks, keys + ["_bk"], "left")
    return x.withColumn(out, F.coalesce("_local", "_carry")).drop("_bk", "_local", "_carry")


def prev_value(df: DataFrame, keys: list[str], bucket: Column, order: list[str],
               value: str, out: str) -> DataFrame:
    """``lag(value)`` per ``keys`` in ``order``, two-level: the local lag
    within (key, bucket), else the last value of the previous non-empty bucket."""
    x = df.withColumn("_bk", bucket)
    w_local = Window.partitionBy(*keys, "_bk").orderBy(*order)
    x = x.withColumn("_local", F.lag(value).over(w_local))
    x = x.withColumn("_first", F.row_number().over(w_local) == 1)
    ordkey = F.struct(*[F.col(c) for c in order])
    blocks = x.groupBy(*keys, "_bk").agg(F.max_by(value, ordkey).alias("_blast"))
    w_blk = Window.partitionBy(*keys).orderBy("_bk")
    blocks = blocks.withColumn("_carry", F.lag("_blast").over(w_blk)).drop("_blast")
    x = x.join(blocks, keys + ["_bk"], "left")
    return (x.withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_local")))
            .drop("_bk", "_local", "_carry", "_first"))


def global_index(df: DataFrame, bucket: Column, order: list[str], out: str = "row_index") -> DataFrame:
    """0-based position of each row in a global order without a
    single-partition window: a running count over (bucket) blocks."""
    return running_sum(df, [], bucket, order, F.lit(1).cast("bigint"), out, inclusive=False)


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], step: float) -> DataFrame:
    """One row with the quantiles ``probs`` (name → probability) of a numeric
    column, linearly interpolated between ranks as ``percentile`` does, null
    without values. Values are counted first, so equal ones cost one row; ranks
    come from a running sum over value buckets of width ``step``, so no task
    and no aggregation buffer holds all values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_q")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sum(counts, [], F.floor(F.col("_q") / step), ["_q"], F.col("_n"), "_upto")
    total = counts.agg(F.sum("_n")).scalar()

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") > rank, F.col("_q")))

    picks = []
    for name, p in probs.items():
        place = F.lit(p) * (total - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        picks.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return ranked.agg(*picks)
