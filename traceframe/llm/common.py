"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.session import ensure_checkpoint_dir

#: Hash slots of ``near_slots``: its filter never has more rows.
SLOTS = 1 << 20
#: Rows of texts that go to Python at once: an executor holds several copies of a batch for each task.
BATCH_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
#: And shuffle files go as soon as the one query that reads them has ended.
WRITE_CONF = BATCH_ROWS | {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read again: cuts the lineage,
    survives lost executors, and lets Spark see its true size. The shuffle files
    of the write are removed with it, not when the driver collects its garbage."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in WRITE_CONF}
    for k, v in WRITE_CONF.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables made by ``written`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` computed once: inside lambdas of ``body`` the
    value is a bound variable and is not evaluated again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def near_slots(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id falls in the hash slot of one of ``ids``
    (``_id``): a filter of bounded size before an exact join, so that texts
    that are not asked for need not be shuffled."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    slots = ids.select(slot("_id").alias("_slot")).distinct()  # at most SLOTS small rows
    return docs.withColumn("_slot", slot(id_col)).join(F.broadcast(slots), "_slot", "left_semi").drop("_slot")


def columns(df: DataFrame, without: tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``df`` but for those named like an operator's own output, which replaces them."""
    gone = {n.lower() for n in without}
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in gone]


def vocabulary_path(name: str) -> str:
    """A vocabulary file by path, or by its name among the public tokenizers of the executor."""
    if os.path.isabs(name):
        return name
    import public_tokenizers
    return public_tokenizers.path(name)
