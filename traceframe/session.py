"""Session construction and cluster-safe helpers.

Library code never creates its own session: operators take DataFrames. This
module builds the session for tests, bench and the driver entry, and resolves
the shared checkpoint folder that lineage cuts use.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

# Settings every session of ours needs for correct results (UTC event time,
# adaptive execution for skew and partition coalescing).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.cteRecursionRowLimit": "-1",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "traceframe", extra: dict | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or f"local[{cpus}]")
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
    conf.setdefault("spark.driver.memory", "16g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the correctness settings to an existing session (driver-made)."""
    for k in ("spark.sql.session.timeZone", "spark.sql.mapKeyDedupPolicy"):
        spark.conf.set(k, BASE_CONF[k])
    try:
        spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    except Exception:  # pragma: no cover - older runtimes
        pass
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    On a cluster it is the one that ``spark.checkpoint.dir`` names; without
    that setting a cluster job fails rather than write where executors cannot
    read. Only a local session (tests) gets a folder of its own, in the
    warehouse, that goes when the process ends.
    """
    sc = spark.sparkContext
    if current := sc.getCheckpointDir():
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch_{uuid.uuid4().hex}"
        atexit.register(shutil.rmtree, urlsplit(configured).path, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read again: cuts the lineage,
    survives lost executors, and can be removed by ``discard``."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables made by ``stored`` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
