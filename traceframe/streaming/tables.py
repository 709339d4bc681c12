"""Incremental materialisation of event streams into tables of rows.

A micro-batch is cut into row types; each goes to a folder of its own under the
store, and a small manifest entry, put in place by one rename, commits them all
at once. Readers see committed folders only: a batch that failed half way is
invisible, and one that is delivered again is skipped. Replace-by-id and merge
rules (S7 to S9, W2, J1) are applied on read, so no batch rewrites a table.
``compact`` joins the folders of many batches into one and commits that in
their place, which bounds the number of files. A store has one writer at a
time, the driver of its stream.

Defined cases: a row type without rows in a batch gets no folder; an empty
store reads as None for each type; null ids never occur, as rows are named by
their place in the stream.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import pairing as PA
from ..operators import process as P
from ..operators import resources as R
from ..operators import tokens as T

MANIFEST = "_manifest"


@dataclass(frozen=True)
class RowType:
    """``rows`` takes the rows of this type from a batch of events, each by
    itself; ``tables`` makes the tables of all rows committed so far."""

    rows: Callable[[DataFrame], DataFrame]
    tables: Callable[[DataFrame], dict[str, DataFrame]]


def _process_rows(canon: DataFrame) -> DataFrame:
    return canon.where(F.col("event").isin("EXEC", "EXIT"))


def _call_tables(events: DataFrame) -> dict[str, DataFrame]:
    calls = PA.call_rows(events, PA.pair_llm_calls(events))
    return {"llm_calls": calls, "token_usage": PA.call_token_rows(calls)}


def _once_each(rows: DataFrame, key: str = "seq") -> DataFrame:
    return rows.dropDuplicates([key])


#: Canonical events: audit events, network targets and processes.
EVENT_ROWS = {
    "audit_events": RowType(P.audit_from_events, lambda r: {"audit_events": T.latest_calls(r)}),
    "network_rows": RowType(A.network_rows, lambda r: {"network_targets": A.network_targets(r)}),
    "process_rows": RowType(_process_rows, lambda r: {"process_nodes": P.process_nodes(_once_each(r))}),
}
#: Resource samples: typed samples, and statistics by process.
SAMPLE_ROWS = {"resource_samples": RowType(R.resource_rows, lambda r: {"resource_samples": _once_each(r), "resource_stats": R.resource_stats(_once_each(r))})}
#: Requests and responses: calls and their tokens.
CALL_ROWS = {"llm_events": RowType(lambda e: e, _call_tables)}


class Store:
    """The committed folders of a materialised stream."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _entries(self) -> dict[str, dict]:
        """Manifest entries by name: one a batch since the last compaction, and the compactions kept."""
        if not self._fs.exists(self._at(MANIFEST)):
            return {}
        out = {}
        for status in self._fs.listStatus(self._at(MANIFEST)):
            name = status.getPath().getName()
            if name.endswith(".json"):
                stream = self._fs.open(status.getPath())
                try:
                    out[name] = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                finally:
                    stream.close()
        return out

    def _current(self, entries: dict[str, dict] | None = None) -> tuple[int, dict[str, dict]]:
        """The batch up to which rows are compacted (-1: none), and the entries that count."""
        entries = self._entries() if entries is None else entries
        through = max([e["through"] for e in entries.values() if "through" in e], default=-1)
        return through, {n: e for n, e in entries.items() if e.get("through") == through or e.get("batch", -1) > through}

    def committed(self, batch_id: int) -> bool:
        through, entries = self._current()
        return batch_id <= through or any(e.get("batch") == batch_id for e in entries.values())

    def _commit(self, name: str, entry: dict) -> None:
        self._fs.mkdirs(self._at(MANIFEST))
        draft = self._at(f"{MANIFEST}/{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(entry), "utf-8"))
        finally:
            out.close()
        if not self._fs.rename(draft, self._at(f"{MANIFEST}/{name}.json")):
            raise RuntimeError(f"{name} was committed by another writer of {self.path}")

    def _write(self, kind: str, rows: DataFrame, files: int | None = None) -> str | None:
        folder = f"{kind}/{uuid.uuid4().hex}"
        (rows if files is None else rows.repartition(files)).write.parquet(f"{self.path}/{folder}")
        written = [s for s in self._fs.listStatus(self._at(folder)) if s.getPath().getName().startswith("part-")]
        return folder if written else None

    def add(self, batch_id: int, rows: dict[str, DataFrame]) -> None:
        """Writes and commits the rows of a batch; nothing if it is committed already."""
        if not self.committed(batch_id):
            folders = {kind: self._write(kind, df) for kind, df in rows.items()}
            self._commit(f"batch-{batch_id:012d}", {"batch": batch_id, "folders": {k: [f] for k, f in folders.items() if f}})

    def folders(self, kind: str) -> list[str]:
        return sorted(f for e in self._current()[1].values() for f in e["folders"].get(kind, []))

    def read(self, kind: str) -> DataFrame | None:
        folders = self.folders(kind)
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders]) if folders else None

    def compact(self, files: int = 8) -> None:
        """Joins all committed folders of a type into one of ``files`` files. What
        an earlier compaction replaced is removed now, so that readers of the
        state before this one can finish."""
        entries = self._entries()
        through, now = self._current(entries)
        last = max([e["batch"] for e in now.values() if "batch" in e], default=None)
        if last is None:
            return
        kinds = sorted({k for e in now.values() for k in e["folders"]})
        folders = {k: self._write(k, self.read(k), files) for k in kinds}
        self._commit(f"compact-{last:012d}", {"through": last, "folders": {k: [f] for k, f in folders.items() if f}})
        for name, entry in entries.items():
            if name not in now:
                for f in (f for fs in entry["folders"].values() for f in fs):
                    self._fs.delete(self._at(f), True)
                self._fs.delete(self._at(f"{MANIFEST}/{name}"), False)


def materialize_batch(events: DataFrame, out_dir: str, batch_id: int, row_types: dict[str, RowType] | None = None) -> None:
    """One micro-batch of events to rows of all types, committed at once."""
    store = Store(events.sparkSession, out_dir)
    if store.committed(batch_id):
        return
    kept = events.persist()  # read once, not once for each row type
    try:
        store.add(batch_id, {name: t.rows(kept) for name, t in (row_types or EVENT_ROWS).items()})
    finally:
        kept.unpersist()


def materialize_stream(events: DataFrame, out_dir: str, checkpoint: str, trigger_once: bool = True,
                       row_types: dict[str, RowType] | None = None, compact_every: int | None = 100):
    """Starts the incremental materialisation (checkpointed, restartable);
    every ``compact_every`` batches the store is compacted."""
    def batch(df: DataFrame, batch_id: int) -> None:
        materialize_batch(df, out_dir, batch_id, row_types)
        if compact_every and batch_id % compact_every == compact_every - 1:
            Store(df.sparkSession, out_dir).compact()

    w = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (w.trigger(availableNow=True) if trigger_once else w).start()


def read_materialized(spark: SparkSession, out_dir: str, row_types: dict[str, RowType] | None = None) -> dict[str, DataFrame | None]:
    """The tables of all committed rows; None under a type's own name if it has none."""
    store, out = Store(spark, out_dir), {}
    for name, t in (row_types or EVENT_ROWS).items():
        rows = store.read(name)
        out |= t.tables(rows) if rows is not None else {name: None}
    return out
