"""Verbatim passages: runs of words that occur at two places, whatever the lines.

A passage is a run of words each of which lies in a window of ``words`` words
that occurs, verbatim, at another place of the table (words as in
``shingles``). All such windows are found, in two steps:

1. Anchors. Of the grams of about half a window in each window the one of
   least hash is its anchor. Equal windows have equal anchors, so that only a
   window with an anchor that occurs at two places can occur twice.
2. Windows. Of the texts that hold such anchors, the windows with these as their
   anchors are compared as a whole by 64-bit hash. The document of least id that has a
   window is named by the others.

Defined cases: null and empty texts and those of fewer words have no passage;
a passage repeated within one document counts like one of another document;
rows that agree in id and text are one document; null ids come last; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, near_slots, written
from .shingles import _BASE, _INVERSE, _power, mix, word_hashes

WORDS = 50


def gram_hashes(words: np.ndarray, m: int) -> np.ndarray:
    """Hashes of all runs of ``m`` words of one text."""
    n = len(words)
    if n < m:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _power(_BASE, n), out=sums[1:])
    return mix((sums[m:] - sums[:-m]) * _power(_INVERSE, n + 1)[:n - m + 1] ^ np.uint64(m))


def anchor_places(h: np.ndarray, size: int) -> np.ndarray:
    """The place of the anchor of each window of ``size`` words, from the hashes of the grams."""
    span = size - size // 2 + 1
    if len(h) < span:
        return np.zeros(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(h, span).argmin(axis=1) + np.arange(len(h) - span + 1)


def anchors(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of one text's windows of ``size`` words, each once."""
    h = gram_hashes(words, size // 2)
    at = np.unique(anchor_places(h, size))
    return at, h[at]


def _texts_of(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, np.ndarray]]:
    for row, off, words in word_hashes(batch.column(text)):
        for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            yield row + i, words[a:b]


def _rows(batch: pa.RecordBatch, found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(doc_id, th, pos, h) of the places and hashes of the batch's rows."""
    own = pa.array(np.repeat([r for r, _, _ in found], [len(p) for _, p, _ in found]).astype(np.int64))
    pos = np.concatenate([np.zeros(0, np.int64), *[p for _, p, _ in found]])
    h = np.concatenate([np.zeros(0, np.uint64), *[h for _, _, h in found]])
    return pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(pos), pa.array(h.view(np.int64))],
                                      names=["doc_id", "th", "pos", "h"])


def _anchor_rows(size: int):
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows(batch, [(row, *anchors(words, size)) for row, words in _texts_of(batch, 2)])

    return make


def _window_rows(size: int):
    """Windows whose own anchor is one of those at ``marks``; others that hold it have another anchor."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row, words in _texts_of(batch, 2):
                marks = batch.column(3)[row].values.to_numpy()
                at = np.flatnonzero(np.isin(anchor_places(gram_hashes(words, size // 2), size), marks))
                found.append((row, at, gram_hashes(words, size)[at]))
            yield _rows(batch, found)

    return make


def _recurring(rows: DataFrame) -> DataFrame:
    """The rows whose hash has two places, with ``first``: the least document id of the hash, null if all are null.
    Rows are shuffled once, by hash; places are compared by 64-bit hash, made after the shuffle, so that they are flat numbers."""
    place = F.xxhash64("doc_id", "th").bitwiseXOR(F.col("pos"))
    same = Window.partitionBy("h")
    return (rows.repartition("h").withColumn("place", place)
            .select("doc_id", "th", "pos", F.min("place").over(same).alias("a"), F.max("place").over(same).alias("b"),
                    F.min("doc_id").over(same).alias("first"))
            .where("a != b").drop("a", "b"))


def _covered(starts: Column, size: int) -> Column:
    """Passages (word, words) of ascending window starts: windows that overlap or touch are one."""
    start = F.struct(F.lit(0).cast("long").alias("word"), F.lit(0).cast("long").alias("words"))
    none = F.array().cast("array<struct<word:bigint,words:bigint>>")
    one = lambda p, n: F.struct(p.alias("word"), n.alias("words"))
    closed = F.aggregate(
        starts, F.struct(none.alias("done"), start.alias("run")),
        lambda acc, p: F.when(acc["run"]["words"] == 0, F.struct(acc["done"].alias("done"), one(p, F.lit(size).cast("long")).alias("run")))
        .when(p <= acc["run"]["word"] + acc["run"]["words"],
              F.struct(acc["done"].alias("done"), one(acc["run"]["word"], p + size - acc["run"]["word"]).alias("run")))
        .otherwise(F.struct(F.concat(acc["done"], F.array(acc["run"])).alias("done"), one(p, F.lit(size).cast("long")).alias("run"))),
        lambda acc: F.when(acc["run"]["words"] == 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["run"]))))
    return closed


def passages(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, passages, passage_copies_of) of the documents with passages:
    their first word and number of words, and other documents that hold the first copies."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"),
                        F.col(text_col).alias("text"))
    schema = "doc_id long, th long, pos long, h long"
    marked = _recurring(texts.mapInArrow(_anchor_rows(words), schema))
    marks = written(marked.groupBy("doc_id", "th").agg(F.collect_set(F.col("pos").cast("int")).alias("marks"))
                    .withColumnRenamed("doc_id", "_id").withColumnRenamed("th", "_th"))
    asked = near_slots(texts, marks).join(marks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    asked = written(asked.select("doc_id", "th", "text", "marks"))  # smaller than the shuffled texts, which go before windows come
    discard(marks)
    windows = _recurring(asked.mapInArrow(_window_rows(words), schema))
    other = F.when(~F.col("doc_id").eqNullSafe(F.col("first")), F.col("first"))
    own = written(windows.groupBy("doc_id", "th")
                  .agg(F.sort_array(F.collect_set(F.col("pos").cast("int"))).cast("array<long>").alias("starts"), F.sort_array(F.collect_set(other)).alias("passage_copies_of"))
                  .select("doc_id", "th", _covered(F.col("starts"), words).alias("passages"), "passage_copies_of"))
    discard(asked)
    return own
