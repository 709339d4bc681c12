"""Substring dedup: near-equal paragraphs found by MinHash banding.

Paragraphs are lines of at least ``min_words`` words and, from each shorter
line on, the fewest following shorter lines that reach ``min_words`` words with
it (so they overlap); they are compared as sets of five-word shingles. Bands are tuned so that a pair at the threshold collides with
probability ``recall`` or more. Colliding paragraphs form families, in which
the exact Jaccard of the whole shingle sets decides (``join_points``, by
bounded cells, so a passage may recur in any number of documents). Linked
paragraphs are closed to components; each component keeps its first
occurrence, by document id and position, and the others are removed. A line of
several paragraphs is removed if one of them is, unless one is kept as the first.

Defined cases: null and empty texts have no paragraphs; shorter lines that do
not reach ``min_words`` words before the next long line are never removed; a paragraph repeated within one document counts like one of
another document; rows that agree in id and text are treated alike, as one
document; null ids come last; an empty table gives no rows; other columns are
ignored by ``paragraph_repeats`` and kept by ``remove_repeats``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, discard, near_slots, written
from .jaccard_join import families, join_points
from .passages import passages
from .shingles import digests, list_array, mix, shingle_sets

K = 5
PERCENT = 80
MIN_WORDS = 20
ROWS = 3
RECALL = 0.999


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """The fewest bands with which a pair at the threshold collides with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))


def band_keys(off: np.ndarray, h: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """[sets, bands] of a run of non-empty sets."""
    rng = np.random.default_rng(97)
    out = np.empty((len(off) - 1, bands), np.uint64)
    for band in range(bands):
        key = np.full(len(off) - 1, band + 1, np.uint64)
        for _ in range(rows):
            odd, add = rng.integers(1, 2 ** 63, 2, dtype=np.uint64)
            low = np.minimum.reduceat(h * (odd * np.uint64(2) + np.uint64(1)) + add, off[:-1])
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low)
        out[:, band] = key
    return out


def _paragraphs(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Paragraph offsets of the rows, and the paragraphs."""
    lines = pc.split_pattern(texts.fill_null("").cast(pa.large_string()), "\n")
    off = lines.offsets.to_numpy()
    return off - off[0], lines.flatten()


def _short_runs(off: np.ndarray, words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First line and number of lines of the paragraphs that begin at lines of
    fewer than ``min_words`` words (but some), within the rows of ``off``."""
    total = np.concatenate([[0], np.cumsum(words)])
    first = np.flatnonzero((words > 0) & (words < min_words))
    last = np.searchsorted(total, total[first] + min_words, "left") - 1  # the line that reaches min_words
    ends = np.union1d(off, np.flatnonzero(words >= min_words))  # a run goes to the next row or long line
    bound = ends[np.searchsorted(ends, first, "right")] if len(first) else first
    fits = last < bound
    return first[fits], (last - first + 1)[fits]


def _joined(lines: pa.Array, first: np.ndarray, span: np.ndarray) -> pa.Array:
    return pa.array(["\n".join(lines.slice(a, n).to_pylist()) for a, n in zip(first.tolist(), span.tolist())], pa.large_string())


def _sketch(docs: DataFrame, k: int, min_words: int, rows: int, bands: int) -> DataFrame:
    """A row for each paragraph, with the characters of its lines, and one with
    pos -1 and the number of all lines for each text. Within a task, equal sets give bands once."""
    schema = "doc_id long, th long, pos int, chars array<long>, n long, s1 long, s2 long, bands array<long>"

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def paragraphs(batch, off, first, span, chars, soff, h):
            """Rows of the sets (soff, h) of the paragraphs at the lines ``first``."""
            s1, s2 = digests(soff, h)
            fresh = np.array([s not in seen and not seen.add(s) for s in s1.tolist()], bool)
            if len(seen) > 1 << 20:
                seen.clear()
            keys = band_keys(soff, h, rows, bands)[fresh]
            koff = np.concatenate([[0], np.cumsum(np.where(fresh, bands, 0))])
            own = np.searchsorted(off, first, "right") - 1
            coff = np.concatenate([[0], np.cumsum(span)])
            at = np.repeat(first - coff[:-1], span) + np.arange(coff[-1])
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)), pa.array((first - off[own]).astype(np.int32)),
                 list_array(coff, chars[at]), pa.array(np.diff(soff), pa.int64()),
                 pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), list_array(koff, keys.reshape(-1))], schema=_arrow)

        for batch in batches:
            off, lines = _paragraphs(batch.column(2))
            n_rows = len(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.full(n_rows, -1, np.int32)), pa.nulls(n_rows, pa.list_(pa.int64())),
                 pa.array(np.diff(off), pa.int64()), pa.nulls(n_rows, pa.int64()), pa.nulls(n_rows, pa.int64()),
                 pa.nulls(n_rows, pa.list_(pa.int64()))], schema=_arrow)
            chars = pc.utf8_length(lines).cast(pa.int64()).to_numpy()
            counted = []
            for first, soff, h, words in shingle_sets(lines, k, with_words=True):
                counted.append(words)
                use = np.flatnonzero(words >= min_words)
                if not len(use):
                    continue
                size = np.diff(soff)[use]
                used_off = np.concatenate([[0], np.cumsum(size)])
                used = h[np.repeat(soff[use] - used_off[:-1], size) + np.arange(size.sum())]
                yield paragraphs(batch, off, first + use, np.ones(len(use), np.int64), chars, used_off, used)
            first, span = _short_runs(off, np.concatenate([np.zeros(0, np.int64), *counted]), min_words)
            for row, soff, h in shingle_sets(_joined(lines, first, span), k):
                part = slice(row, row + len(soff) - 1)
                yield paragraphs(batch, off, first[part], span[part], chars, soff, h)

    return docs.mapInArrow(make, schema)


_arrow = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("chars", pa.list_(pa.int64())), ("n", pa.int64()),
                    ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _fetch(docs: DataFrame, k: int) -> DataFrame:
    """Sets of the wanted paragraphs (array ``wanted`` of first lines and numbers of lines) of each text."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, lines = _paragraphs(batch.column(0))
            wanted = [(int(off[i]) + p["pos"], p["span"]) for i, w in enumerate(batch.column(1).to_pylist()) for p in w]
            first, span = (np.array([w[i] for w in wanted], np.int64) for i in (0, 1))
            for _, soff, h in shingle_sets(_joined(lines, first, span), k):
                s1, s2 = digests(soff, h)
                yield pa.RecordBatch.from_arrays([pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), list_array(soff, h)],
                                                 names=["s1", "s2", "hashes"])

    return docs.mapInArrow(make, "s1 long, s2 long, hashes array<long>")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"),
                       F.col(text_col).alias("text"))


def paragraph_classes(docs: DataFrame, k: int = K, percent: int = PERCENT, min_words: int = MIN_WORDS, rows: int = ROWS,
                      recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(all paragraph rows with their class, classes with size and first occurrence)."""
    texts = _texts(docs, id_col, text_col)
    bands = bands_for(percent / 100, rows, recall)
    banded = written(_sketch(texts, k, min_words, rows, bands).withColumn("rid", F.monotonically_increasing_id()))
    found = written(families(banded.where("pos >= 0"), "bands"))
    lines = written(banded.drop("bands", "rid"))  # what is needed to the end, without the bands
    discard(banded)
    own = lines.where("pos >= 0")
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "th", "pos")
    spanned = F.struct(*(F.expr(c) for c in ("doc_id IS NULL AS late", "doc_id", "th", "pos", "size(chars) AS span")))
    distinct = own.groupBy("s1", "s2").agg(F.min(spanned).alias("at"), F.first("n").alias("n"))
    wanted = written(distinct.join(found, ["s1", "s2"]))
    discard(found)
    asked = wanted.groupBy(F.col("at.doc_id").alias("_id"), F.col("at.th").alias("_th")).agg(F.collect_set(F.struct("at.pos", "at.span")).alias("wanted"))
    asked = written(asked)
    sets = _fetch(near_slots(texts, asked).join(asked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("text", "wanted"), k)
    points = written(sets.dropDuplicates(["s1", "s2"]).join(wanted.select("s1", "s2", "family", "n"), ["s1", "s2"])
                     .select("family", F.xxhash64("s1", "s2").alias("point"), "n", "hashes"))
    discard(wanted, asked)
    merged = join_points(points, percent).withColumnRenamed("node", "point")
    discard(points)
    classed = (own.withColumn("point", F.xxhash64("s1", "s2")).join(merged, "point", "left")
               .select("doc_id", "th", "pos", "chars", F.coalesce("component", "point").alias("class")))
    whole = lines.where("pos < 0").select("doc_id", "th", F.col("n").alias("n_paragraphs"))
    classes = written(classed.groupBy("class").agg(F.count("*").alias("copies"), F.min(place).alias("keeper")).where("copies > 1"))
    return whole, classed.join(classes, "class").select(
        "doc_id", "th", "pos", "chars", "copies", "keeper",
        (~(F.col("keeper.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keeper.th") == F.col("th")) & (F.col("keeper.pos") == F.col("pos")))).alias("removed"))


def paragraph_repeats(docs: DataFrame, **options) -> DataFrame:
    """For each document: n_paragraphs (lines), n_repeated (lines of a paragraph with a near copy anywhere),
    n_removed, removed_chars, removed (positions of lines) and copies_of (documents that keep them)."""
    whole, repeats = paragraph_classes(docs, **options)
    lines = repeats.select("doc_id", "th", "pos", "keeper", F.col("removed").alias("copy"), F.posexplode("chars").alias("i", "chars"))
    lines = lines.groupBy("doc_id", "th", (F.col("pos") + F.col("i")).alias("pos")).agg(
        F.first("chars").alias("chars"), F.min("copy").alias("removed"), F.collect_set(F.when(F.col("copy"), F.col("keeper.doc_id"))).alias("keepers"))
    found = lines.groupBy("doc_id", "th").agg(
        F.count("*").alias("n_repeated"), F.count(F.when(F.col("removed"), 1)).alias("n_removed"),
        F.coalesce(F.sum(F.when(F.col("removed"), F.col("chars"))), F.lit(0)).alias("removed_chars"),
        F.sort_array(F.collect_set(F.when(F.col("removed"), F.col("pos")))).alias("removed"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("removed"), F.col("keepers")))))).alias("copies_of"))
    found = written(found.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "n_repeated", "n_removed",
                                 "removed_chars", "removed", "copies_of"))
    none = F.lit(0).cast("long")
    return (whole.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
            .select("doc_id", "th", "n_paragraphs", F.coalesce("n_repeated", none).alias("n_repeated"),
                    F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("removed_chars", none).alias("removed_chars"),
                    F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
                    F.coalesce("copies_of", F.array().cast("array<bigint>")).alias("copies_of")))


def with_passages(repeats: DataFrame, docs: DataFrame, **options) -> DataFrame:
    """The rows of ``paragraph_repeats`` with n_passages, passage_words and passage_copies_of
    of the verbatim passages of each document (``passages``), which need not keep to lines."""
    found = written(passages(docs, **options).select(
        F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.size("passages").cast("long").alias("n_passages"),
        F.aggregate("passages", F.lit(0).cast("long"), lambda n, p: n + p["words"]).alias("passage_words"), "passage_copies_of"))
    hit = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    none = F.lit(0).cast("long")
    return (repeats.join(found, hit, "left")
            .select(*columns(repeats), F.coalesce("n_passages", none).alias("n_passages"), F.coalesce("passage_words", none).alias("passage_words"),
                    F.coalesce("passage_copies_of", F.array().cast("array<bigint>")).alias("passage_copies_of")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All documents and columns, the text without its removed paragraphs."""
    gone = (paragraph_repeats(docs, id_col=id_col, text_col=text_col, **options).where("n_removed > 0")
            .select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("removed").alias("_removed"))
            .dropDuplicates(["_id", "_th"]))
    whole = docs.select(F.struct(*columns(docs)).alias("doc"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"),
                        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"))
    hit = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("_removed", i)), "\n")
    text = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(kept)
    return whole.join(gone, hit, "left").select(F.col("doc").withField(text_col, text).alias("doc")).select("doc.*")
