"""Ranked lexical search with a document FP-tree.

The terms of a block of items make a restricted vocabulary. One pass over the
documents keeps of each text its length in terms and its restricted vector
(terms and counts); corpus size, length and document frequencies are
aggregates of these rows. A second pass sorts each bounded block of vectors in
frequency order, most frequent term first, so that documents share trie paths:

* a node is a run of documents with a common prefix; chains of nodes with one
  child are one node, and small neighbouring children share a leaf;
* a node keeps, for each term below it, the largest count, and the smallest
  length factor m, which together bound each term's part of a score, exactly
  and in integers, since the part rises with the count and falls with m;
* an item goes depth first into the child with the highest bound and leaves
  out children that cannot reach its least kept score. A child that could tie
  is entered, since ties go by document id.

Each task keeps the best of every item over its blocks; these are cut again by
item and a share of the ids, then by item alone. Nothing is skipped but what
the bound excludes, so the ranking is exact.

Defined cases: a null or termless text is no document and matches nothing; an
item without known terms has no rows; equal rows of items are one item;
repeated documents are ranked one by one, null document ids behind others of
equal score; very long texts are read in slices; other columns are ignored; an
empty table on either side gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

#: Characters of items searched in one pass; their vocabulary and document frequencies are held by the driver.
BLOCK_CHARS = 1 << 22
#: Documents and vector entries of one tree.
TREE_DOCS = 1 << 13
TREE_ENTRIES = 1 << 21
LEAF_DOCS = 48
SLICE_BYTES = 1 << 20
TOP = 20
SHARES = 32

#: ASCII letters (lower case), digits and all that is not ASCII, in UTF-8.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in bounded lists cut between terms."""
    raw = (text or "").encode("utf-8")
    start = 0
    while len(raw) - start > SLICE_BYTES:
        cut = _BREAK.search(raw, start + SLICE_BYTES)
        if not cut:
            break
        yield TERM.findall(raw[start:cut.start()].lower())
        start = cut.start()
    yield TERM.findall(raw[start:].lower())


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's share of a score, before its weight."""
    return 1000000000 * tf // (1000 * tf + 12 * m)


def _vectors(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tf) of the documents with at least one term; terms are places in the vocabulary."""
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(vocabulary)}
        for batch in batches:
            row, length, off, found, tf = [], [], [0], [], []
            for i, value in enumerate(batch.column(1)):
                n, have = 0, Counter()
                for run in terms(value.as_py()):
                    n += len(run)
                    have.update(filter(place.__contains__, run))
                if n:
                    row.append(i)
                    length.append(n)
                    found += [place[t] for t in have]
                    tf += have.values()
                    off.append(len(found))
            offsets = pa.array(off, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(length, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(found, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))], names=["doc_id", "n", "terms", "tf"])

    return docs.mapInArrow(make, "doc_id long, n long, terms array<int>, tf array<long>")


class FPTree:
    """A block of documents as a trie. ``docs`` are (first entry of each
    document); entries hold ranks in frequency order and counts. Children of a
    node have consecutive numbers, so their bounds are one slice of entries."""

    def __init__(self, off: np.ndarray, rank: np.ndarray, tf: np.ndarray, m: np.ndarray, leaf_docs: int = LEAF_DOCS):
        order = np.argsort(np.repeat(np.arange(len(m)), np.diff(off)) * (1 << 32) + rank, kind="stable")
        rank, tf = rank[order], tf[order]
        paths = [rank[a:b].astype(">u4").tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        self.order = np.array(sorted(range(len(paths)), key=paths.__getitem__), np.int64)
        size = np.diff(off)[self.order]
        self.off = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(off[self.order] - self.off[:-1], size) + np.arange(self.off[-1])
        self.rank, self.tf, self.m = rank[take], tf[take], m[self.order]
        self.part = part(self.tf, np.repeat(self.m, size))
        self._grow(leaf_docs)
        self._bound()

    def _grow(self, leaf_docs: int) -> None:
        """Nodes as runs [lo, hi) of documents; ``kids`` is the range of a node's children, empty for a leaf."""
        n = len(self.m)
        size = np.diff(self.off)
        lo, hi, kids, level = [0], [n], [(0, 0)], [0]
        node, depth = 0, [0]
        while node < len(lo):
            a, b, d = lo[node], hi[node], depth[node]
            if b - a > leaf_docs:
                # The longest common path of the run is that of its first and last document.
                both = min(size[a], size[b - 1])
                differ = np.flatnonzero(self.rank[self.off[a]:self.off[a] + both] != self.rank[self.off[b - 1]:self.off[b - 1] + both])
                d = int(differ[0]) if len(differ) else int(both)
                at = np.minimum(self.off[a:b] + d, len(self.rank) - 1)
                step = np.where(size[a:b] > d, self.rank[at], -1)
                cuts = [a, *(a + 1 + np.flatnonzero(step[1:] != step[:-1])).tolist(), b]
                first, run = len(lo), [cuts[0]]
                for c, e in zip(cuts[1:-1], cuts[2:]):
                    if e - run[-1] > leaf_docs:
                        run.append(c)
                run.append(b)
                if len(run) > 2:
                    for c, e in zip(run[:-1], run[1:]):
                        lo.append(c)
                        hi.append(e)
                        kids.append((0, 0))
                        level.append(level[node] + 1)
                        depth.append(d)
                    kids[node] = (first, len(lo))
            node += 1
        self.lo, self.hi, self.kids, self.level = np.array(lo), np.array(hi), kids, np.array(level)

    def _bound(self) -> None:
        """Largest count of each term below each node and smallest m, from the leaves up."""
        nodes = len(self.lo)
        inner = np.array([b > a for a, b in self.kids])
        parent = np.full(nodes, -1)
        for v, (a, b) in enumerate(self.kids):
            parent[a:b] = v
        owner = np.zeros(len(self.m), np.int64)
        least = np.full(nodes, np.iinfo(np.int64).max)
        for v in np.flatnonzero(~inner).tolist():
            owner[self.lo[v]:self.hi[v]] = v
            least[v] = self.m[self.lo[v]:self.hi[v]].min(initial=least[v])
        key = np.repeat(owner, np.diff(self.off)) << 32 | self.rank
        keys, tops = [], []
        waiting_key, waiting_tf = _largest(key, self.tf)
        for depth in range(int(self.level.max()), -1, -1):
            here = self.level[waiting_key >> 32] == depth
            k, t = _largest(waiting_key[here], waiting_tf[here])
            keys.append(k)
            tops.append(t)
            up = parent[k >> 32]
            waiting_key = np.concatenate([waiting_key[~here], up[up >= 0] << 32 | (k[up >= 0] & 0xFFFFFFFF)])
            waiting_tf = np.concatenate([waiting_tf[~here], t[up >= 0]])
            at = np.flatnonzero(self.level == depth)
            np.minimum.at(least, parent[at][parent[at] >= 0], least[at][parent[at] >= 0])
        key, top = np.concatenate(keys), np.concatenate(tops)
        order = np.argsort(key)
        key, top = key[order], top[order]
        self.node_off = np.searchsorted(key >> 32, np.arange(nodes + 1))
        self.node_rank = key & 0xFFFFFFFF
        self.node_part = part(top, least[key >> 32])

    def search(self, worth: np.ndarray, best: Best) -> None:
        """Offers ``best`` all documents that can be among its best; ``worth`` is the item's weight of each rank."""
        stack = [(np.iinfo(np.int64).max, 0)]
        while stack:
            bound, v = stack.pop()
            if bound < best.least:
                continue
            a, b = self.kids[v]
            if a == b:
                lo, hi = int(self.lo[v]), int(self.hi[v])
                best.offer(_sums(worth[self.rank[self.off[lo]:self.off[hi]]] * self.part[self.off[lo]:self.off[hi]],
                                 self.off[lo:hi + 1]), self.order[lo:hi])
                continue
            s, e = self.node_off[a], self.node_off[b]
            bounds = _sums(worth[self.node_rank[s:e]] * self.node_part[s:e], self.node_off[a:b + 1])
            for k in np.argsort(bounds, kind="stable").tolist():
                if bounds[k] >= best.least:
                    stack.append((int(bounds[k]), a + k))


def _largest(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the largest value of each."""
    if not len(key):
        return key, value
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.maximum.reduceat(value, first)


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs, empty ones included."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[off[1:] - off[0]] - total[off[:-1] - off[0]]


class Best:
    """The best documents of an item so far; ``least`` is the score that a further one needs."""

    def __init__(self, top: int):
        self.top, self.least = top, 1
        self.score, self.late, self.doc = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        self.ids: tuple[np.ndarray, np.ndarray] | None = None

    def block(self, doc: np.ndarray, late: np.ndarray) -> None:
        """Ids of the documents that ``offer`` names by place."""
        self.ids = doc, late

    def offer(self, score: np.ndarray, place: np.ndarray) -> None:
        fit = score >= self.least
        if not fit.any():
            return
        doc, late = self.ids
        score = np.concatenate([self.score, score[fit]])
        doc = np.concatenate([self.doc, doc[place[fit]]])
        late = np.concatenate([self.late, late[place[fit]]])
        keep = np.lexsort((doc, late, -score))[:self.top]
        self.score, self.doc, self.late = score[keep], doc[keep], late[keep]
        if len(keep) == self.top:
            self.least = max(1, int(self.score[-1]))


def _search(items: list[tuple[int, np.ndarray, np.ndarray]], rank_of: np.ndarray, documents: int, length: int, top: int,
            tree_docs: int, leaf_docs: int):
    """Best documents of each item in a task: (item, doc_id, score)."""
    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        held, docs, entries = [], 0, 0
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                ends = batch.column(2).offsets.to_numpy()[start + 1:] - batch.column(2).offsets[start].as_py()
                n = max(1, min(tree_docs - docs, int(np.searchsorted(ends, TREE_ENTRIES - entries, "right"))))
                part_ = batch.slice(start, n)
                held.append(part_)
                docs, entries, start = docs + part_.num_rows, entries + int(ends[part_.num_rows - 1]), start + part_.num_rows
                if docs >= tree_docs or entries >= TREE_ENTRIES:
                    yield held
                    held, docs, entries = [], 0, 0
        if held:
            yield held

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in items]
        worth = np.zeros(len(rank_of), np.int64)
        for held in blocks(batches):
            block = pa.Table.from_batches(held).combine_chunks()
            ids, found = block.column("doc_id").chunk(0), block.column("terms").chunk(0)
            late = ids.is_null().to_numpy(zero_copy_only=False)
            doc = ids.fill_null(0).to_numpy()
            off = found.offsets.to_numpy().astype(np.int64)
            rank = rank_of[found.values.to_numpy()[off[0]:off[-1]]]
            tf = block.column("tf").chunk(0)
            tf = tf.values.to_numpy()[tf.offsets[0].as_py():tf.offsets[len(tf)].as_py()]
            m = np.array([75 + 25 * n * documents // length for n in block.column("n").to_pylist()], np.int64)
            tree = FPTree(off - off[0], rank, tf, m, leaf_docs)
            for (_, place, value), mine in zip(items, best):
                worth[place] = value
                mine.block(doc, late)
                tree.search(worth, mine)
                worth[place] = 0
        for (item, _, _), mine in zip(items, best):
            yield pa.RecordBatch.from_arrays(
                [pa.array([item] * len(mine.doc), pa.int64()), pa.array(mine.doc, mask=mine.late), pa.array(mine.score)],
                names=["item", "doc_id", "score"])

    return make


def _cut(found: DataFrame, top: int, *also: str) -> DataFrame:
    window = Window.partitionBy("item", *also).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top)


def lexical_search(docs: DataFrame, queries: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS,
                   tree_docs: int = TREE_DOCS, leaf_docs: int = LEAF_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a
    score above 0, by falling score and rising id."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    items = queries.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null").distinct()
    blocks = max(1, -(-items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // block_chars))
    out = None
    for b in range(blocks):
        asked = [(r.item_id, Counter(t for run in terms(r.text) for t in run))
                 for r in items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).sort("item_id", "text").collect()]
        ranked = _ranked(texts, asked, top, tree_docs, leaf_docs)
        out = ranked if out is None else out.unionByName(ranked)
    return out


def _ranked(texts: DataFrame, asked: list[tuple[int, Counter]], top: int, tree_docs: int, leaf_docs: int) -> DataFrame:
    spark = texts.sparkSession
    vocabulary = sorted({t for _, have in asked for t in have})
    vectors = written(_vectors(texts, vocabulary))
    documents, length = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the vocabulary
        df[r["t"]] = r["count"]
    place = {t: i for i, t in enumerate(vocabulary)}
    rank_of = np.zeros(len(vocabulary), np.int64)
    rank_of[np.argsort(-df, kind="stable")] = np.arange(len(vocabulary))
    items = []
    for i, (_, have) in enumerate(asked):
        use = [t for t in have if df[place[t]]]
        items.append((i, rank_of[[place[t] for t in use]].astype(np.int64),
                      np.array([have[t] * weight(documents, int(df[place[t]])) for t in use], np.int64)))
    made = vectors.where(F.size("terms") > 0).mapInArrow(_search(items, rank_of, documents, length, top, tree_docs, leaf_docs), "item long, doc_id long, score long")
    found = written(_cut(made.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES))), top, "share").select("item", "doc_id", "score"))
    discard(vectors)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(asked)], "item long, item_id long")
    return _cut(found, top).join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


QUERY_SQL = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents WHERE text IS NOT NULL),
q AS (
  SELECT item_id, t, count(*) AS qf FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark WHERE text IS NOT NULL) GROUP BY item_id, t),
lens AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lens),
m AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM lens, s),
tf AS (SELECT doc_id, t, count(*) AS tf FROM d WHERE t IN (SELECT t FROM q) GROUP BY doc_id, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
      FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), s),
scored AS (
  SELECT item_id, doc_id, CAST(sum(qf * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""
