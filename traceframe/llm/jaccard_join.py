"""N-gram Jaccard join: an exact similarity self-join in Jaccard metric space.

Texts become sets of word shingles; equal sets are one point. The join then
works by regions, each small enough for a task, and never lists the pairs
within a group.

1. Region keys. The hash space is cut into ranges, as many for all sets of a
   size class. A set that differs from its partners in at most d elements
   gives the digests of its first d + 1 filled ranges as keys: the partner
   must agree on one of them and, reaching as far, give it too. (Small sets
   use pairs of d + 2 ranges, to be as selective.) Only points that share a
   key can be linked; points that share keys form families.
2. Regions. Families are told apart by their shingles: linked sets share one of
   their rarest (by the number of points of families that hold it), and what one
   point alone holds comes first and links nothing. Points that share one are
   finer families. (All families are, whatever their size, since by keys alone
   they grow together in a large table; ``join_points`` by itself does so for
   the larger ones.) A finer family of bounded size is one region. Those that
   are larger are dealt into cells; pivots, drawn from the family, go to
   each of its cells, and a cell measures each point's distance to the pivots
   and joins its own points.
3. Contraction. Links found so far merge points into groups. Points outside
   the largest group of their family are still open. The points are dealt into
   blocks of Voronoi regions, by the nearest pivot and the distance to it. By
   the triangle inequality blocks can only hold linked points if their ranges of
   distances to every pivot, widened by the radius, meet. A block with open
   points is replicated to those blocks, and each pair of blocks is joined
   exactly. What is in one group already needs no comparison.
4. Links of all steps are closed to components.

In a region all pairs are decided at once by products of 0/1 matrices over
blocks of shared shingles; a region returns a spanning set of its links, which
keeps every connection between different sets.

Defined cases: a null or wordless text has the empty set, links with nothing
and is its own component; fewer words than ``k`` make one shingle; equal sets
are linked; each input row gives one result row; rows with a null id count,
but do not name a component; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, discard, near_slots, written
from .components import components
from .shingles import digests, list_array, mix, shingle_sets

K = 4
PERCENT = 85
PIVOTS = 6
CELL_POINTS = 64
#: Blocks hold as many times the points of a cell.
BLOCK_CELLS = 2
CELL_SHINGLES = 1 << 20
#: Size classes grow by this factor; classes up to SMALL use pairs of ranges.
CLASS_STEP = 1.25
SMALL = 64
COLUMN_BLOCK = 1 << 13
#: Shingles of more points than this are equally common.
MOST_HOLDERS = (1 << 15) - 1
#: The lower half of the hashes lies below this (as signed numbers: from 0 on).
LOWER = np.uint64(1 << 63)


def most_differences(a: int, b: int, percent: int) -> int:
    """The most elements in which linked sets of these sizes differ: o >= p*u with u = o + d, a + b = 2o + d."""
    return (100 - percent) * (a + b) // (100 + percent)


class SizeClasses:
    """Classes [low, next low); level k serves pairs whose smaller set is in class k."""

    def __init__(self, largest: int, percent: int):
        self.percent = percent
        low = 1
        while most_differences(low, low * 100 // percent, percent) == 0:
            low += 1  # below, linked sets are equal
        self.lows = [low]
        while self.lows[-1] <= largest:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * CLASS_STEP)))

    def levels(self, n: int) -> list[int]:
        k = int(np.searchsorted(self.lows, n, "right")) - 1
        if k < 0:
            return []
        below = k > 0 and n <= (self.lows[k] - 1) * 100 // self.percent
        return [k, k - 1] if below else [k]

    def ranges(self, level: int) -> int:
        top = self.lows[level + 1] - 1
        return most_differences(top, top * 100 // self.percent, self.percent) + 3


def region_keys(h: np.ndarray, classes: SizeClasses) -> np.ndarray:
    """Keys of one ascending set."""
    n, p = len(h), classes.percent
    d = most_differences(n, n * 100 // p, p)
    keys = []
    for level in classes.levels(n):
        b = classes.ranges(level)
        at = ((h >> np.uint64(32)) * np.uint64(b)) >> np.uint64(32)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(h ^ np.uint64(0xA24BAED4963EE407)), out=sums[1:])
        cuts = np.searchsorted(at, np.arange(b + 1))
        digest = mix(sums[cuts[1:]] - sums[cuts[:-1]] + np.arange(b, dtype=np.uint64) + np.uint64(level << 32))
        pairs = classes.lows[level + 1] - 1 <= SMALL
        use = np.flatnonzero(cuts[1:] > cuts[:-1])[:d + 1 + pairs]
        if len(use) < d + 1 + pairs:
            use = np.arange(b)  # so few filled ranges that agreement may be on empty ones
        if pairs:
            i, j = np.triu_indices(len(use), 1)
            keys.append(mix(digest[use[i]] * np.uint64(3) + digest[use[j]]))
        else:
            keys.append(digest[use])
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """One row for each text (doc_id, text, th): id, text hash, size, number of hashes in the lower half, digests."""
    schema = "doc_id long, th long, n_shingles long, n_low long, s1 long, s2 long"

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, off, h in shingle_sets(batch.column(1), k):
                size = np.diff(off)
                s1, s2 = digests(off, h)
                lows = np.concatenate([[0], np.cumsum(h < LOWER)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(size)), batch.column(2).slice(row, len(size)), pa.array(size, pa.int64()),
                     pa.array(np.diff(lows[off]), pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64))],
                    names=["doc_id", "th", "n_shingles", "n_low", "s1", "s2"])

    return docs.mapInArrow(make, schema)


def _keyed(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(s1, s2, keys) of the texts: digests and region keys, which are cut to 48 bits (so
    they may agree by chance, and shuffle shorter). Within a task equal sets come once."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = SizeClasses(1 << 12, percent)
        seen: set[int] = set()
        for batch in batches:
            for _, off, h in shingle_sets(batch.column(0), k):
                size = np.diff(off)
                if len(size) and size.max() >= classes.lows[-1]:
                    classes = SizeClasses(int(size.max()), percent)
                s1, s2 = digests(off, h)
                use = [i for i, s in enumerate(s1.tolist()) if s not in seen and not seen.add(s)]
                keys = [region_keys(h[off[i]:off[i + 1]], classes) >> np.uint64(16) for i in use]
                koff = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s1[use].view(np.int64)), pa.array(s2[use].view(np.int64)),
                     list_array(koff, np.concatenate([np.zeros(0, np.uint64), *keys]))], names=["s1", "s2", "keys"])
                if len(seen) > 1 << 20:
                    seen.clear()

    return docs.select("text").mapInArrow(make, "s1 long, s2 long, keys array<long>")


def _key_sharers(keyed: DataFrame) -> DataFrame:
    """(point): those of (point, key) that share a key with another point."""
    first = F.min("point").over(Window.partitionBy("key").orderBy("point"))
    pairs = keyed.withColumn("a", first).where("a != point")
    return pairs.select(F.explode(F.array("a", "point")).alias("point")).distinct()


def _fetch(asked: DataFrame, k: int, keep: tuple[str, ...] = ("point", "n"), lower: bool = False) -> DataFrame:
    """The ``keep`` columns (long) and the hashes of stored whole texts; with ``lower`` only their lower half."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, off, h in shingle_sets(batch.column(len(keep)), k):
                if lower:
                    use = h < LOWER
                    off, h = np.concatenate([[0], np.cumsum(use)])[off], h[use]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(row, len(off) - 1) for i in range(len(keep))), list_array(off, h)],
                                                 names=[*keep, "hashes"])

    return asked.select(*keep, "text").mapInArrow(make, ", ".join(f"{c} long" for c in keep) + ", hashes array<long>")


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Intersection sizes of all sets of ``left`` with all of ``right`` (default:
    among themselves); never too small if values repeat in a set."""
    sets = left + (right or [])
    n, m = len(left), len(sets)
    out = np.zeros((n, n if right is None else len(right)), np.int64)
    values = np.concatenate([np.zeros(0, sets[0].dtype if sets else np.uint64), *sets])
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    alone = first & np.append(first[1:], True)
    column = np.cumsum(first & ~alone) - 1
    column, owner = column[~alone], owner[~alone]
    total = int(column[-1]) + 1 if len(column) else 0
    for c in range(0, total, COLUMN_BLOCK):
        lo, hi = np.searchsorted(column, [c, c + COLUMN_BLOCK])
        dense = np.zeros((m, min(COLUMN_BLOCK, total - c)), np.float32)
        np.add.at(dense, (owner[lo:hi], column[lo:hi] - c), 1)  # more than 1 only where cut hashes fall together
        out += np.rint(dense[:n] @ (dense[:n] if right is None else dense[n:]).T).astype(np.int64)
    return out


def linked(o: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * o >= percent * (n[:, None] + m[None, :] - o)


def spanning(mask: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links of a square mask."""
    root = list(range(len(mask)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*(v.tolist() for v in np.nonzero(np.triu(mask, 1)))):
        a, b = find(i), find(j)
        if a != b:
            root[b] = a
            out.append((i, j))
    return out


def _unpack(column: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for chunk in column.chunks:
        values = chunk.values.to_numpy(zero_copy_only=False)
        values = values.view(np.uint64) if values.dtype == np.int64 else values
        off = chunk.offsets.to_numpy()
        out.extend(values[a:b] for a, b in zip(off[:-1], off[1:]))
    return out


def _join_cell(percent: int):
    """Joins the points of a cell and measures them against the pivots of their family."""

    def join(cell: pa.Table) -> pa.Table:
        point = cell.column("point").to_pylist()
        sets = _unpack(cell.column("hashes"))
        pivot = np.array(cell.column("is_pivot").to_pylist(), bool)
        order = [int(i) for i in np.lexsort((point, pivot))]
        sets, point, n_own = [sets[i] for i in order], [point[i] for i in order], int((~pivot).sum())
        size = np.array([len(s) for s in sets])
        o = overlaps(sets)
        mask = linked(o, size, size, percent)
        rows = [(point[i], point[j], None) for i, j in spanning(mask) if point[i] != point[j]]
        if n_own < len(sets):
            far = 1 - o[:n_own, n_own:] / np.maximum(1, size[:n_own, None] + size[None, n_own:] - o[:n_own, n_own:])
            rows += [(p, None, d) for p, d in zip(point, far.tolist())]
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                         pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["a", "b", "far"])

    return join


def _join_blocks(percent: int):
    """Links between the points of two blocks, one pair of blocks a row."""

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                pa_, ha, pb, hb = (batch.column(i)[row].values for i in range(4))
                left, right = _unpack(pa.chunked_array([ha])), _unpack(pa.chunked_array([hb]))
                a, b = pa_.to_numpy(), pb.to_numpy()
                mask = linked(overlaps(left, right), np.array([len(s) for s in left]), np.array([len(s) for s in right]), percent)
                both = np.zeros((len(a) + len(b),) * 2, bool)
                both[:len(a), len(a):] = mask
                point = np.concatenate([a, b])
                found = [(int(point[i]), int(point[j])) for i, j in spanning(both) if point[i] != point[j]]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())],
                                                 names=["a", "b"])

    return join


def families(rows: DataFrame, keys: str) -> DataFrame:
    """(s1, s2, family) of stored rows (rid, s1, s2 and an array of keys): points
    that share a key, transitively, are a family; families of one point are left
    out. Of a key's rows the least is the centre."""
    keyed = rows.select(F.explode(keys).alias("key"), "rid")
    first = F.min("rid").over(Window.partitionBy("key").orderBy("rid"))
    edges = keyed.withColumn("a", first).where("a != rid").select("a", F.col("rid").alias("b"))
    of_row = components(edges).select(F.col("node").alias("rid"), F.col("component").alias("family"))
    points = written(rows.select("rid", "s1", "s2").join(of_row, "rid").groupBy("s1", "s2").agg(F.min("family").alias("family")))
    sizes = points.groupBy("family").count().where("count > 1").select("family")
    return points.join(sizes, "family").select("s1", "s2", "family")


def _taken(percent: int) -> Column:
    """How many shingles of a point of ``n`` include one of each linked partner's, in any order common to all points."""
    return F.expr(f"cast(n - (n * {percent} + 99) div 100 + 1 as int)")


def rare_families(low: DataFrame, sizes: DataFrame, few: DataFrame, percent: int) -> DataFrame:
    """(point, family) by the rare shingles of the points. A linked partner
    holds percent of a point's shingles, so whichever others and one more are
    taken, it holds one of them; taken in an order common to all points, it
    takes that one too. The lower half of the hashes comes first, by the number
    of points that hold them: those of one point alone are never listed. (Cut
    to 48 bits, which keeps equal ones equal, and the number before them, they
    are one key.) The upper half follows for points that have too few. ``low`` has the lower
    hashes (point, hashes), ``sizes`` their number (point, n, n_low), ``few``
    the hashes (point, n, hashes) of the points that need upper ones."""
    held = (low.select("point", F.explode("hashes").alias("h")).select("point", F.shiftright("h", 15).alias("h"))
            .withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("c > 1"))
    ranked = F.shiftleft(F.least("c", F.lit(MOST_HOLDERS)), 48).bitwiseOR(F.col("h"))
    shared = held.groupBy("point").agg(F.sort_array(F.collect_list(ranked)).alias("h"))
    rest = sizes.select("point", (_taken(percent) - F.col("n_low")).cast("int").alias("rest"))
    listed = shared.join(rest, "point").select("point", (F.col("rest") + F.size("h")).alias("rest"), "h").where("rest > 0")
    upper = few.select("point", (_taken(percent) - F.size(F.filter("hashes", lambda h: h >= 0))).alias("rest"),
                       F.sort_array(F.filter("hashes", lambda h: h < 0)).alias("h")).where("rest > 0")
    rows = written(listed.unionByName(upper).select(F.col("point").alias("rid"), F.col("point").alias("s1"), F.lit(0).cast("long").alias("s2"),
                                                    F.slice("h", F.lit(1), F.col("rest")).alias("keys")))
    found = written(families(rows, "keys").select(F.col("s1").alias("point"), "family"))
    discard(rows)
    return found


def finer_families(points: DataFrame, percent: int) -> DataFrame:
    """The stored points (point, n, hashes) with the families of their rare shingles."""
    low = points.select("point", "n", F.filter("hashes", lambda h: h >= 0).alias("hashes"))
    found = rare_families(low, low.select("point", "n", F.size("hashes").alias("n_low")), points, percent)
    out = written(points.drop("family").join(found, "point"))
    discard(found)
    return out


def join_points(points: DataFrame, percent: int, cell_points: int = CELL_POINTS, cell_shingles: int = CELL_SHINGLES,
                told_apart: bool = False) -> DataFrame:
    """Steps 2 to 4 for stored points (family, point, n, hashes), each point
    once: (node, component) of all points that are linked to another.
    ``told_apart``: the families are already those of rare shingles."""
    per_cell = F.greatest(F.lit(1), F.least(F.lit(cell_points), F.floor(F.lit(cell_shingles) / F.col("largest"))))

    def measured(points: DataFrame) -> DataFrame:
        sizes = points.groupBy("family").agg(F.count("*").alias("points"), F.max("n").alias("largest"))
        return written(sizes.select("family", F.ceil(F.col("points") / per_cell).alias("cells"), per_cell.alias("per_cell")))

    sizes, made = measured(points), []
    if not told_apart and not sizes.where("cells > 1").isEmpty():
        finer = finer_families(points.join(sizes.where("cells > 1"), "family", "left_semi"), percent)
        points = points.join(sizes.where("cells = 1"), "family", "left_semi").unionByName(finer.select(*points.columns))
        made = [finer, sizes]
        sizes = measured(points)
    dealt = points.join(sizes, "family").withColumn(
        "cell", F.when(F.col("cells") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("point", F.lit(1)), F.col("cells"))))
    large = sizes.where("cells > 1").select("family", "cells", "per_cell")
    light = points.select("family", "point").join(large, "family")
    drawn = light.groupBy("family", "cells").agg(*[
        F.min(F.struct(F.xxhash64(F.col("point"), F.lit(100 + i)), F.col("point").alias("id")))["id"].alias(f"p{i}")
        for i in range(PIVOTS)])
    drawn = written(drawn.select("family", "cells", F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(PIVOTS)]))).alias("point")))
    pivots = (points.join(drawn, ["family", "point"])
              .withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))))
    cells = (dealt.select("family", "cell", "point", "hashes", F.lit(False).alias("is_pivot"))
             .unionByName(pivots.select("family", "cell", "point", "hashes", F.lit(True).alias("is_pivot"))))
    found = written(cells.groupBy("family", "cell").applyInArrow(_join_cell(percent), "a long, b long, far array<double>"))
    links = found.where("b is not null").select("a", "b")

    # Open points: those outside the largest group of their (large) family.
    group = components(links)
    far = found.where("far is not null").select(F.col("a").alias("point"), "far")
    labelled = written(light.join(far, "point").join(group.withColumnRenamed("node", "point"), "point", "left")
                       .withColumn("grp", F.coalesce("component", "point")).drop("component"))
    groups = labelled.groupBy("family", "grp").agg(F.count("*").alias("c"))
    main = written(groups.groupBy("family").agg(F.max_by("grp", F.struct("c", "grp")).alias("main"), F.count("*").alias("groups")))
    if not main.where("groups > 1").isEmpty():
        group = components(links.unionByName(_open_links(points, labelled, main, percent)))
    discard(sizes, drawn, found, labelled, main, *made)
    return group


def _open_links(points: DataFrame, labelled: DataFrame, main: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of the open points of ``labelled`` (family, point, far, per_cell, grp), by blocks."""
    # Blocks: points of one nearest pivot and of about one distance to it, as they follow each other.
    nearest = F.array_min("far")
    placed = (labelled.join(main.where("groups > 1"), "family")
              .select("family", "point", "far", "per_cell", (F.col("grp") != F.col("main")).alias("is_open")))
    order = Window.partitionBy("family", "is_open").orderBy(F.array_position("far", nearest), nearest, "point")
    at = ((F.row_number().over(order) - 1) / (BLOCK_CELLS * F.col("per_cell"))).cast("long")
    placed = written(placed.select("family", F.xxhash64("family", "is_open", at).alias("block"), "point", "far", "is_open"))
    span = written(placed.select("family", "block", "is_open", F.posexplode("far").alias("i", "d"))
                   .groupBy("family", "block", "is_open", "i").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
                   .groupBy("family", "block", "is_open").agg(F.sort_array(F.collect_list(F.struct("i", "lo", "hi"))).alias("span")))
    # Every block of open points meets the blocks in its triangle-inequality window, open ones once.
    radius = 1 - percent / 100 + 1e-9
    asking = span.where("is_open").select("family", F.col("block").alias("asker"), F.col("span").alias("asked"))
    near = F.forall(F.zip_with("asked", "span", lambda x, y: (x["lo"] - radius <= y["hi"]) & (y["lo"] - radius <= x["hi"])), lambda x: x)
    meets = written(asking.join(span, "family").where(near).where("not is_open or asker <= block").select("asker", "block"))
    filled = written(points.join(placed.select("family", "block", "point"), ["family", "point"])
                     .join(meets.select("block").unionByName(meets.select(F.col("asker").alias("block"))).distinct(), "block")
                     .groupBy("block").agg(F.collect_list(F.struct("point", "hashes")).alias("members")))
    pairs = (meets.join(filled.select(F.col("block").alias("asker"), F.col("members").alias("a")), "asker")
             .join(filled.select("block", F.col("members").alias("b")), "block"))
    sides = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "ab" for c in ("point", "hashes")]
    more = written(pairs.select(*sides).mapInArrow(_join_blocks(percent), "a long, b long"))
    discard(placed, span, meets, filled)
    return more


def linked_rows(docs: DataFrame, k: int = K, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
                cell_points: int = CELL_POINTS, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """(doc_id, th, n_shingles, component) of each row: th is the hash of the
    text, component is null for the empty set."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    # Keys are never stored: they go straight to the shuffle that finds which are shared, and the small rows come in a pass of their own.
    point = F.xxhash64("s1", "s2").alias("point")
    sharers = written(_key_sharers(_keyed(texts, k, percent).select(point, F.explode("keys").alias("key"))))
    rows = written(_sets(texts, k).select("doc_id", "th", "n_shingles", "n_low", point))

    # One document for each point that shares a key; its set is made again from its text.
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "th")
    distinct = (rows.join(sharers, "point", "left_semi").groupBy("point")
                .agg(F.min(place).alias("at"), F.first("n_shingles").alias("n"), F.first("n_low").alias("n_low")))
    wanted = written(distinct.select(F.col("at.doc_id").alias("_id"), F.col("at.th").alias("_th"), "point", "n", "n_low"))
    discard(sharers)
    hit = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    asked = written(near_slots(texts, wanted).join(wanted, hit).select("point", "n", "n_low", "text"))
    made = [wanted, asked]
    if asked.count() > wanted.count():  # rows that come twice
        asked = written(asked.dropDuplicates(["point"]))
        made.append(asked)
    few = asked.where(_taken(percent) > F.col("n_low"))
    found = rare_families(_fetch(asked, k, lower=True), asked, _fetch(few, k), percent)
    near = near_slots(asked, found.withColumnRenamed("point", "_id"), "point")
    points = written(_fetch(near.join(found, "point"), k, ("family", "point", "n")))
    discard(found, *made)
    merged = join_points(points, percent, cell_points, cell_shingles, told_apart=True).withColumnRenamed("node", "point")
    discard(points)
    return rows.join(merged, "point", "left").select(
        "doc_id", "th", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "point")).alias("component"))


def jaccard_join(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; sets are linked when
    100 * intersection >= percent * union."""
    rows = linked_rows(docs, **options)
    named = written(rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")))
    return (rows.join(named, "component", "left")
            .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without near copies: of each component the one with the
    least id (null ids last) stays with all its columns; rows that agree in id
    and text are one document. Documents of the empty set stay."""
    rows = written(linked_rows(docs, id_col=id_col, text_col=text_col, **options))
    keeper = F.min(F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("_id"), F.col("th").alias("_th")))
    kept = (rows.where("component is not null").groupBy("component").agg(keeper.alias("k")).select("k._id", "k._th")
            .unionByName(rows.where("component is null").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()))
    kept = written(kept)
    whole = docs.select(F.struct(*columns(docs)).alias("doc"), F.col(id_col).cast("long").alias("doc_id"),
                        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"))
    out = whole.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left_semi")
    if not rows.groupBy("doc_id", "th").count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "th"])
    return out.select("doc.*")
