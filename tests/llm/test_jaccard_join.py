import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from util import frame, linked_components, near_texts, prose

from traceframe.llm import jaccard_join as J
from traceframe.llm.common import WRITE_CONF
from traceframe.llm.components import components
from traceframe.llm.shingles import shingle_sets


@pytest.mark.parametrize("cell_points", [64, 3])
def test_equals_brute_force(spark, cell_points):
    texts = near_texts()
    ids = list(range(len(texts)))
    ids[30] = None
    got = sorted(map(tuple, J.jaccard_join(frame(spark, texts, ids=ids), cell_points=cell_points).collect()), key=str)
    want = sorted(((i, n, c) for i, (n, c) in zip(ids, linked_components(texts, 4, 85, ids))), key=str)
    assert got == want


def test_one_of_each_keeps_columns_and_least_ids(spark):
    texts = ["a b c d e f g", "a b c d e f g", "x y", None, None, "A b c d e f G", "q r s t u"]
    docs = frame(spark, texts, ids=[5, 3, 3, 8, 8, None, None])
    kept = J.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(3, "a b c d e f g"), (3, "x y"), (8, None), (None, "q r s t u")], key=str)


def test_empty_table(spark):
    docs = frame(spark, ["x"]).where("doc_id < 0")
    assert J.jaccard_join(docs).collect() == [] and J.one_of_each(docs).collect() == []


def test_components_of_paths_stars_and_repeats(spark):
    rng = random.Random(1)
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(50)] + [(1000, 1000)]
    rows = path + star + path[:20] + [(None, 4), (7, None)]
    rng.shuffle(rows)
    got = {r.node: r.component for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_text_is_hashed_in_slices(monkeypatch):
    import pyarrow as pa
    from traceframe.llm import shingles as S
    text = prose(random.Random(3), 3000)
    whole = [h.tolist() for _, _, h in shingle_sets(pa.array(["", text, None]), 4)]
    monkeypatch.setattr(S, "CHUNK_BYTES", 500)
    parts = [h.tolist() for _, _, h in shingle_sets(pa.array(["", text, None]), 4)]
    assert sum(whole, []) == sum(parts, [])


def test_every_level_finds_linked_sets():
    import numpy as np
    rng = np.random.default_rng(4)
    classes = J.SizeClasses(4000, 85)
    for n in [6, 7, 9, 12, 20, 33, 64, 65, 130, 260, 700, 2000]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64) * np.uint64(2))
            o = rng.integers(int(np.ceil(0.85 * n)), n + 1)
            extra = int((o * 100 // 85) - n)
            b = np.unique(np.concatenate([rng.permutation(a)[:o], rng.integers(0, 2 ** 63, rng.integers(0, max(0, extra) + 1), dtype=np.uint64)]))
            inter = len(np.intersect1d(a, b))
            if 100 * inter >= 85 * (len(a) + len(b) - inter) and inter < max(len(a), len(b)):
                assert set(J.region_keys(a, classes).tolist()) & set(J.region_keys(b, classes).tolist()), (n, len(b), inter)


def test_heavily_edited_copies_are_told_apart_without_their_pairs(spark):
    import numpy as np
    rng = np.random.default_rng(8)
    draw = lambda n: rng.integers(-2 ** 63, 2 ** 63 - 1, n)
    base = draw(120)
    sets = [np.concatenate([base, draw(120)]) for _ in range(300)]  # a half is shared: near no other set
    sets += [np.concatenate([x[:-4], draw(4)]) for x in sets[:40]]  # near one other set
    sets += [draw(3) for _ in range(20)] + [np.concatenate([base[:100], draw(1)])] * 2  # small sets, equal ones
    rows = [(1, i, len(x), np.sort(x.view(np.uint64)).view(np.int64).tolist()) for i, x in enumerate(sets)]
    points = J.written(spark.createDataFrame(rows, "family long, point long, n long, hashes array<long>"))
    finer = J.finer_families(points, 85)
    assert {r.point for r in finer.collect()} == {*range(40), *range(300, 340), 360, 361}
    assert finer.groupBy("family").count().agg({"count": "max"}).first()[0] == 2
    got = {(r.node, r.component) for r in J.join_points(points, 85, cell_points=16).collect()}
    assert got == {(k, i) for i in range(40) for k in (i, 300 + i)} | {(360, 360), (361, 360)}


def test_small_families_are_told_apart_as_well(spark, monkeypatch):
    rng = random.Random(12)
    base = prose(rng, 150)
    texts = [f"{base} {prose(rng, 150)}" for _ in range(12)]  # a third alike: they share region keys, and link with nothing
    (_, off, h), = shingle_sets(pa.array(texts), 4)
    keys = [set(J.region_keys(h[a:b], J.SizeClasses(1 << 12, 85)).tolist()) for a, b in zip(off[:-1], off[1:])]
    assert sum(any(a & b for b in keys if b is not a) for a in keys) > 2
    texts += [texts[0] + " end", texts[1], None]
    kept, join = [], J.join_points
    monkeypatch.setattr(J, "join_points", lambda points, *a, **o: kept.extend(points.collect()) or join(points, *a, **o))
    docs = frame(spark, texts)
    got = {r.doc_id: r.component_id for r in J.jaccard_join(docs.unionByName(docs.where("doc_id = 0"))).collect()}
    assert got == {i: {12: 0, 13: 1}.get(i, i) for i in range(15)}
    assert len(kept) == len({r.point for r in kept}) == 2


def test_written_leaves_no_shuffle_files_and_settings_as_they_were(spark):
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    def shuffled():
        files = held.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    before, conf = shuffled(), {k: spark.conf.get(k, None) for k in WRITE_CONF}
    out = J.written(spark.range(2000).groupBy((F.col("id") % 7).alias("k")).count())
    ends = time.time() + 10
    while shuffled() - before and time.time() < ends:
        time.sleep(0.1)
    assert not shuffled() - before and len(out.collect()) == 7
    assert conf == {k: spark.conf.get(k, None) for k in WRITE_CONF}


def test_region_keys_are_shuffled_but_never_stored(spark, monkeypatch):
    stored, write = [], J.written
    monkeypatch.setattr(J, "written", lambda df: stored.append(df.columns) or write(df))
    rng = random.Random(21)
    texts = [prose(rng, 120) for _ in range(6)]
    texts += [texts[0] + " end", texts[1], None, "", "x y"]
    docs = frame(spark, texts)
    got = {r.doc_id: r.component_id for r in J.jaccard_join(docs.unionByName(docs)).collect()}
    assert got == {i: {6: 0, 7: 1}.get(i, i) for i in range(11)}
    assert ["point"] in stored and not any("keys" in c and "th" in c for c in stored)


def test_points_that_share_a_key_with_another(spark):
    rows = [(1, 5), (1, 5), (2, 6), (3, 6), (3, 7), (4, 7), (4, 7), (8, 9), (8, 10), (None, 5)]
    got = J._key_sharers(spark.createDataFrame(rows, "point long, key long").where("point is not null")).collect()
    assert sorted(r.point for r in got) == [2, 3, 4]
