"""The corpus pipeline against brute-force stages."""

import random

import corpus_pipeline
from test_text_stages import edits_of, ids_of
from util import frame, jaccard, linked_components, prose, shingles

from traceframe.llm import decontaminate as D


def near_pair(rng):
    """Two texts that are near copies by five words and 0.8, but not by four words and 0.85."""
    a = prose(rng, 120).split()
    b = list(a)
    b[40], b[80] = prose(rng, 1) + "x", prose(rng, 1) + "x"
    a, b = " ".join(a), " ".join(b)
    assert jaccard(shingles(a, 5), shingles(b, 5)) >= 0.8
    return a, b


def test_near_copies_by_five_words_and_four_fifths(spark):
    rng = random.Random(3)
    base = prose(rng, 100).split()
    pairs = []
    for at in (range(20, 100, 40), range(10, 100, 45)):
        other = list(base)
        for i in at:
            other[i] = "zzz"
        pairs.append(" ".join(other))
    texts = [" ".join(base), *pairs, *near_pair(rng)]
    sets4, sets5 = ([shingles(t, k) for t in texts] for k in (4, 5))
    between = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(sets5[a], sets5[b]) >= 0.8 and jaccard(sets4[a], sets4[b]) < 0.85]
    assert between
    kept = corpus_pipeline.near_copies(spark, frame(spark, texts, extra=False), "")
    want = {c for _, c in linked_components(texts, 5, 80, list(range(len(texts))))}
    assert {r.doc_id for r in kept.collect()} == want != {c for _, c in linked_components(texts, 4, 85, list(range(len(texts))))}


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(7)
    items = [prose(rng, 20), prose(rng, 30)]
    texts = [None, "", "12 !? --", *near_pair(rng), prose(rng, 90), f"{prose(rng, 9)} {items[0]} {prose(rng, 9)}", prose(rng, 60), "One text"]
    texts += [texts[5], prose(rng, 3) + " " + items[1]]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame(spark, texts, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    stay = [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    component = dict(zip(stay, (c for _, c in linked_components([texts[i] for i in stay], 5, 80, stay))))
    stay = [i for i in stay if component[i] == i]
    known = [D.normalise(t) for t in items]
    stay = [i for i in stay if all(edits_of(k, D.normalise(texts[i])) > D.budget(len(k), D.Q, D.MAX_EDIT_RATE) for k in known)]
    got = {}
    for r in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id, r.start)):
        got[r.doc_id] = got.get(r.doc_id, b"") + r.ids
    want = dict(zip(stay, (b"".join(i.to_bytes(4, "little") for i in ids) for ids in ids_of([texts[i] for i in stay]))))
    assert got == want and len(want) == 4


def test_language_id_without_labels_keeps_lettered_documents(spark):
    docs = frame(spark, ["some text", None, "12 !?", "ß", ""], extra=False).drop("lang").selectExpr("*", "cast(null AS string) AS lang")
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()} == {0, 3}
