"""Packing, token counts, language ID, decontamination and paragraph dedup."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from util import CLASHING, Groups, frame, jaccard, prose, shingles

from traceframe.llm import decontaminate as D
from traceframe.llm import langid as L
from traceframe.llm import packing as P
from traceframe.llm import passages as N
from traceframe.llm import paragraph_dedup as G
from traceframe.llm import token_count as T

ODD = ["", "  ", None, "áb x́. Ab,. it's IT'S don't, x.. <|endoftext|> é É Σας ΟΔΟΣ. İx ab.. 12,3. a\tb\nc \x1c q",
       "한국어 각 １２ ﬁ, ½. ª, 中文字,", "a . , .b ,c", "word, word. Word", "x" * 5000, "<s> </s> <unk> ▁ a  b   c\n\n d", "\x00", "a b " * 3000]


def ids_of(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def test_packing_cuts_and_places_every_id_once(spark):
    rng = random.Random(2)
    texts = ODD + [prose(rng, rng.randint(1, 4000)) for _ in range(40)] + ["word, word"] * 7
    rows = P.pack(frame(spark, texts), window=512).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, want in enumerate(ids_of(texts)):
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        got = b"".join(r.ids for r in pieces)
        assert np.frombuffer(got, "<u4").tolist() == want
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
        assert all(r.doc_tokens == len(want) and len(r.ids) == 4 * r.length for r in pieces)
    filled = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 512
    padded = {r.sequence_id: r.padded_length for r in rows}
    assert all(padded[s] == (n if n & (n - 1) == 0 else 512) for s, n in filled.items())
    assert sum(padded.values()) < 1.05 * sum(filled.values())


def test_a_run_encodes_its_distinct_words_once_whatever_came_before(monkeypatch):
    encoder = P.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    given = []
    monkeypatch.setattr(encoder, "_encode_words", lambda words, make=encoder._encode_words: given.append(sorted(words)) or make(words))
    texts = ["one two. É", None, "two. one\nthree  !?", "É one, ONE"] + ODD
    for _ in range(2):
        given.clear()
        got = encoder.encode_all([t or "" for t in texts])
        assert [np.frombuffer(g, "<u4").tolist() + [2] for g in got] == ids_of(texts)
        assert given == [sorted({w for t in texts for w in (t or "").replace("\n", " ").split(" ") if w})]
    monkeypatch.setattr(P, "RUN_CHARS", 5)
    assert encoder.encode_all([t or "" for t in texts]) == got


def test_best_fit_decreasing_takes_the_tightest_window():
    lengths = sorted((random.Random(4).randint(1, 100) for _ in range(500)), reverse=True)
    seq, off = P.best_fit_decreasing(lengths, 100)
    left = []
    for n, s, o in zip(lengths, seq, off):
        fits = [c for c in left if c >= n]
        if s == len(left):
            assert not fits and o == 0
            left.append(100)
        assert left[s] == (min(fits) if fits else 100) and o == 100 - left[s]
        left[s] -= n


def test_packing_empty_table(spark):
    assert P.pack(frame(spark, ["x"]).where("doc_id < 0")).collect() == []


def test_token_counts_equal_the_libraries(spark):
    import sentencepiece
    texts = ODD + [prose(random.Random(6), 9000)]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for size in (64, T.SEGMENT_CHARS):
        got = {r.doc_id: r for r in T.token_counts(frame(spark, texts), segment_chars=size, batch_bytes=500).collect()}
        for i, t in enumerate(texts):
            want = len(sp.encode(t or ""))
            assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), want, want > 4096)
    got = {r.doc_id: r.n_tokens for r in T.token_counts(frame(spark, texts), "word_bpe_49k.json").collect()}
    assert got == {i: len(x) - 1 for i, x in enumerate(ids_of(texts))}
    assert T.token_counts(frame(spark, ["x"]).where("doc_id < 0")).collect() == []


def test_language_id_learns_and_rejects(spark):
    from pyspark.sql import Row
    rng = random.Random(8)
    make = lambda alphabet, n: " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows = [Row(doc_id=i, text=make(*(("abcdefgh", rng.randint(3, 80)) if i % 2 else ("hijklmnöü", rng.randint(3, 80)))), lang="aa" if i % 2 else "bb") for i in range(300)]
    rows += [Row(doc_id=1000, text=None, lang="aa"), Row(doc_id=1001, text="12 !? --", lang="bb"), Row(doc_id=1002, text="", lang=None),
             Row(doc_id=None, text="ab cd ba dcba", lang=None), Row(doc_id=7, text=make("abcdefgh", 30000), lang=None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("row", F.lit(1))
    docs = docs.withColumn("fold", L.held_out())
    net = L.train(docs.where("not fold"), per_label=60)
    got = L.predict(docs, net, [F.col("doc_id"), F.col("lang"), F.col("fold")]).collect()
    assert len(got) == len(rows)
    known = [r for r in got if r.fold and r.doc_id is not None and r.doc_id < 300]
    assert known and np.mean([r.lang_pred == r.lang for r in known if r.lang]) > 0.95
    by = {r.doc_id: r for r in got if r.doc_id is None or r.doc_id >= 1000}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000].score == 0 and by[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got)
    for r in got[:50]:
        if r.doc_id is not None:
            assert r.fold == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert L.train(docs.where("false")) is None
    assert {r.lang_pred for r in L.predict(docs, None, [F.col("doc_id")]).collect()} == {"und"}
    assert L.predict(docs.where("false"), net).collect() == []


def test_pair_tables_are_the_same_network():
    net = L.ByteNet(["a", "b", "c"])
    x = L.cut_windows("Some Text, with ünïcode 123!".encode(), L.WINDOW)
    e = net.embed[x]
    pooled = [sum(e[:, k:k + x.shape[1] - w + 1] @ f[k] for k in range(w)).max(1) + b for w, f, b in zip(L.WIDTHS, net.filters, net.bias)]
    z = np.maximum(np.concatenate(pooled, 1), 0) @ net.out + net.out_bias
    want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    assert np.allclose(net.probabilities(x), want, atol=1e-5)


def edits_of(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (p != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def spoil(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        i = rng.randrange(len(out))
        what = rng.random()
        if what < 0.4:
            out[i] = rng.choice("klmno")
        elif what < 0.7:
            del out[i]
        else:
            out.insert(i, rng.choice("klmno"))
    return "".join(out)


def test_decontamination_equals_alignment_of_all(spark):
    rng = random.Random(9)
    items = [prose(rng, n) for n in (10, 14, 25, 60)] + [None, "", "short", "ünïcödé " * 12]
    items.append(items[0].upper())
    docs = [None, "", "x", prose(rng, 4000)]
    for t in items[:4] + [items[7]]:
        for share in (0, 0.03, 0.06, 0.09, 0.12, 0.2):
            docs.append(f"{prose(rng, rng.choice([0, 3, 40]))} {spoil(rng, t, int(share * len(t)))} {prose(rng, rng.choice([0, 5, 60]))}")
        docs += [t, t[:-3], t[4:], t[: len(t) // 2]]
    bench = spark.createDataFrame([(i if i != 8 else None, t) for i, t in enumerate(items)], "item_id long, text string")
    known = {i: D.normalise(t) for i, t in enumerate(items) if len(D.normalise(t)) >= D.MIN_CHARS}
    frames = frame(spark, docs)
    results = [D.contamination(frames, bench, block_chars=b).collect() for b in (1 << 20, 200)]
    for i, t in enumerate(docs):
        text = D.normalise(t)
        want = {}
        for k, item in known.items():
            e = edits_of(item, text)
            if e <= D.budget(len(item), D.Q, D.MAX_EDIT_RATE):
                want[k] = e
        for rows in results:
            row = next(r for r in rows if r.doc_id == i)
            assert row.contaminated == bool(want)
            assert [m.item_id for m in row.matches] == sorted(k for k in want if k != 8)
            assert all(m.edits >= want[m.item_id] for m in row.matches)
            assert list(row.asDict())[:-2] == frames.columns
    assert not any(r.contaminated for r in D.contamination(frames, bench.where("false")).collect())
    assert D.contamination(frames.where("false"), bench).collect() == []


def test_decontamination_of_repetitive_texts_stays_small(monkeypatch):
    items = [(1, "la" * 700), (2, "the quick brown fox jumps over the lazy dog and runs away"), (3, "abc" * 30)]
    index = D.BenchmarkIndex(items, D.Q, D.MAX_EDIT_RATE, D.MIN_CHARS)
    posting, _ = index._postings(np.arange(len(index.code)))
    assert len(posting) < 150  # 700 places of each of two grams become one for each edits + 1 places
    text = "la" * 20_000 + " abcabcabcabxabcabc" + "abc" * 25 + " the quick brown fox jumpd over the lazy dog and runs away"
    whole = index.matches(text)
    assert whole == {0: 0, 1: 1, 2: 1}
    monkeypatch.setattr(D, "STEP_POSTINGS", 50)
    assert index.matches(text[38_000:]) == {0: 0, 1: 1, 2: 1}
    assert index.matches("la" * 600) == {}


def test_paragraph_dedup_equals_brute_force(spark):
    rng = random.Random(12)
    base = [prose(rng, n) for n in (8, 20, 26, 55, 80, 200)]
    docs = [None, "", "\n\n", "short line\nshort line"]
    for i in range(40):
        parts = []
        for _ in range(rng.randint(1, 5)):
            w = rng.choice(base).split() if rng.random() < 0.6 else prose(rng, rng.randint(5, 60)).split()
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                w[rng.randrange(len(w))] = prose(rng, 1)
            parts.append(" ".join(w))
        docs.append("\n".join(parts))
    ids = list(range(len(docs)))
    ids[-1] = None
    frames = frame(spark, docs, ids=ids)
    places, sets = [], []
    for i, t in sorted(zip(ids, docs), key=lambda r: (r[0] is None, r[0] or 0)):
        for pos, line in enumerate((t or "").split("\n")):
            if len(line.split()) >= G.MIN_WORDS:
                places.append((i, pos))
                sets.append(shingles(line, 5))
    groups = Groups(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if jaccard(sets[a], sets[b]) >= 0.8:
                groups.join(a, b)
    size = Counter(groups.find(i) for i in range(len(sets)))
    repeated = Counter(places[i][0] for i in range(len(sets)) if size[groups.find(i)] > 1)
    removed = {}
    for i in range(len(sets)):
        if groups.find(i) != i:
            removed.setdefault(places[i][0], []).append(places[i][1])
    got = {r.doc_id: r for r in G.paragraph_repeats(frames).collect()}
    assert len(got) == len(docs) and sum(repeated.values()) > 20
    for i, t in zip(ids, docs):
        assert (got[i].n_repeated, got[i].removed) == (repeated.get(i, 0), sorted(removed.get(i, []))), i
        assert got[i].n_paragraphs == len((t or "").split("\n"))
    cleaned = G.remove_repeats(frames)
    assert cleaned.columns == frames.columns
    for r in cleaned.collect():
        t = docs[ids.index(r.doc_id)]
        assert r.text == (t if r.doc_id not in removed else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in removed[r.doc_id]))
    assert G.paragraph_repeats(frames.where("false")).collect() == []


def test_paragraph_dedup_joins_short_lines(spark):
    rng = random.Random(21)
    verse = [prose(rng, rng.randint(4, 8)) for _ in range(12)]
    docs = ["\n".join(verse), "\n".join([prose(rng, 3), "", *verse[2:9], prose(rng, 30), *verse[:1]]), "\n".join(verse),
            "\n".join(["la la la"] * 30), "\n".join([prose(rng, 4), prose(rng, 5), prose(rng, 30), prose(rng, 9)]), "\n".join(verse[:2])]
    places, sets, spans = [], [], []
    for i, t in enumerate(docs):
        lines = t.split("\n")
        for pos in range(len(lines)):
            for span in range(1, len(lines) - pos + 1):
                unit = lines[pos:pos + span]
                n = sum(len(x.split()) for x in unit)
                if not unit[0].strip() or span > 1 and any(len(x.split()) >= G.MIN_WORDS for x in unit):
                    break
                if n >= G.MIN_WORDS:
                    places.append((i, pos))
                    sets.append(shingles("\n".join(unit), 5))
                    spans.append(span)
                    break
    groups = Groups(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if jaccard(sets[a], sets[b]) >= 0.8:
                groups.join(a, b)
    size = Counter(groups.find(i) for i in range(len(sets)))
    copied, kept = {}, {}
    for i, (doc, pos) in enumerate(places):
        if size[groups.find(i)] > 1:
            (kept if groups.find(i) == i else copied).setdefault(doc, set()).update(range(pos, pos + spans[i]))
    got = {r.doc_id: r for r in G.paragraph_repeats(frame(spark, docs)).collect()}
    for i, t in enumerate(docs):
        gone = copied.get(i, set()) - kept.get(i, set())
        assert (got[i].removed, got[i].n_removed) == (sorted(gone), len(gone)), i
        assert got[i].n_repeated == len(copied.get(i, set()) | kept.get(i, set()))
        assert got[i].removed_chars == sum(len(t.split("\n")[p]) for p in gone)
    assert got[2].n_removed == 12 and got[2].copies_of == [0] and got[3].n_removed > 20 and got[1].n_removed == 7
    assert G.remove_repeats(frame(spark, docs)).where("doc_id = 2").first().text == ""


def test_passages_equal_brute_force(spark):
    rng = random.Random(31)
    base = prose(rng, 130).split()
    docs = [None, "", prose(rng, 49), prose(rng, 50)]
    docs += [f"{prose(rng, rng.randint(0, 90))} {' '.join(base[a:a + n])} {prose(rng, rng.randint(0, 90))}"
             for a, n in ((0, 130), (0, 49), (3, 50), (40, 51), (70, 60), (10, 90), (30, 20))]
    docs += ["\n".join(base[:70:1]), " ".join(base[60:90]) + "\n" + " ".join(base[90:125]).upper(), "la " * 60, docs[5], docs[3]]
    docs.append(" ".join(base[:55] + prose(rng, 7).split() + base[:55]))
    ids = list(range(len(docs) - 1)) + [None]
    at = {}
    for i, t in zip(ids, docs):
        w = (t or "").lower().split()
        for p in range(len(w) - 49):
            at.setdefault(tuple(w[p:p + 50]), []).append((i is None, i or 0, p))
    starts, firsts = {}, {}
    for places in at.values():
        for late, i, p in places if len(places) > 1 else []:
            starts.setdefault((late, i), []).append(p)
            if min(places)[:2] != (late, i):
                firsts.setdefault((late, i), set()).add(min(places)[1])
    got = {(r.doc_id is None, r.doc_id or 0): r for r in N.passages(frame(spark, docs, ids=ids)).collect()}
    assert set(got) == set(starts) and len(got) > 8
    for place, own in starts.items():
        words = sorted({p + k for p in own for k in range(50)})
        first = [w for w in words if w - 1 not in words]
        assert [p.word for p in got[place].passages] == first, place
        assert sum(p.words for p in got[place].passages) == len(words)
        assert got[place].passage_copies_of == sorted(firsts.get(place, []))
    rows = G.with_passages(G.paragraph_repeats(frame(spark, docs, ids=ids)), frame(spark, docs, ids=ids)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.passage_words == len({p + k for p in starts.get((r.doc_id is None, r.doc_id or 0), []) for k in range(50)})
    assert N.passages(frame(spark, docs).where("false")).collect() == []


def test_only_windows_of_a_mark_are_compared():
    import pyarrow as pa
    rng = random.Random(4)
    text = prose(rng, 300)
    (_, _, words), = N.word_hashes(pa.array([text]))
    at, _ = N.anchors(words, 50)
    marks = at[len(at) // 2:len(at) // 2 + 1]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text]), pa.array([marks.tolist()])], names=["doc_id", "th", "text", "marks"])
    made, = N._window_rows(50)([batch])
    grams = N.gram_hashes(words, 25)
    assert made.column("pos").to_pylist() == [p for p in range(251) if p + int(np.argmin(grams[p:p + 26])) == marks[0]]


def test_bands_reach_the_recall():
    b = G.bands_for(0.8, G.ROWS, G.RECALL)
    assert 1 - (1 - 0.8 ** G.ROWS) ** b >= G.RECALL > 1 - (1 - 0.8 ** G.ROWS) ** (b - 1)


def test_clashing_names_are_present(spark):
    assert set(CLASHING) < set(frame(spark, ["x"]).columns)


def test_recurring_places_are_found_in_one_narrow_shuffle(spark, capsys):
    rows = [(1, 1, 0, 5), (2, 2, 0, 5), (None, 3, 1, 6), (None, 3, 1, 6), (4, 4, 2, 7), (4, 4, 9, 7), (None, 5, 0, 8), (None, 6, 0, 8)]
    found = N._recurring(spark.createDataFrame(rows, "doc_id long, th long, pos long, h long"))
    found.explain()
    plan = capsys.readouterr().out
    got = sorted(((r.doc_id, r.th, r.pos, r.first) for r in found.collect()), key=str)
    assert got == sorted([(1, 1, 0, 1), (2, 2, 0, 1), (4, 4, 2, 4), (4, 4, 9, 4), (None, 5, 0, None), (None, 6, 0, None)], key=str)
    shuffled = plan[plan.index("Exchange"):]
    assert plan.count("Exchange") == 1 and "xxhash64" in plan and "xxhash64" not in shuffled


def test_bands_are_gone_when_passages_are_sought(spark, monkeypatch):
    kept, write, drop = {}, G.written, G.discard

    def written(df):
        out = write(df)
        kept[id(out)] = out
        return out

    def discard(*tables):
        for t in tables:
            kept.pop(id(t), None)
        drop(*tables)

    monkeypatch.setattr(G, "written", written)
    monkeypatch.setattr(G, "discard", discard)
    line = prose(random.Random(5), 30)
    rows = G.paragraph_repeats(frame(spark, [line, "x\n" + line, None, "y"]))
    assert not any("bands" in t.columns for t in kept.values())
    assert {r.doc_id: (r.n_paragraphs, r.n_removed) for r in rows.collect()} == {0: (1, 0), 1: (2, 1), 2: (1, 0), 3: (1, 0)}
