"""SentencePiece coding, fill-in-middle and ranked lexical search."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from util import CLASHING, frame, prose

from traceframe.llm import fill_in_middle as M
from traceframe.llm import lexical_search as S
from traceframe.llm import piece_codec as C

ODD = [None, "", " ", "   ", "a", " a", "a ", "a  b   c ", "▁x ▁▁ y▁", "\t\n a\r\n", "\x00 \x7f", "한국어 각 １２ ﬁ, ½ª 中文字", "é É́ İx ΟΔΟΣ",
       "<s> </s> <unk> <0x0A> <P>", "\U0001f600 \U0001f600\U0001f468‍\U0001f469", "x" * 5000, " " * 70 + "y", "a b " * 3000, "q<S", "<S>q", "<M>"]
TEXT = st.text(st.sampled_from(list("ab Z,\n\t▁é中\U0001f600<P>SM\x00 ")) | st.characters(exclude_categories=["Cs"]), max_size=60)


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 20))
def test_codec_equals_the_library(text, size):
    codec = C.codec("piece_bpe_32k.model")
    assert codec.separable
    want = codec.model.encode(text)
    got = codec.encode(text, slice_chars=size)
    assert got.tolist() == want
    assert codec.decode(got, part_ids=size) == codec.model.decode(want)


def test_codec_table_starts_anew_and_whole_texts_without_it(library):
    rng = random.Random(3)
    texts = [prose(rng, 200) + "  \n" + prose(rng, 3) for _ in range(20)]
    codec = C.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"), table_chars=500)
    assert [codec.encode(t, slice_chars=300).tolist() for t in texts] == library.encode(texts)
    assert codec.held < 2500
    codec.separable = False
    assert [codec.encode(t).tolist() for t in texts] == library.encode(texts)


def test_encode_and_decode_rows(spark, library):
    docs = frame(spark, ODD + ["a b"] * 3, ids=[None] + list(range(1, len(ODD))) + [1, 1, 1]).withColumn("ids", F.lit("clash"))
    rows = C.decode(C.encode(docs)).collect()
    assert len(rows) == len(ODD) + 3 and set(CLASHING) < set(rows[0].asDict())
    for r in rows:
        want = library.encode(r.text or "") + [2]
        assert r.ids == want and r.decoded == library.decode(want)
    assert C.encode(docs, end=False, keep=[F.col("doc_id")]).where("size(ids) = 0").count() == 2
    empty = docs.where("doc_id < 0")
    assert C.decode(C.encode(empty)).collect() == []
    lone = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert [r.decoded for r in C.decode(lone).sort("k").collect()] == [None, ""]


def units(text):
    return re.findall("[A-Za-z]+|[^A-Za-z]", text)


def plain_fim(doc_id, text):
    text, u = text or "", units(text or "")
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[i:i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(u)
    if not text or any(s in text for s in M.SENTINELS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(1, 9))
def test_cuts_and_sparse_index(text, size):
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    cuts, u = M.Cuts(data, size), units(text)
    assert cuts.n == len(u)
    for k in range(len(u) + 1):
        head = "".join(u[:k])
        assert cuts.cut(k) == (len(head.encode()), len(head))
    index = M.SparseIndex(data)
    assert len(index.at) == sum(ord(c) > 127 for c in text)
    for k in range(len(text) + 1):
        byte = len(text[:k].encode())
        assert index.byte(k) == byte and index.chars(byte) == k


def test_fill_in_middle_rows(spark):
    rng = random.Random(9)
    texts = ODD + [prose(rng, rng.randint(1, 90)) + rng.choice(["", " é中", "<", "S>"]) for _ in range(120)]
    ids = [None, *range(1, len(texts) - 2), 5, 5]
    docs = frame(spark, texts, ids=ids).withColumn("n", F.lit("clash")).withColumn("h1", F.lit("clash")).withColumn("output", F.lit(1))
    for size in (7, M.SLICE_BYTES):
        rows = M.fill_in_middle(docs, slice_bytes=size).withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
        assert len(rows) == len(texts)
        want = Counter((i, t, *plain_fim(i, t)) for i, t in zip(ids, texts))
        assert Counter((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows) == want
        assert all(r.back == (r.text or "") for r in rows)
        assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert M.fill_in_middle(docs.where("doc_id < 0")).collect() == []


TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, top):
    def split(t):
        return TERMS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    rows = [(i, Counter(split(t))) for i, t in docs]
    rows = [(i, c) for i, c in rows if c]
    n_docs, length = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in rows:
            m = 75 + 25 * sum(c.values()) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
                        for t in split(text) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if late else i, -s) for k, (s, late, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("tree_docs,leaf_docs,block_chars", [(8, 1, 1 << 22), (64, 3, 200), (8192, 48, 1 << 22)])
def test_lexical_search_equals_brute_force(spark, tree_docs, leaf_docs, block_chars):
    rng = random.Random(8)
    vocabulary = prose(rng, 60).split() + ["É中", "été", "x1"]
    pick = lambda n: " ".join(rng.choice(vocabulary[:rng.choice((5, 20, 63))]).upper() if rng.random() < .2
                              else rng.choice(vocabulary[:rng.choice((5, 20, 63))]) for _ in range(n))
    base = [pick(rng.randint(1, 80)) for _ in range(150)]
    texts = ODD + base + [base[0]] * 30 + [base[1] + " " + pick(2) for _ in range(40)] + ["common"] * 40
    ids = [*range(len(texts) - 4), None, None, 3, 3]
    rng.shuffle(ids)
    items = [(i, pick(rng.randint(1, 30))) for i in range(25)] + [(25, base[0]), (26, "common"), (27, "!!"), (28, "unknownword"), (29, "a a a b")]
    docs = frame(spark, texts, ids=ids).withColumn("share", F.lit("clash")).repartition(3)
    asked = spark.createDataFrame(items + [items[0], (40, None)], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = S.lexical_search(docs, asked, top=7, tree_docs=tree_docs, leaf_docs=leaf_docs, block_chars=block_chars).collect()
    want = plain_search(list(zip(ids, texts)), items, 7)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert S.lexical_search(docs.where("doc_id < 0"), asked).collect() == []
    assert S.lexical_search(docs, asked.where("item_id < 0")).collect() == []


def test_terms_of_long_texts_are_cut_between_terms(monkeypatch):
    text = " ".join(f"Wörd{i}," for i in range(500)) + "x" * 300
    whole = TERM_LIST = S.TERM.findall(text.encode().lower())
    monkeypatch.setattr(S, "SLICE_BYTES", 64)
    assert [t for run in S.terms(text) for t in run] == whole and TERM_LIST
