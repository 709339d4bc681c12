"""Registered queries: the columns they return, against brute force by their contracts."""

import hashlib
import re
import zlib

import public_tokenizers
import pytest
from util import frame

from traceframe.llm import queries as Q

TEXTS = [None, "", "plain words only", "mail a.b@c.org or x_y@z-1.example.com, no @ here",
         "hosts 10.0.0.1 and 255.255.255.255 but 256.1.1.1 and 1.2.3", "pay 4111 1111 1111 1111 or 4111-1111-1111-1112",
         "call +49 (30) 123-4567 or +1 2 or +123456789012345678", "a@b.co 10.1.2.3 4111111111111111 +4930123456 a@b.co 9.9.9.9",
         "é中 a@b.co é +4930123456"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    frame(spark, TEXTS, ids=[40 + i for i in range(len(TEXTS))]).write.parquet(f"{out}/documents.parquet")
    return out


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    text = text or ""
    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(d := re.sub(r"\D", "", s)) <= 19 and luhn(d)),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub(r"\D", "", s)) <= 15)]
    return [(kind, m.start(), m.end()) for kind, pattern, ok in rules for m in re.finditer(pattern, text) if ok(m[0])]


def test_pii_counts_and_digest(spark, folder):
    rows = {r.doc_id: r for r in Q.op5_pii(spark, folder).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        r, base = rows[40 + i], base_spans(text)
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(b[0] == k for b in base) for k in ("email", "ip", "card", "phone")]
        listed = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(filter(None, r.spans.split(",")))
    assert rows[47].n_email == 2 and rows[47].n_ip == 2 and rows[47].n_phone == 1 and rows[45].n_card == 1


def test_sentencepiece_digests(spark, folder):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = {r.doc_id: r for r in Q.op11_sentencepiece(spark, folder).collect()}
    for i, text in enumerate(TEXTS):
        ids, r = library.encode(text or "") + [2], rows[40 + i]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_packing_and_fingerprint_digests(spark, folder):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {r.doc_id: r for r in Q.op1_packing(spark, folder).collect()}
    prints = {r.doc_id: r for r in Q.op4_fingerprints(spark, folder).collect()}
    for i, text in enumerate(TEXTS):
        text = text or ""
        ids, r = t.encode(text, add_special_tokens=False).ids + [2], pieces[40 + i]
        assert (r.start, r.length, r.doc_tokens) == (0, len(ids), len(ids))
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
        after = TEXTS[i - 1] or ""  # descending doc_id, after the last the first
        n = len(text) // 3
        assert prints[40 + i].n_chars == len(text)
        assert prints[40 + i].edited_sha256 == hashlib.sha256((text[:len(text) - n] + after[:n]).encode()).hexdigest()
