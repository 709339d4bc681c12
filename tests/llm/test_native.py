"""Fingerprints, personal data, chat formatting and URL filter: DataFrame functions only."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from util import frame, jaccard, prose, shingles

from traceframe.llm import chat as C
from traceframe.llm import fingerprint as P
from traceframe.llm import pii as S
from traceframe.llm import url_filter as U


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edits_and_likeness(spark):
    rng = random.Random(3)
    texts = [None, "", "one", "one two three", "é😀 " * 7, prose(rng, 3), prose(rng, 20000)]
    for _ in range(30):
        t = prose(rng, rng.randint(40, 600))
        texts += [t, " ".join(w if rng.random() > 0.03 else "new" for w in t.split())]
    texts += [texts[20], texts[20]]
    ids = [7 * i - 30 for i in range(len(texts))]
    docs = P.with_edits(frame(spark, texts, ids=ids))
    assert "Python" not in plan(docs) and "Pandas" not in plan(docs) and "Arrow" not in plan(docs)
    got = {r.doc_id: r for r in docs.collect()}
    assert len(got) == len(texts)
    order = sorted(ids, reverse=True)
    errors = []
    for i, t in zip(ids, texts):
        t, after = t or "", texts[ids.index(order[(order.index(i) + 1) % len(order)])] or ""
        edited = t[:len(t) - len(t) // 3] + after[:len(t) // 3]
        assert got[i].edited == edited and got[i].n_chars == len(t)
        assert len(got[i].fingerprint) == P.BINS
        for near, other in ((got[i].near_edited, edited), (got[i].near_next, after)):
            assert 0 <= near <= 1
            if t == other:
                assert near == 1
            errors.append(near - jaccard(shingles(t.lower(), 5), shingles(other.lower(), 5)))
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.07
    same = [ids[i] for i, t in enumerate(texts) if t == texts[20]]
    assert len({got[i].fingerprint for i in same}) == 1


def test_edits_of_repeated_ids_and_small_tables(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (3, "x y z"), (None, "abcdef"), (3, "p q r")], "doc_id long, text string")
    rows = P.with_edits(docs).collect()
    assert len(rows) == 5 and sorted(r.edited for r in rows if r.doc_id is None) == ["abcd"]
    assert {r.edited for r in rows if r.doc_id == 5} in ({"a b c d x y"}, {"a b c d p q"})
    one = P.with_edits(docs.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert P.with_edits(docs.where("false")).collect() == []


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum((lambda v: v - 9 if v > 9 else v)(int(c) * (1 + i % 2)) for i, c in enumerate(digits[::-1])) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                    "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_spans(spark):
    rng = random.Random(11)
    bits = ["a@b.co", "x@", "@y.z", "a@b", "1.2.3.4", "300.1.1.1", "1.2.3", "..", "4111 1111 1111 1111", "4111111111111112", "+1 (377) 555-0271",
            "+12", "+", "-", "(", "😀", "é", "word", "8.8.8.8.8", "a.b_c%d@e-f.g.h_i@j.kk", " ", "\n", "0", "12", "7 7", "001.002.003.0004", "@@"]
    texts = [None, "", "x"] + ["".join(rng.choice(bits) + rng.choice(["", " ", " ", "."]) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    texts += ["9.9.9.9 " * 700 + "q@r.st", "1" * 20000, "a" * 20000, "+" * 5000, "mail john [at] site [dot] org or call (212) 555-0147 now"]
    docs = frame(spark, texts)
    weights = S.train(docs)
    found = S.spans(docs, weights, [F.col("doc_id"), F.col("text"), F.col("spans").alias("old_spans")])
    assert "Python" not in plan(found)
    rows = {r.doc_id: r for r in found.select("doc_id", "spans", S.span_text(F.col("spans")).alias("all"), S.span_text(F.filter("spans", lambda s: s["base"])).alias("base"),
                                             S.masked(F.coalesce("text", F.lit("")), F.col("spans")).alias("masked")).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        assert rows[i].base == base_spans(t)
        assert set(rows[i].base.split(",")) <= set(rows[i]["all"].split(",")) or not rows[i].base
        hidden = [False] * (len(t) + 1)
        for s in rows[i].spans:
            for p in range(s.start, s.end):
                hidden[p] = True
        left = "".join(c for p, c in enumerate(t) if not hidden[p])
        assert re.sub("<(EMAIL|IP|CARD|PHONE)>", "", rows[i].masked) == left
    assert rows[len(texts) - 1].masked == "mail <EMAIL> or call <PHONE> now"
    assert S.train(docs.where("false")) == {} and S.spans(docs.where("false"), {}).collect() == []
    assert [r.spans for r in S.spans(docs.where("doc_id = 2"), {}).collect()] == [[]]


def test_estimate_finds_the_reliable_labelers():
    rng = random.Random(5)
    right = [0.95, 0.9, 0.85, 0.55, 0.8, 0.9]
    counts, truth = Counter(), {}
    for _ in range(4000):
        y = rng.random() < 0.4
        votes = tuple(None if rng.random() < 0.2 else int(y) if rng.random() < p else int(not y) for p in right)
        counts[votes] += 1
        truth.setdefault(votes, []).append(y)
    post = S.estimate([(0, v, n) for v, n in counts.items()])
    good = sum(sum(y == (post[0, v] > 0.5) for y in ys) for v, ys in truth.items())
    assert good / 4000 > 0.95


def test_tool_calls(spark):
    schema = "conv_id long, turn long, kind string, call_id string, after string, name string, arguments string, content string"
    ok = '{"chars": 1, "question": "x\\u00e9"}'
    rows = [(1, 0, "system", None, None, None, None, "hi \"you\"\n"), (1, 5, "call", "a", None, "answer", ok, None), (1, 2, "result", "a", None, None, None, "r"),
            (1, 6, "call", "b", "a", "summarise", '{"limit":2.5,"question":"q","chars":1}', None), (1, 7, "call", "c", "b", "answer", "{bad", None),
            (1, 8, "call", "d", "gone", "nosuch", "{}", None), (1, 9, "call", "a", None, "answer", ok, None), (1, 10, "call", None, None, "answer", ok, None),
            (1, 11, "result", "zz", None, None, None, None), (2, 0, "call", "a", "b", "answer", ok, None), (2, 1, "call", "b", "a", "answer", ok, None),
            (2, 2, "call", "x", "a", "answer", ok, None), (2, 3, "call", "y", "y", "answer", ok, None), (2, 4, "call", "z", None, "answer", '[1]', None),
            (2, 5, "call", "w", None, "answer", '{"question":"q","chars":1,"more":1}', None), (2, 6, "call", "v", None, "answer", '{"question":"q"}', None)]
    rows += [(3, t, "call", f"k{t}", f"k{t - 1}", "answer", ok, None) for t in range(100)] + [(3, t, "result", f"k{t}", None, None, None, "x") for t in range(100)]
    rows += [(None, 1, "call", "a", None, "answer", ok, None), (4, 0, "call", "a", None, "answer", ok, None), (4, 0, "call", "a", None, "answer", ok, None)]
    messages = spark.createDataFrame(rows, schema).withColumn("depth", F.lit("clash")).withColumn("status", F.lit(0))
    linked = C.link_calls(messages)
    assert "Python" not in plan(linked)
    out = linked.collect()
    assert len(out) == len(rows)
    got = {(r.conv_id, r.turn, r.kind, r.call_id): r for r in out}
    status = lambda *k: (got[k].status, got[k].depth)
    assert status(1, 5, "call", "a") == ("ok", 1) and status(1, 2, "result", "a") == ("ok", 2)
    assert status(1, 6, "call", "b") == ("invalid", 3) and status(1, 7, "call", "c") == ("bad_json", 5)
    assert status(1, 8, "call", "d") == ("unknown_tool", 1) and status(1, 9, "call", "a")[0] == "duplicate"
    assert status(1, 10, "call", None)[0] == "no_id" and status(1, 11, "result", "zz") == ("orphan", None)
    assert [status(2, t, "call", c) for t, c in enumerate(["a", "b", "x", "y"])] == [("cycle", None)] * 4
    assert [status(2, t, "call", c)[0] for t, c in ((4, "z"), (5, "w"), (6, "v"))] == ["invalid"] * 3
    assert status(3, 99, "call", "k99") == ("ok", 199) and status(3, 99, "result", "k99") == ("ok", 200)
    assert [r.status for r in out if r.conv_id == 4] == ["unanswered"] * 2
    assert got[1, 0, "system", None].json == '{"content":"hi \\"you\\"\\n","role":"system"}'
    assert got[1, 5, "call", "a"].json == ('{"role":"assistant","tool_calls":[{"function":{"arguments":{"chars":1,"question":"xé"},"name":"answer"},'
                                           '"id":"a","type":"function"}]}')
    assert '"arguments":"{bad"' in got[1, 7, "call", "c"].json and got[1, 11, "result", "zz"].json == '{"content":null,"role":"tool","tool_call_id":"zz"}'
    assert C.link_calls(messages.where("false")).collect() == []


def test_conversations_as_calls(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q" * 300), (1, 1, "assistant", None), (1, 2, "user", None), (2, 0, None, "x"), (2, 1, "assistant", "y")],
                                  "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("clash"))
    got = {(r.conv_id, r.turn): (r.kind, r.status, r.depth) for r in C.link_calls(C.from_conversations(turns)).collect()}
    assert got == {(1, 0): ("call", "ok", 1), (1, 1): ("result", "ok", 2), (1, 2): ("call", "invalid", 3), (2, 0): ("", "ok", 0), (2, 1): ("result", "orphan", None)}


def test_host_path_and_rules(spark):
    cases = [(None, "", "", None), ("no scheme", "", "", None), ("http://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", ("example.net/en/", "allow")),
             ("x://net/", "net", "/", ("net/", "block")), ("x://net", "net", "", None), ("x://planet/", "planet", "/", None), ("x://a.net?/en/", "a.net", "", None),
             ("https://example.com/de/1", "example.com", "/de/1", ("example.com/de/", "block")), ("https://example.com/DE/1", "example.com", "/DE/1", None),
             ("u://b.org/fr/", "b.org", "/fr/", ("org/fr/", "allow")), ("://É.org/fr", "É.org", "/fr", None), ("a://b://c/d", "b:", "//c/d", None)]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "page_id long, url string")
    host, path = U.host_path(F.col("url"))
    rule, verdict = U.ruled(F.col("h"), F.col("p"))
    got = rows.select("page_id", host.alias("h"), path.alias("p")).select("page_id", "h", "p", rule.alias("r"), verdict.alias("v")).collect()
    for r in got:
        _, h, p, want = cases[r.page_id]
        assert (r.h, r.p) == (h, p) and ((r.r, r.v) == (want or (None, None))), r


def rank_of(links, seeds, rounds):
    """Plain power iteration; links are (src, dst, weight)."""
    rank = dict(seeds)
    out = Counter()
    for s, _, w in links:
        out[s] += w
    for _ in range(rounds):
        new = Counter({h: (1 - U.DAMPING) * v for h, v in seeds.items()})
        for s, d, w in links:
            new[d] += U.DAMPING * rank.get(s, 0) * w / out[s]
        rank = new
    return rank


def test_propagation_and_verdicts(spark):
    link = lambda *hosts: "".join(f'<a HREF = "https://{h}/x">x</a><img src=//{h}>' for h in hosts)
    pages = [("http://bad.net/1", ""), ("http://bad.net/2", link("good.info")), ("http://good.org/fr/", link("nice.info", "self.info")), ("http://nice.info/", link("nice.info")),
             ("http://shady.info/", link("bad.net", "BAD.net")), ("http://shady.info/2", link("nice.info")), ("http://ring.info/", link("shady.info")), ("http://lone.info/", None),
             ("http://sub.good.org/", ""), (None, None), ("http://good.info/q", "")]
    docs = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, host string")
    judged = U.judge(docs)
    assert "Python" not in plan(judged)
    got = {r.page_id: r for r in judged.collect()}
    assert len(got) == len(pages)
    assert {i: got[i].verdict for i in got} == {0: "block", 1: "block", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "block", 7: "allow", 8: "allow", 9: "allow", 10: "allow"}
    found = [("bad.net", "good.info", 1), ("good.org", "nice.info", 1), ("good.org", "self.info", 1), ("shady.info", "bad.net", 1), ("shady.info", "nice.info", 1), ("ring.info", "shady.info", 1)]
    ties = [("sub.good.org", "good.org", 1), ("good.org", "sub.good.org", 1)]
    trust = rank_of(found + ties, {"good.org": 1.0}, U.ROUNDS)
    distrust = rank_of([(d, s, w) for s, d, w in found], {"bad.net": 1.0}, U.ROUNDS)
    for r in got.values():
        t, d = trust.get(r.host, 0), distrust.get(r.host, 0)
        assert abs(r.spam_mass - (d / (t + d) if t + d else 0)) < 1e-9
    assert U.judge(docs.where("false")).collect() == []
    assert {r.verdict for r in U.judge(docs.where("page_id = 7")).collect()} == {"allow"}


def test_fingerprint_hash_is_stable(spark):
    text = "the quick brown fox jumps over the lazy dog"
    a, b = (spark.createDataFrame([(t,)], "text string").select(P.fingerprint(F.col("text")).alias("f")).first().f for t in (text, text.upper()))
    assert a == b and hashlib.sha256(a.encode()).digest()
