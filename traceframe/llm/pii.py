"""Personal data by weak supervision, in DataFrame functions only.

Candidate spans of four kinds come from strict base patterns and from broader
ones. Labelers (strict format, validity check, gazetteer, words before the
span, warnings before the span, borders) vote on each candidate: 1 personal, 0
not, null abstains. Counts of equal vote patterns over all documents, a table
bounded by the number of patterns, feed an expectation-maximisation that
estimates each labeler's reliability per kind without labelled data. Its
posteriors train a logistic span classifier on votes and shape, whose weights
become literals of the final expression. Valid base spans always stay; other
candidates are added if the classifier accepts them and they touch no base span.

Everything about a document happens within its row: two scans, no shuffle of
texts, and long texts or many spans stay in one row.

Defined cases: a null text is empty and has no spans; invalid base matches are
dropped without retries; repeated rows and null ids are kept; with no
candidates at all the classifier accepts nothing; an empty table gives no
rows; columns not asked for are ignored. Positions are code points, end
exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, columns

KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.8
CONTEXT = 40
BLOCK = 64

#: Base patterns. A search tries each run of allowed characters once, which
#: finds the same leftmost matches in linear time.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Broader patterns: spelled-out addresses, eight-group addresses, one of several adjoining numbers, national numbers.
BROAD = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}\x20?[\[(]\x20?(?i:at)\x20?[\])]\x20?[A-Za-z0-9-]{1,63}"
             r"(?:\x20?(?:[\[(]\x20?(?i:dot)\x20?[\])]|\.)\x20?[A-Za-z0-9-]{2,63}){1,4}",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])",
}
#: What a text must contain for a kind to be looked for.
HINT = {"email": r"@|[\[(]\x20?(?i:at)\x20?[\])]", "ip": r"[0-9]", "card": r"[0-9]", "phone": r"[0-9]"}

TLDS = ("com", "org", "net", "edu", "gov", "io", "info", "biz", "de", "fr", "es", "it", "nl", "uk", "eu", "ch", "at", "us", "ca")
CONTEXT_WORDS = {
    "email": r"(?i)\b(e-?mail|mail|contact|write|correo|courriel|kontakt)\b",
    "ip": r"(?i)\b(ip|host|server|address|adresse|login|client)\b",
    "card": r"(?i)\b(card|visa|mastercard|credit|debit|payment|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(phone|tel|telephone|call|fax|mobile|telefon|t.l.phone|tel.fono)\b",
}
WARNING = r"(?i)(\b(version|release|token|order|invoice|item|isbn|sku|ref|page|section|chapter)\b[\x20.:#=\x22-]*|[#$=\x22])$"
LABELERS = ("strict", "valid", "gazetteer", "context", "warning", "border")


def _find(text: Column, pattern: str, build) -> Column:
    """Array of ``build(raw, start, end, before, after)`` over the matches of a
    pattern. Starts are running sums of gap and match lengths, added up by
    blocks so that many matches stay cheap."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def of_gaps(m: Column, g: Column) -> Column:
        def of_steps(steps: Column) -> Column:
            block = F.floor((F.size(m) - 1) / BLOCK).cast("int")
            sums = F.transform(F.sequence(F.lit(0), block), lambda b: total(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))))
            heads = bind(sums, lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))))

            def span(x: Column, i: Column, head: Column) -> Column:
                b = F.floor(i / BLOCK).cast("int")
                start = F.get(head, b) + total(F.slice(steps, b * BLOCK + 1, i - b * BLOCK)) + F.length(F.get(g, i))
                return bind(start, lambda s: build(x, s, s + F.length(x), F.right(F.get(g, i), F.lit(CONTEXT)), F.left(F.get(g, i + 1), F.lit(1))))

            return bind(heads, lambda head: F.transform(m, lambda x, i: span(x, i, head)))

        return bind(F.transform(m, lambda x, i: F.length(x) + F.length(F.get(g, i))), of_steps)

    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                lambda m: F.when(F.size(m) > 0, bind(F.split(text, pattern, -1), lambda g: of_gaps(m, g))))


def _digits(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: bind(c.cast("int") * (i % 2 + 1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


def _valid(kind: str, raw: Column, strict: bool) -> Column:
    n = F.length(_digits(raw))
    if kind == "ip" and strict:
        short = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(raw, r"\."), lambda p: F.when(F.length(short(p)) <= 3, F.concat(F.lit("0"), short(p)).cast("int") <= 255).otherwise(False))
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), _luhn(_digits(raw))).otherwise(False)
    if kind == "phone" and strict:
        return (n >= 8) & (n <= 15)
    return F.lit(True) if strict else F.lit(False)


def _votes(kind: str, strict: bool, raw: Column, before: Column, after: Column) -> list[Column]:
    """One vote for each of LABELERS: 1, 0 or null."""
    one, zero, none = F.lit(1), F.lit(0), F.lit(None).cast("int")
    yes_no = lambda c: F.when(c, one).otherwise(zero)
    n = F.length(_digits(raw))
    if kind == "email":
        check, known = none if not strict else yes_no(~raw.rlike(r"^[.%+-]|\.\.|[.%+-]@")), yes_no(
            F.lower(F.regexp_extract(raw, r"([A-Za-z0-9-]+)$", 1)).isin(*TLDS))
    elif kind == "ip":
        check = yes_no(_valid(kind, raw, strict)) if strict else one
        known = F.when(raw.rlike(r"^(0|127|255)\.|^(?:0+:){7}"), zero).otherwise(none)
    elif kind == "card":
        check, known = yes_no((n >= 13) & (n <= 19) & _luhn(_digits(raw))), yes_no(raw.rlike(r"^[3-6]"))
    else:
        check = yes_no(_valid(kind, raw, strict)) if strict else yes_no(raw.rlike(r"^\(?[2-9]"))
        known = yes_no(raw.rlike(r"^\+(1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])")) if strict else none
    return [one if strict else none, check, known,
            F.when(before.rlike(CONTEXT_WORDS[kind]), one).otherwise(none),
            F.when(before.rlike(WARNING), zero).otherwise(none),
            F.when(before.rlike(r"[A-Za-z0-9]$") | after.rlike(r"[A-Za-z0-9]"), zero).otherwise(one)]


def _candidates(text: Column) -> Column:
    """Array of struct(k, start, end, base, shape, votes) of all kinds."""
    parts = []
    for k, kind in enumerate(KINDS):
        for strict, pattern in ((True, BASE[kind]), (False, BROAD.get(kind))):
            if pattern is None:
                continue

            def build(raw, start, end, before, after, k=k, kind=kind, strict=strict):
                shape = F.length(_digits(raw)) if kind in ("card", "phone") else F.least(F.floor(F.length(raw) / 8).cast("int"), F.lit(8))
                return F.struct(F.lit(k).alias("k"), start.alias("start"), end.alias("end"),
                                (F.lit(strict) & _valid(kind, raw, strict)).alias("base"),
                                F.least(shape, F.lit(20)).alias("shape"),
                                F.array(*[v.cast("int") for v in _votes(kind, strict, raw, before, after)]).alias("votes"))

            found = _find(text, pattern, build)
            if kind in ("card",):  # short numbers are not worth a vote
                found = F.filter(found, lambda c: c["shape"] >= 13)
            parts.append(F.when(text.rlike(HINT[kind]), found))
    empty = F.array().cast("array<struct<k:int,start:int,end:int,base:boolean,shape:int,votes:array<int>>>")
    return F.flatten(F.array(*[F.coalesce(p, empty) for p in parts]))


def estimate(patterns: list[tuple[int, tuple, int]], rounds: int = 100) -> dict[tuple[int, tuple], float]:
    """Posterior of each (kind, votes) by EM over (kind, votes, count) with
    conditionally independent labelers; abstaining tells nothing. Reliabilities
    start, and are smoothed, towards labelers that are right more often than not."""
    out = {}
    for kind in {k for k, _, _ in patterns}:
        rows = [(v, n) for k, v, n in patterns if k == kind]
        rate = [(0.8, 0.2)] * len(LABELERS)  # P(vote 1 | personal), P(vote 1 | not)
        prior = 0.5
        for _ in range(rounds):
            post = []
            for votes, _n in rows:
                a, b = math.log(prior), math.log(1 - prior)
                for (p, q), v in zip(rate, votes):
                    if v is not None:
                        a += math.log(p if v else 1 - p)
                        b += math.log(q if v else 1 - q)
                post.append(1 / (1 + math.exp(min(700, b - a))))
            total = sum(n for _, n in rows)
            prior = (sum(p * n for p, (_, n) in zip(post, rows)) + 5) / (total + 10)
            new = []
            for j in range(len(LABELERS)):
                one = [sum(p * n for p, (v, n) in zip(post, rows) if v[j] == x) for x in (0, 1)]
                two = [sum((1 - p) * n for p, (v, n) in zip(post, rows) if v[j] == x) for x in (0, 1)]
                new.append(((one[1] + 8) / (sum(one) + 10), (two[1] + 2) / (sum(two) + 10)))
            moved = max(abs(x - y) for r, s in zip(rate, new) for x, y in zip(r, s))
            rate = new
            if moved < 1e-6:
                break
        out |= {(kind, v): p for p, (v, _) in zip(post, rows)}
    return out


def features(votes: tuple, shape: int) -> list[float]:
    return [1.0, shape / 10] + [x for v in votes for x in (float(v == 1), float(v == 0))]


def fit_classifier(rows: list[tuple[int, tuple, int, int, float]], rounds: int = 300, rate: float = 0.5) -> dict[int, list[float]]:
    """Logistic weights by kind from (kind, votes, shape, count, posterior)."""
    out = {}
    for kind in sorted({r[0] for r in rows}):
        data = [(features(v, s), n, p) for k, v, s, n, p in rows if k == kind]
        total = sum(n for _, n, _ in data)
        w = [0.0] * len(data[0][0])
        for _ in range(rounds):
            grad = [0.002 * x for x in w]
            for x, n, p in data:
                z = sum(a * b for a, b in zip(w, x))
                err = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * n / total
                for j, a in enumerate(x):
                    grad[j] += err * a
            w = [a - rate * g for a, g in zip(w, grad)]
        out[kind] = w
    return out


def train(docs: DataFrame, text_col: str = "text") -> dict[int, list[float]]:
    """Weights of the span classifier, learned from the votes on all documents."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counts = (docs.select(F.explode(_candidates(text)).alias("c")).groupBy("c.k", "c.votes", "c.shape").count().collect())
    rows = sorted(((r["k"], tuple(r["votes"]), r["shape"], r["count"]) for r in counts), key=str)
    merged: dict[tuple, int] = {}
    for k, v, _, n in rows:
        merged[k, v] = merged.get((k, v), 0) + n
    posterior = estimate([(k, v, n) for (k, v), n in merged.items()])
    return fit_classifier([(k, v, s, n, posterior[k, v]) for k, v, s, n in rows])


def _accepted(c: Column, weights: dict[int, list[float]], threshold: float) -> Column:
    cut = math.log(threshold / (1 - threshold))
    out = F.lit(False)
    for kind, w in weights.items():
        z = F.lit(w[0]) + F.lit(w[1] / 10) * c["shape"]
        for j in range(len(LABELERS)):
            vote = F.get(c["votes"], F.lit(j))
            z = z + F.when(vote == 1, F.lit(w[2 + 2 * j])).when(vote == 0, F.lit(w[3 + 2 * j])).otherwise(F.lit(0.0))
        out = F.when(c["k"] == kind, z >= cut).otherwise(out)
    return out


def spans(docs: DataFrame, weights: dict[int, list[float]], keep: list[Column] | None = None, text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """The ``keep`` columns with ``spans``: array of (k, start, end, base) by kind and start."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def choose(cands: Column) -> Column:
        base = F.filter(cands, lambda c: c["base"])
        def added(b: Column) -> Column:
            # A failed check (octets, digits, checksum) is final.
            more = F.filter(cands, lambda c: ~c["base"] & F.coalesce(F.get(c["votes"], F.lit(1)) == 1, F.lit(True)) & _accepted(c, weights, threshold))
            free = F.filter(more, lambda c: ~F.exists(b, lambda x: (x["start"] < c["end"]) & (c["start"] < x["end"])))
            return F.array_sort(F.transform(F.concat(b, free), lambda c: F.struct(*[c[f].alias(f) for f in ("k", "start", "end", "base")])))
        return bind(base, added)

    return docs.select(*(keep or columns(docs, ("spans",))), bind(_candidates(text), choose).alias("spans"))


def span_text(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda s: F.get(F.array(*[F.lit(k) for k in KINDS]), s["k"])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; spans that overlap are joined."""
    tag = lambda s: F.get(F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS]), s["k"])
    by_start = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["k"].alias("k"))))

    def cut(s: Column) -> Column:
        reach = F.transform(s, lambda _, i: F.coalesce(F.array_max(F.transform(F.slice(s, F.lit(1), i), lambda x: x["end"])), F.lit(0)))

        def join(done: Column) -> Column:
            part = F.transform(s, lambda x, i: bind(F.get(done, i), lambda d: F.concat(
                F.when(x["start"] > d, F.substring(text, d + 1, x["start"] - d)).otherwise(""), F.when(x["end"] > d, tag(x)).otherwise(""))))
            last = F.array_max(F.transform(s, lambda x: x["end"]))
            return F.concat(F.array_join(part, ""), F.substring(text, last + 1, F.length(text)))

        return bind(reach, join)

    return F.when(F.size(found) > 0, bind(by_start, cut)).otherwise(text)
