"""Small tables with awkward rows, and brute-force versions."""

import collections
import random
import re

WORDS = re.compile(r"[^ \t-\r]+")
CLASHING = ["th", "rid", "keys", "point", "family", "spans", "score", "n_tokens", "host", "row", "_id", "component"]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def words(t):
    return WORDS.findall(lower(t or ""))


def shingles(t, k):
    w = words(t)
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


class Groups:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def near_texts(seed=5):
    """Texts of many lengths with groups of copies at all distances."""
    rng = random.Random(seed)
    out = [None, "", "   ", "one", "One", "a b c", "a b c d", "A B c d", "a b c d e"]
    for n in (3, 8, 9, 12, 20, 30, 60, 100, 200):
        for _ in range(3):
            base = prose(rng, n).split()
            out.append(" ".join(base))
            for copies in range(6):
                w = list(base)
                for _ in range(rng.randint(0, max(1, n // 12))):
                    i = rng.randrange(len(w))
                    w[i] = prose(rng, 1) if rng.random() < 0.6 else w[i].upper()
                out.append(" ".join(w) + rng.choice(["", " ", "\n", " tail"]))
    out += [out[20]] * 5
    line = prose(rng, 12)
    out += [f"{prose(rng, rng.randint(1, 6))}\n{line}" for _ in range(25)]
    return out


def frame(spark, texts, extra=True, ids=None):
    """documents with clashing extra columns."""
    names = ["doc_id", "text", "lang", "source", "n_chars"] + (CLASHING if extra else [])
    rows = [((ids[i] if ids else i), t, "en", "s", None if t is None else len(t), *([str(i)] * len(CLASHING) if extra else []))
            for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in names[5:])
    return spark.createDataFrame(rows, schema)


def linked_components(texts, k, percent, ids):
    """Brute force: (set size, least id of the component) of each position."""
    sets = [shingles(t, k) for t in texts]
    groups = Groups(range(len(texts)))
    inverted = collections.defaultdict(list)
    for i, s in enumerate(sets):
        shared = collections.Counter(j for g in s for j in inverted[g])
        for j, o in shared.items():
            if 100 * o >= percent * (len(s) + len(sets[j]) - o):
                groups.join(i, j)
        for g in s:
            inverted[g].append(i)
    least = {}
    for i in range(len(texts)):
        r = groups.find(i)
        if ids[i] is not None:
            least[r] = min(least.get(r, ids[i]), ids[i])
    return [(len(s), least.get(groups.find(i)) if s else ids[i]) for i, s in enumerate(sets)]
