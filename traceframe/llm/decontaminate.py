"""Benchmark decontamination: q-gram lemma filtering with banded alignment.

Texts and benchmark items are lower-cased with white space collapsed. A
document is contaminated by an item if some part of it is within the item's
edit budget of the whole item. An occurrence with at most k edits stays within
k + 1 neighbouring diagonals and shares at least m - q + 1 - k*q of the item's
q-grams there. So matching q-grams are counted in overlapping diagonal bands
of width 2(k + 1), bands that reach the bound are kept, and each kept region
is verified by an alignment restricted to its band.

The budget is ``max_edit_rate`` of the item's length, less where a larger one
would leave the bound without force; items under ``min_chars`` normalised
characters are not looked for. Items are worked on in blocks of bounded size,
one pass over the documents for each block, so the benchmark may be of any
size; every pass sees all documents.

Defined cases: null and empty texts are clean; a null item text is ignored and
equal items are found together; an item with a null id contaminates without
being listed; an empty benchmark leaves everything clean; repeated rows and
null document ids are kept; other columns are kept
as they are, but for any named contaminated or matches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, written

Q = 10
MAX_EDIT_RATE = 0.08
MIN_CHARS = 40
BLOCK_CHARS = 8 << 20
#: Postings looked at in one step, and how often an item may hold a gram before its places are taken together.
STEP_POSTINGS = 1 << 19
REPEATED = 16
_BITS = 21
_K = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(m: int, q: int, rate: float) -> int:
    """Edits allowed for an item of ``m`` characters; the q-gram bound stays at least 1."""
    return max(0, min(int(rate * m), (m - q) // q))


def grams(text: str, q: int) -> np.ndarray:
    """A 64-bit code for each q-gram. Characters outside Latin-1 fall together,
    which can only add candidates."""
    raw = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
    n = len(raw) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if q >= 8:  # eight characters are one little-endian word
        code, rest = np.ndarray(n, "<u8", raw[:n + 7].tobytes(), strides=(1,)).copy(), range(8, q)
    else:
        code, rest = np.zeros(n, np.uint64), range(q)
    for j in rest:
        code = code * np.uint64(0xD6E8FEB86659FD93) + raw[j:j + n]
    return code * _K


class BenchmarkIndex:
    """q-gram postings of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], q: int, rate: float, min_chars: int):
        by_text: dict[str, list] = {}
        for item, text in items:
            t = normalise(text)
            if len(t) >= max(min_chars, q):
                by_text.setdefault(t, []).append(item)
        self.q = q
        self.texts = list(by_text)
        self.ids = [sorted({i for i in v if i is not None}) for v in by_text.values()]
        self.edits = np.array([budget(len(t), q, rate) for t in self.texts], np.int64)
        self.bound = np.array([len(t) - q + 1 - k * q for t, k in zip(self.texts, self.edits.tolist())], np.int64)
        codes = [grams(t, q) for t in self.texts]
        code = np.concatenate([np.zeros(0, np.uint64), *codes])
        item = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        at = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(c)) for c in codes]])
        order = np.argsort(code, kind="stable")
        code, item, at = code[order], item[order], at[order]
        # Of a gram that an item holds often, one place for each edits + 1 neighbouring ones: a text's gram then
        # counts in every band it counted in, but not once for each repetition.
        step = self.edits[item] + 1 if len(item) else at
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (item[1:] != item[:-1])
        run = np.cumsum(new) - 1
        wide = (np.bincount(run)[run] > REPEATED) if len(run) else new
        block = np.where(wide, at // np.maximum(step, 1) * step, at)
        keep = new.copy()
        keep[1:] |= block[1:] != block[:-1]
        code, self.item, self.at, self.wide = code[keep], item[keep], block[keep], wide[keep]
        self.code, first = np.unique(code, return_index=True)
        self.first = np.append(first, len(code))
        self.present = np.zeros(1 << _BITS, bool)
        self.present[self.code >> np.uint64(64 - _BITS)] = True

    def candidates(self, text: str) -> list[tuple[int, int, int]]:
        """(item, lowest diagonal, highest diagonal) of bands that reach the bound."""
        code = grams(text, self.q)
        pos = np.flatnonzero(self.present[code >> np.uint64(64 - _BITS)])
        if not len(pos) or not len(self.code):
            return []
        code = code[pos]
        where = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        known = self.code[where] == code
        pos, where = pos[known], where[known]
        if len(pos) < self.bound.min():
            return []
        # Items whose grams occur often enough anywhere in the text.
        seen, times = np.unique(where, return_counts=True)
        posting, of = self._postings(seen)
        likely = np.bincount(self.item[posting], weights=times[of], minlength=len(self.texts)) >= self.bound
        if not likely.any():
            return []
        low = -int(self.at.max()) - 3
        width = int(pos[-1]) - low + 1
        ends = np.cumsum(self.first[where + 1] - self.first[where])
        cuts = [0, *(np.unique(np.searchsorted(ends, np.arange(STEP_POSTINGS, ends[-1], STEP_POSTINGS))) + 1).tolist(), len(pos)]
        found, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:]):
            posting, of = self._postings(where[a:b])
            keep = likely[self.item[posting]]
            posting, of = posting[keep], of[keep]
            item = self.item[posting]
            band = (pos[a:b][of] - self.at[posting]) // (self.edits[item] + 1)  # a band is [band*step, (band + 2)*step)
            key = item * width + band - low
            key = np.concatenate([key, key - 1, key[self.wide[posting]] - 2])
            here, times = np.unique(key, return_counts=True)
            found, back = np.unique(np.concatenate([found, here]), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([n, times]), minlength=len(found)).astype(np.int64)
        which = found // width
        out = []
        for i, b in zip(which[n >= self.bound[which]].tolist(), (found % width + low)[n >= self.bound[which]].tolist()):
            s = int(self.edits[i]) + 1
            out.append((i, b * s, (b + 2) * s - 1))
        return out

    def _postings(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The postings of known grams, one after another, and whose each is."""
        count = self.first[codes + 1] - self.first[codes]
        ends = np.cumsum(count)
        of = np.repeat(np.arange(len(codes)), count)
        return np.arange(len(of)) - np.repeat(ends - count, count) + np.repeat(self.first[codes], count), of

    def matches(self, text: str) -> dict[int, int]:
        """Least edits found for each item that occurs in a normalised text."""
        out: dict[int, int] = {}
        for i, lo, hi in self.candidates(text):
            if out.get(i) == 0:
                continue
            pattern, k = self.texts[i], int(self.edits[i])
            region = text[max(0, lo - k):hi + k + len(pattern) + 1]
            edits = 0 if pattern in region else banded_edits(pattern, text, lo - k, hi + k, k)
            if edits <= k:
                out[i] = min(edits, out.get(i, edits))
        return out


def banded_edits(pattern: str, text: str, lo: int, hi: int, k: int) -> int:
    """Least edits of the whole pattern against any part of the text on
    diagonals lo..hi (text position minus pattern position); k + 1 if above k."""
    m, n = len(pattern), len(text)
    p = np.frombuffer(pattern.encode("utf-32-le", "surrogatepass"), np.uint32)
    start = max(0, lo)
    t = np.frombuffer(text[start:max(start, hi + m + 1)].encode("utf-32-le", "surrogatepass"), np.uint32)
    diagonals = np.arange(lo, hi + 1)
    width, big = len(diagonals), m + n + 1
    ramp = np.arange(width)
    row = np.where((diagonals >= 0) & (diagonals <= n), 0, big)
    # Below the text's start, rows begin once the diagonal reaches it.
    for i in range(m):
        j = diagonals + i  # text position that pattern[i] meets
        ok = (j >= 0) & (j < n)
        char = t[np.clip(j - start, 0, max(0, len(t) - 1))] if len(t) else np.zeros(width, np.uint32)
        diag = np.where(ok, row + (char != p[i]), big)
        up = np.append(row[1:] + 1, big)
        best = np.minimum(diag, up)
        best[(j + 1 < 0) | (j + 1 > n)] = big
        best[j + 1 == 0] = np.minimum(best[j + 1 == 0], i + 1)
        row = np.minimum.accumulate(best - ramp) + ramp
        row[(j + 1 < 0) | (j + 1 > n)] = big
        if row.min() > k:
            return k + 1
    return min(int(row.min()), k + 1)


def _pass(docs: DataFrame, items: list[tuple], q: int, rate: float, min_chars: int) -> DataFrame:
    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = BenchmarkIndex(items, q, rate, min_chars)
        for batch in batches:
            hit, found = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            if index.texts:
                for row, value in enumerate(batch.column(1)):
                    text = normalise(value.as_py())
                    for i, edits in sorted(index.matches(text).items()) if text else ():
                        hit[row] = True
                        found[row] = found[row] + [{"item_id": x, "edits": edits} for x in index.ids[i]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(hit, pa.bool_()), pa.array(found, batch.schema.field(3).type)],
                schema=batch.schema)

    return docs.mapInArrow(look, docs.schema)


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[Column] | None = None, text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", q: int = Q, max_edit_rate: float = MAX_EDIT_RATE,
                  min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The ``keep`` columns of all documents with ``contaminated`` and
    ``matches``, an array of (item_id, edits) by item id."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    out = docs.select(F.struct(*(keep or columns(docs, ("contaminated", "matches")))).alias("row"), F.col(text_col).alias("text"),
                      F.lit(False).alias("contaminated"),
                      F.array().cast("array<struct<item_id:bigint,edits:bigint>>").alias("matches"))
    for b in range(blocks):
        block = [tuple(r) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()]
        out = _pass(out, block, q, max_edit_rate, min_chars)
        if b + 1 < blocks:
            out = written(out)
    return out.select("row.*", "contaminated", F.array_sort("matches").alias("matches"))
