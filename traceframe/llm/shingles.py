"""Word shingle sets of Arrow string columns, as sorted 64-bit hashes.

Words are runs without ASCII white space, A-Z lower-cased. A word's hash is a
polynomial over random byte values, taken from running sums so that whole
column chunks are hashed at once; a shingle's hash mixes its words in order.
A text with fewer than ``k`` words has its whole sequence as the only shingle,
a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_VALUES = _rng.integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[65:91] = _VALUES[97:123]
_SPACE = np.zeros(257, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C13
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = _rng.integers(1, 2 ** 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words(data: np.ndarray, starts_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hashes of the words of ``data``; a word also starts at each of ``starts_text``."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * _power(_BASE, n), out=sums[1:])
    text = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[starts_text] = True
    edge[n] = True
    begin = text.copy()
    begin[1:] &= ~text[:-1] | edge[1:n]
    end = text.copy()
    end[:-1] &= ~text[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    h = (sums[ends] - sums[starts]) * _power(_INVERSE, n + 1)[starts]
    return starts, mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def _column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: (first row, word offsets of its rows, word hashes)."""
    if not len(column):
        return
    data, off = _column(column)
    row, n = 0, len(off) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(off, off[row] + CHUNK_BYTES, "right")) - 1)
        lo, hi = int(off[row]), int(off[last])
        if hi - lo <= 2 * CHUNK_BYTES:
            starts, h = _words(data[lo:hi], off[row:last] - lo) if hi > lo else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            yield row, np.searchsorted(starts, off[row:last + 1] - lo, "left"), h
        else:  # one long text: in slices that end at white space
            parts = []
            while lo < hi:
                cut = min(lo + CHUNK_BYTES, hi)
                while cut < hi and not _SPACE[data[cut]]:
                    cut += 1
                parts.append(_words(data[lo:cut], np.zeros(1, np.int64))[1])
                lo = cut
            h = np.concatenate(parts)
            yield row, np.array([0, len(h)]), h
        row = last


def shingle_hashes(offsets: np.ndarray, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and hashes of all shingles in order, repeats included."""
    n = np.diff(offsets)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_off = np.concatenate([[0], np.cumsum(count)])
    if not out_off[-1]:
        return out_off, np.zeros(0, np.uint64)
    first = np.repeat(offsets[:-1] - out_off[:-1], count) + np.arange(out_off[-1])
    size = np.repeat(np.minimum(n, k), count)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    h = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(k):
        h += np.where(size > j, padded[first + j] * _PLACES[j], np.uint64(0))
    return out_off, mix(h)


def shingle_sets(column: pa.Array, k: int, with_words: bool = False) -> Iterator[tuple]:
    """For runs of rows: (first row, offsets, hashes), ascending and distinct
    within each row; ``with_words`` adds the rows' numbers of words."""
    for row, woff, words in word_hashes(column):
        off, h = shingle_hashes(woff, words, k)
        for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
            if b - a > 1:
                h[a:b].sort()
        fresh = np.ones(len(h), bool)
        fresh[1:] = h[1:] != h[:-1]
        fresh[off[:-1][off[:-1] < len(h)]] = True
        kept = np.concatenate([[0], np.cumsum(fresh)])
        yield (row, kept[off], h[fresh], np.diff(woff)) if with_words else (row, kept[off], h[fresh])


def digests(offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that identify each set."""
    out = []
    for salt in (0x632BE59BD9B4E019, 0xE220A8397B1DCDAF):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes ^ np.uint64(salt)), out=sums[1:])
        out.append(sums[offsets[1:]] - sums[offsets[:-1]])
    return out[0], out[1]


def list_array(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64), kind))
