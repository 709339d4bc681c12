"""Fill-in-middle transformation with a sparse exception index.

A text is n units: runs of ASCII letters, and single other characters. Two
numbers drawn from the document id cut the units into prefix, middle and
suffix, which are written with sentinels in prefix-suffix-middle or
suffix-prefix-middle order; some documents stay plain.

Cuts are found in the UTF-8 bytes. A byte begins a unit if it is a letter
behind something else, or no letter and no continuation byte. The index of a
slice of text records only its multibyte characters: their places and the
bytes they have beyond one, running. ``searchsorted`` in it turns code points
to bytes and back; between exceptions, and in ASCII text everywhere, the two
differ by a constant. Of a long text only totals of its slices are kept, and
the index of the slices that hold a cut.

Defined cases: a null or empty text has no units, is plain and gives the empty
text; a text that holds a sentinel is plain; a null document id counts as the
empty string in the draw; repeated rows are kept and equal; one result row for
each input row; kept columns with the name of a result column are replaced by
it; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns

#: Sentinels of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SLICE_BYTES = 1 << 20
BATCH_BYTES = 1 << 22

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True


class SparseIndex:
    """Multibyte characters of UTF-8 bytes: first bytes, and running bytes beyond one for each."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        self.excess = np.zeros(len(lead) + 1, np.int64)
        np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0), out=self.excess[1:])

    def chars(self, byte: int) -> int:
        """Code points before a byte that begins a character (or the end)."""
        return byte - int(self.excess[np.searchsorted(self.at, byte)])

    def byte(self, char: int) -> int:
        """The first byte of a code point (or the end)."""
        return char + int(self.excess[np.searchsorted(self.at - self.excess[:-1], char)])


def unit_starts(data: np.ndarray, before: int) -> np.ndarray:
    """Places in ``data`` where a unit begins; ``before`` is the byte in front (0: none)."""
    letter = _LETTER[data]
    inner = letter.copy()
    inner[1:] &= letter[:-1]
    inner[:1] &= _LETTER[before]
    return np.flatnonzero(~inner & ~_CONTINUES[data])


class Cuts:
    """Where units begin in a text, by slices."""

    def __init__(self, data: np.ndarray, slice_bytes: int = SLICE_BYTES):
        self.data, self.first, self.units, self.chars = data, [0], [0], [0]
        while self.first[-1] < len(data):
            a = self.first[-1]
            b = min(len(data), a + slice_bytes)
            while b < len(data) and _CONTINUES[data[b]]:
                b += 1
            self.units.append(self.units[-1] + len(unit_starts(data[a:b], self._before(a))))
            self.chars.append(self.chars[-1] + b - a - int(np.count_nonzero(_CONTINUES[data[a:b]])))
            self.first.append(b)

    def _before(self, at: int) -> int:
        return int(self.data[at - 1]) if at else 0

    @property
    def n(self) -> int:
        return self.units[-1]

    def cut(self, unit: int) -> tuple[int, int]:
        """(byte, code point) behind ``unit`` units."""
        if unit >= self.n:
            return self.first[-1], self.chars[-1]
        s = int(np.searchsorted(self.units, unit, "right")) - 1
        a, b = self.first[s], self.first[s + 1]
        byte = int(unit_starts(self.data[a:b], self._before(a))[unit - self.units[s]])
        return a + byte, self.chars[s] + SparseIndex(self.data[a:b]).chars(byte)


def _transform(sentinels: tuple[str, str, str], slice_bytes: int):
    p, s, m = (x.encode() for x in sentinels)
    names = ["row", "n", "prefix_chars", "middle_chars", "output"]

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form, draw1, draw2 = (batch.column(i).to_pylist() for i in (2, 3, 4))
            start, held, out = 0, 0, []
            for row, value in enumerate(batch.column(1).cast(pa.large_binary())):
                raw = value.as_py() or b""
                cuts = Cuts(np.frombuffer(raw, np.uint8), slice_bytes)
                n = cuts.n
                if form[row] == "plain":
                    out.append((n, None, None, raw))
                else:
                    (b1, c1), (b2, c2) = (cuts.cut(k) for k in sorted((draw1[row] % (n + 1), draw2[row] % (n + 1))))
                    prefix, middle, suffix = raw[:b1], raw[b1:b2], raw[b2:]
                    text = (p, prefix, s, suffix, m, middle) if form[row] == "psm" else (s, suffix, p, prefix, m, middle)
                    out.append((n, c1, c2 - c1, b"".join(text)))
                held += len(raw)
                if held >= BATCH_BYTES or row + 1 == batch.num_rows:
                    made = [pa.array(x, pa.int64()) for x in list(zip(*out))[:3]]
                    text = pa.array([x[3] for x in out], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(out)), *made, text], names=names)
                    start, held, out = row + 1, 0, []

    return make


def draws(id_col: str, seed: int) -> list[Column]:
    """Four 32-bit numbers from the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 1, transform_percent: int = 90, spm_percent: int = 20, id_col: str = "doc_id",
                   text_col: str = "text", keep: list[Column] | None = None, sentinels: tuple[str, str, str] = SENTINELS,
                   slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The ``keep`` columns (default: all) with n, form (plain, psm or spm),
    prefix_chars, middle_chars (null if plain) and the output text."""
    made = ("n", "form", "prefix_chars", "middle_chars", "output")
    text = F.coalesce(F.col(text_col), F.lit(""))
    h1, h2, h3, h4 = draws(id_col, seed)
    plain = (text == "") | (h3 % 100 >= transform_percent)
    for mark in sentinels:
        plain |= text.contains(F.lit(mark))
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    row = F.struct(F.struct(*(keep or columns(docs, made))).alias("kept"), form.alias("form")).alias("row")
    source = docs.select(row, text.alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))
    empty = [F.lit(None).cast("long").alias(c) for c in ("n", "prefix_chars", "middle_chars")]
    schema = source.select("row", *empty, F.lit(None).cast("string").alias("output")).schema
    out = source.mapInArrow(_transform(sentinels, slice_bytes), schema)
    return out.select("row.kept.*", "n", "row.form", "prefix_chars", "middle_chars", "output")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text behind an output: it holds each sentinel once, unless plain."""
    part = F.split(output, "|".join(r"\Q" + x + r"\E" for x in sentinels), -1)
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))


QUERY_SQL = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || CAST(doc_id AS VARCHAR)) AS x FROM documents),
drawn AS (
  SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM units),
cut AS (
  SELECT doc_id, text, n, array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
         array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
         array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""
