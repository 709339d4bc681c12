"""SentencePiece encoding and decoding by a distinct-chunk table.

A text becomes marked words: runs of white-space markers, each with what
follows up to the next marker. Where no piece of the vocabulary has a marker
behind another character, no merge reaches across two marked words, so each
can be segmented alone. A task keeps a table of the distinct marked words it
has met; the library segments a word once, when it enters the table, and the
ids of a text are gathered from the table by the positions of its words.
Words repeat, so the library sees a small part of the text. The table holds a
bounded number of characters and starts anew beyond; a vocabulary whose pieces
do cross markers (or that normalises texts) has whole texts as words.

Decoding cuts id lists in front of marked pieces, so that a long list is never
one Python list, and joins what the library gives for the parts.

Defined cases: a null or empty text has the end id only and decodes to the
empty text; a null id list decodes to null; long texts are worked through in
slices that end at a marker; null document ids, repeated rows and other
columns asked for by ``keep`` stay as they are, one result row for each input
row, and a kept column with the name of a result column is replaced by it; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, vocabulary_path

MARK = "▁"
#: Characters that the table of a task holds before it starts anew.
TABLE_CHARS = 1 << 21
SLICE_CHARS = 1 << 18
#: Ids of one result batch, and of one call of the library's decoder.
BATCH_IDS = 1 << 18
PART_IDS = 1 << 16

_MARKED = re.compile(" +[^ ]*")
_PROBE = "a  b\tｃ é ﬁ²  　x "
_CODECS: dict = {}


class _Words(dict):
    """Numbers of marked words; unknown ones get the next number and wait to be segmented."""

    def __init__(self) -> None:
        self.waiting: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.waiting.append(word)
        return n


class _Growing:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.n, self._held = 0, np.zeros(1 << 10, kind)

    @property
    def values(self) -> np.ndarray:
        return self._held[:self.n]

    def add(self, more) -> None:
        end = self.n + len(more)
        if end > len(self._held):
            self._held = np.concatenate([self.values, np.zeros(max(end, 2 * self.n) - self.n, self._held.dtype)])
        self._held[self.n:end] = more
        self.n = end


class PieceCodec:
    """A sentencepiece model with its distinct-chunk table."""

    def __init__(self, path: str, table_chars: int = TABLE_CHARS):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.separable = (all(MARK not in p.lstrip(MARK) for p in pieces)
                          and self.model.normalize(_PROBE) == MARK + _PROBE.replace(" ", MARK))
        self.end = self.model.eos_id()
        self.starts_word = np.array([p.startswith(MARK) for p in pieces])
        one = self.model.encode("a", num_threads=1)
        self.lone_mark = self.model.encode("a ", num_threads=1)[len(one):]
        self.table_chars = table_chars
        self._new_table()

    def _new_table(self) -> None:
        self.words, self.held = _Words(), 0
        self.offsets, self.flat = _Growing(np.int64), _Growing(np.int32)
        self.offsets.add([0])

    def _segment_waiting(self) -> None:
        """The library segments the words that entered the table; its dummy prefix stands for their first marker."""
        waiting, self.words.waiting = self.words.waiting, []
        if not waiting:
            return
        ids = self.model.encode([w[1:] for w in waiting], num_threads=1)
        ids = [self.lone_mark if w == " " else x for w, x in zip(waiting, ids)]
        self.held += sum(map(len, waiting))
        self.offsets.add(self.flat.n + np.cumsum(list(map(len, ids))))
        self.flat.add(list(chain.from_iterable(ids)))

    def _join(self, parts: list[str]) -> list[np.ndarray]:
        """The ids of texts (or slices), gathered from the table by the positions of their words."""
        if self.held > self.table_chars:
            self._new_table()
        found = [_MARKED.findall(p) for p in parts]
        word = np.fromiter(map(self.words.__getitem__, chain.from_iterable(found)), np.int64)
        self._segment_waiting()
        first = self.offsets.values[word]
        count = self.offsets.values[word + 1] - first
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat.values[np.repeat(first - ends[:-1], count) + np.arange(ends[-1])]
        return np.split(ids, ends[np.cumsum(list(map(len, found)))][:-1])

    def encode_all(self, texts: Iterable[str | None], slice_chars: int = SLICE_CHARS) -> Iterator[np.ndarray]:
        """The ids of each text in turn, without begin and end."""
        if not self.separable:
            for t in texts:
                yield np.array(self.model.encode(t or "", num_threads=1), np.int32)
            return
        waiting, held = [], 0
        for t in texts:
            marked = " " + t.replace(MARK, " ") if t else ""
            if len(marked) > slice_chars:
                if waiting:
                    yield from self._join(waiting)
                    waiting, held = [], 0
                yield np.concatenate([self._join([part])[0] for part in slices(marked, slice_chars)])
                continue
            waiting.append(marked)
            held += len(marked)
            if held >= slice_chars:
                yield from self._join(waiting)
                waiting, held = [], 0
        if waiting:
            yield from self._join(waiting)

    def encode(self, text: str | None, slice_chars: int = SLICE_CHARS) -> np.ndarray:
        return next(self.encode_all([text], slice_chars))

    def decode(self, ids: np.ndarray, part_ids: int = PART_IDS) -> str:
        """The text that the library's decoder gives for the ids."""
        if len(ids) <= part_ids:
            return self.model.decode(ids.tolist())
        # A part may start at a marked piece behind an unmarked one; the decoder drops the marker in front.
        fresh = self.starts_word[ids]
        fresh[1:] &= ~fresh[:-1]
        cuts, at = [0], np.flatnonzero(fresh)
        while len(ids) - cuts[-1] > part_ids:
            k = np.searchsorted(at, cuts[-1] + part_ids)
            if k == len(at):
                break
            cuts.append(int(at[k]))
        cuts.append(len(ids))
        texts = [self.model.decode(ids[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:])]
        return " ".join(texts)


def slices(text: str, size: int) -> Iterator[str]:
    """Parts of at least ``size`` characters that begin where a run of spaces begins."""
    start = 0
    while len(text) - start > size:
        cut = text.find(" ", start + size)
        while cut >= 0 and text[cut - 1] == " ":
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def codec(name: str) -> PieceCodec:
    if name not in _CODECS:
        _CODECS[name] = PieceCodec(vocabulary_path(name))
    return _CODECS[name]


def _rows(batch: pa.RecordBatch, values: Iterable, weight, limit: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The batch with ``values`` as its last column, in parts of bounded weight."""
    start, held, out = 0, 0, []
    for row, value in enumerate(values):
        out.append(value)
        held += weight(value)
        if held >= limit or row + 1 == batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(out)), pa.array(out, kind)], names=batch.schema.names)
            start, held, out = row + 1, 0, []


def encode(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", end: bool = True, keep: list[Column] | None = None,
           text_col: str = "text") -> DataFrame:
    """The ``keep`` columns (default: all) with ``ids``, the token ids of every
    whole text as the library gives them, with the end id unless ``end`` is false."""
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(tokenizer)
        tail = np.array([model.end] * end, np.int32)
        for batch in batches:
            texts = (v.as_py() for v in batch.column(1))
            yield from _rows(batch, (np.concatenate([x, tail]) for x in model.encode_all(texts)), len, BATCH_IDS, pa.list_(pa.int32()))

    row = F.struct(*(keep or columns(docs, ("ids",)))).alias("row")
    source = docs.select(row, F.col(text_col).alias("ids"))
    return source.mapInArrow(make, source.select("row", F.lit(None).cast("array<int>").alias("ids")).schema).select("row.*", "ids")


def decode(tokens: DataFrame, tokenizer: str = "piece_bpe_32k.model", ids_col: str = "ids") -> DataFrame:
    """All columns with ``decoded``, the text of the id list."""
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(tokenizer)

        def text(value: pa.Scalar) -> str | None:
            return model.decode(value.values.to_numpy(zero_copy_only=False)) if value.is_valid else None

        for batch in batches:
            yield from _rows(batch, map(text, batch.column(1)), lambda t: len(t or ""), 4 * BATCH_IDS, pa.string())

    row = F.struct(*columns(tokens, ("decoded",))).alias("row")
    source = tokens.select(row, F.col(ids_col).cast("array<int>").alias("decoded"))
    return source.mapInArrow(make, source.select("row", F.lit(None).cast("string").alias("decoded")).schema).select("row.*", "decoded")
