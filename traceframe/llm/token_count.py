"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut into segments at safe boundaries (a single ASCII space between
two other characters, where no vocabulary piece reaches across) and encoded in
batches of about equal bytes, so that a long text neither makes a huge batch
nor a huge id list.

Defined cases: a null text has 0 bytes and 0 tokens; null document ids and
repeated rows are kept, one result row for each input row; an empty table
gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import vocabulary_path

BATCH_BYTES = 1 << 20
SEGMENT_CHARS = 1 << 15

_COUNTERS: dict = {}


class PieceCounter:
    """sentencepiece models. Segments lose the space at the cut: the dummy prefix
    of the next segment stands for it."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        one, two = self.model.encode(["a b", "b"], num_threads=1, out_type=str)
        self.can_cut = all("▁" not in p.lstrip("▁") for p in pieces) and one[-1:] == two == ["▁b"]
        self.can_cut &= self.model.encode("a  b") != self.model.encode("a b")

    def counts(self, texts: list[str]) -> list[int]:
        return list(map(len, self.model.encode(texts, num_threads=1)))


class JsonCounter:
    """tokenizers files; texts are not cut, since what their pieces span differs between files."""

    can_cut = False

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def counter(name: str):
    if name not in _COUNTERS:
        _COUNTERS[name] = (PieceCounter if name.endswith(".model") else JsonCounter)(vocabulary_path(name))
    return _COUNTERS[name]


def segments(text: str, size: int) -> Iterator[str]:
    """Cuts after about ``size`` characters at a space whose neighbours are no white space or special mark."""
    start = 0
    while len(text) - start > size:
        cut = start + size
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or cut + 1 >= len(text):
                cut = -1
                break
            if text[cut - 1].isalnum() and text[cut + 1].isalnum():
                break
            cut += 1
        if cut < 0:
            break
        yield text[start:cut]
        start = cut + 1
    yield text[start:]


def token_counts(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", limit: int = 4096,
                 id_col: str = "doc_id", text_col: str = "text", segment_chars: int = SEGMENT_CHARS,
                 batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(tokenizer)
        for batch in batches:
            n_bytes, n_tokens = [], [0] * batch.num_rows
            queue: list[str] = []
            owner: list[int] = []
            held = 0

            def flush() -> None:
                for row, n in zip(owner, model.counts(queue) if queue else []):
                    n_tokens[row] += n
                queue.clear()
                owner.clear()

            for row, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                size = len(text) if text.isascii() else len(text.encode("utf-8"))
                n_bytes.append(size)
                if not text:
                    continue
                for part in segments(text, segment_chars) if model.can_cut else (text,):
                    queue.append(part)
                    owner.append(row)
                    held += len(part) * size // len(text)
                    if held >= batch_bytes:
                        flush()
                        held = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    counted = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
               .mapInArrow(count, "doc_id long, n_bytes long, n_tokens long"))
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
