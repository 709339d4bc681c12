"""Packing: token pieces placed into fixed windows by best-fit decreasing.

``encode_pieces`` turns each text into ids, appends the end id and cuts
overlong documents into full windows plus a rest. ``assign_windows`` deals the
pieces into blocks of bounded size (at random, so every block has the length
mix of the whole) and packs each block best-fit decreasing: a segment tree
indexed by remaining capacity finds the tightest open window. A block never
holds more than a few thousand small rows, whatever the input; only the last
windows of a block stay partly filled.

Defined cases: a null text is empty and yields one piece with the end id; an
empty table yields no rows; repeated rows are packed one by one; a null
document id is kept; equal lengths are packed by document id and start; input
columns other than id and text are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import vocabulary_path, written

WINDOW = 4096
BLOCK_PIECES = 2048
SLICE_CHARS = 1 << 18
#: Texts are encoded together in runs of about so many characters, and ids laid out for so many pieces at once.
RUN_CHARS = 1 << 25
RUN_PIECES = 64

_ENCODERS: dict = {}


def _without_normalizer(tokenizer):
    """For ASCII words in lower case with a space between them: the tokenizer
    without its normalizer, if that leaves such texts as they are."""
    spec = json.loads(tokenizer.to_str())
    normalizer = spec["normalizer"] or {"type": "Sequence", "normalizers": []}
    steps = normalizer["normalizers"] if normalizer["type"] == "Sequence" else [normalizer]
    spaces = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    if not all(s == spaces or s == {"type": s["type"]} and s["type"] in ("NFC", "Lowercase") for s in steps):
        return tokenizer
    return type(tokenizer).from_str(json.dumps(spec | {"normalizer": None}))


class WordEncoder:
    """Ids of whole texts as little-endian bytes; a run of texts gives each of
    its distinct words to the library once. Nothing is kept from run to run, so
    that a text costs the same whatever came before.

    Valid for vocabularies whose pre-tokenizer drops white space, so that a
    text's ids are those of its space-separated words in order.
    """

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.bare = _without_normalizer(self.tokenizer)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        one = self.tokenizer.encode("Ab ab. ab, ab", add_special_tokens=False).ids
        self.marks = self._encode_odd([".", ","]) if self.ends_word.any() else {}
        parts = [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes() for w in ("ab", ".", ",")]
        ab, stop, comma = parts
        self.lower = self.ends_word.any() and np.array(one, dtype="<u4").tobytes() == ab + ab + stop + ab + comma + ab

    def _encode_odd(self, words: list[str]) -> dict[str, bytes]:
        """Any words, by the word numbers that the tokenizer returns."""
        out = {}
        for i in range(0, len(words), 2000):
            part = words[i:i + 2000]
            e = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(e.ids, dtype="<u4").tobytes()
            ends = np.searchsorted(np.array(e.word_ids, dtype=np.int64), np.arange(len(part)), "right") * 4
            start = 0
            for w, end in zip(part, ends.tolist()):
                out[w] = ids[start:end]
                start = end
        return out

    def _encode_plain(self, words: list[str], tokenizer) -> dict[str, bytes]:
        """Words of letters only: one text, cut after each id that ends a word."""
        out = {}
        parts = [words[i:i + 256] for i in range(0, len(words), 256)]
        for part, e in zip(parts, tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            ends = (np.flatnonzero(self.ends_word[ids]) + 1) * 4
            if len(ends) != len(part):
                out |= self._encode_odd(part)
                continue
            raw, start = ids.tobytes(), 0
            for w, end in zip(part, ends.tolist()):
                out[w] = raw[start:end]
                start = end
        return out

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Letters with at most one comma or full stop behind them are looked up and encoded without it, in lower case."""
        plain, cores, odd = [], [], []
        for w in words:
            core = w[:-1] if w[-1:] in ".," else w
            if self.lower and core.isalpha() and (core.isascii() or ("Σ" not in core and "İ" not in core)):
                plain.append(w)
                cores.append(core.lower())
            else:
                odd.append(w)
        distinct = dict.fromkeys(cores)
        new = self._encode_plain([c for c in distinct if c.isascii()], self.bare)
        new |= self._encode_plain([c for c in distinct if not c.isascii()], self.tokenizer)
        out = self._encode_odd(odd) if odd else {}
        for w, core in zip(plain, cores):
            out[w] = new[core] + self.marks[w[-1]] if w[-1] in self.marks else new[core]
        return out

    def _slices(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > SLICE_CHARS:
            cut = text.find(" ", start + SLICE_CHARS)
            if cut < 0:
                break
            yield text[start:cut]
            start = cut + 1
        yield text[start:]

    def _encode_run(self, pieces: list[str]) -> list[bytes]:
        """Every distinct word of the run is encoded once; its ids are then copied to its places."""
        lists = pc.split_pattern(pc.replace_substring(pa.array(pieces, pa.large_string()), "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        ids_of = {"": b""} | self._encode_words([w for w in distinct if w])
        known = [ids_of[w] for w in distinct]
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        at = np.concatenate([[0], np.cumsum(size)])
        ids = np.frombuffer(b"".join(known), "<u4")
        code, ends = words.indices.to_numpy(), lists.offsets.to_numpy()
        out = []
        for i in range(0, len(pieces), RUN_PIECES):
            end = ends[i:i + RUN_PIECES + 1]
            part = code[end[0]:end[-1]]
            n = size[part]
            off = np.concatenate([[0], np.cumsum(n)])
            laid = ids[np.repeat(at[part] - off[:-1], n) + np.arange(off[-1])]
            cuts = off[end - end[0]].tolist()
            out += [laid[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        pieces: list[str] = []
        owners: list[int] = []
        held = 0
        for i, text in enumerate(texts):
            for piece in self._slices(text):
                pieces.append(piece)
                owners.append(i)
                held += len(piece)
                if held >= RUN_CHARS:
                    for owner, ids in zip(owners, self._encode_run(pieces)):
                        out[owner].append(ids)
                    pieces, owners, held = [], [], 0
        if pieces:
            for owner, ids in zip(owners, self._encode_run(pieces)):
                out[owner].append(ids)
        return [b"".join(parts) for parts in out]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def _encoder(name: str) -> WordEncoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = WordEncoder(vocabulary_path(name))
    return _ENCODERS[name]


def encode_pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2,
                  window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): ids are little-endian unsigned 32-bit."""
    end = int(end_id).to_bytes(4, "little")
    schema = "doc_id long, start long, length long, doc_tokens long, ids binary"

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        rows: list[list] = [[], [], [], [], []]
        held = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(rows[i], pa.int64()) for i in range(4)] + [pa.array(rows[4], pa.binary())],
                names=["doc_id", "start", "length", "doc_tokens", "ids"])
            for r in rows:
                r.clear()
            return out

        def packed(owners: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
            nonlocal held
            for doc, ids in zip(owners, encoder.encode_all(texts)):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[start * 4:(start + window) * 4]
                    for r, v in zip(rows, (doc, start, len(part) // 4, n, part)):
                        r.append(v)
                    held += len(part)
                if held > 8 << 20:
                    yield flush()
                    held = 0

        owners, texts, chars = [], [], 0
        for batch in batches:
            owners += batch.column(0).to_pylist()
            more = [text or "" for text in batch.column(1).to_pylist()]
            texts += more
            chars += sum(map(len, more))
            if chars >= RUN_CHARS:
                yield from packed(owners, texts)
                owners, texts, chars = [], [], 0
        yield from packed(owners, texts)
        yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, schema)


class CapacityTree:
    """Segment tree over capacities 0..size-1; a leaf counts the open windows with that capacity left."""

    def __init__(self, size: int):
        self.leaves = 1 << (size - 1).bit_length()
        self.tree = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.leaves
        while i:
            self.tree[i] += n
            i >>= 1

    def tightest(self, need: int) -> int:
        """The smallest capacity of at least ``need`` with an open window, or -1."""
        i, tree = need + self.leaves, self.tree
        if tree[i]:
            return need
        while i > 1:
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each length; lengths must be in descending order."""
    tree = CapacityTree(window + 1)
    open_at: dict[int, list[int]] = {}
    seq, off, windows = [], [], 0
    for n in lengths:
        cap = tree.tightest(n)
        if cap < 0:
            s, cap = windows, window
            windows += 1
        else:
            s = open_at[cap].pop()
            tree.add(cap, -1)
        seq.append(s)
        off.append(window - cap)
        if cap > n:
            open_at.setdefault(cap - n, []).append(s)
            tree.add(cap - n, 1)
    return seq, off


def assign_windows(pieces: DataFrame, window: int = WINDOW, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Adds sequence_id, offset and padded_length. ``pieces`` must be stored
    (it is read twice) and have doc_id, start and length of at most ``window``."""
    blocks = max(1, -(-pieces.count() // block_pieces))
    dealt = pieces.withColumn("_block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    names = pieces.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema]
                       + ["sequence_id long", "`offset` long", "padded_length long"])

    def place(key: tuple, block: pa.Table) -> pa.Table:
        block = block.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        lengths = block.column("length").to_pylist()
        seq, off = best_fit_decreasing(lengths, window)
        fill: dict[int, int] = {}
        for s, n in zip(seq, lengths):
            fill[s] = fill.get(s, 0) + n
        padded = [n if n & (n - 1) == 0 else window for n in (fill[s] for s in seq)]
        base = key[0].as_py() << 24
        block = block.select(names)
        for name, values in (("sequence_id", [base + s for s in seq]), ("offset", off), ("padded_length", padded)):
            block = block.append_column(name, pa.array(values, pa.int64()))
        return block

    return dealt.groupBy("_block").applyInArrow(place, schema)


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, window: int = WINDOW,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All texts packed: one row per piece with its ids, sequence and offset.
    Laying the pieces of a sequence out by offset and padding to
    ``padded_length`` gives the training window."""
    return assign_windows(written(encode_pieces(docs, tokenizer, end_id, window, id_col, text_col)), window)
