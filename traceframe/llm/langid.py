"""Language ID: a byte convolutional network trained in numpy.

Filters of several widths over byte embeddings, max pooling and softmax.
Training uses a bounded sample of labelled rows (``SAMPLE_PER_LABEL`` texts of
each label, chosen by a hash of the id; this is the documented bound).
Prediction tiles every whole text with fixed-length windows, scores the
windows in batches and averages the softmax by letters per window. For speed
the first-layer products are tabulated for all byte pairs, which is the same
network.

Defined cases: a null text or one without a letter is ``und`` with score 0;
without any labelled row everything is ``und``; equal scores go to the first
label in order; null ids and repeated rows are kept; an empty table gives no
rows; columns other than id, text and label are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, near_slots

UNKNOWN = "und"
SAMPLE_PER_LABEL = 400
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8
CHUNK_WINDOWS = 512

#: Lower-case letters stay, other ASCII becomes a space, other bytes stay.
BYTES = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)
LETTER = re.compile(r"[^\W\d_]")


def cut_windows(data: bytes, window: int) -> np.ndarray:
    """[n, window] byte classes; the last row is filled with spaces."""
    codes = BYTES[np.frombuffer(data, np.uint8)]
    n = max(1, -(-len(codes) // window))
    out = np.full(n * window, 32, np.uint8)
    out[:len(codes)] = codes
    return out.reshape(n, window)


class ByteNet:
    """Embeddings [256, E], filters [width, E, F] with a bias, output layer [widths*F, labels]."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.embed[32] = 0
        self.filters = [rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.out_bias]

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 500, batch: int = 64, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on random crops, so that short texts are learned as well."""
        rng = np.random.default_rng(seed)
        by_label = [np.flatnonzero(y == k) for k in range(len(self.labels))]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.params()]
        for step in range(1, steps + 1):
            label = rng.integers(0, len(self.labels), batch)
            rows = np.array([by_label[k][rng.integers(len(by_label[k]))] for k in label])
            length = int(rng.choice([12, 24, 48, 96, 256]))
            start = rng.integers(0, x.shape[1] - length + 1) if length < x.shape[1] else 0
            grads = self._gradients(x[rows, start:start + length], label)
            for p, g, (m, v) in zip(self.params(), grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)

    def _gradients(self, x: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        b = len(x)
        e = self.embed[x]
        pooled, at = [], []
        for w, filt, bias in zip(WIDTHS, self.filters, self.bias):
            n = x.shape[1] - w + 1
            z = sum(e[:, k:k + n] @ filt[k] for k in range(w))
            i = z.argmax(1)
            at.append(i)
            pooled.append(np.take_along_axis(z, i[:, None], 1)[:, 0] + bias)
        z = np.concatenate(pooled, 1)
        h = np.maximum(z, 0)
        logits = h @ self.out + self.out_bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(b), label] -= 1
        p /= b
        d_out, d_out_bias = h.T @ p, p.sum(0)
        dh = (p @ self.out.T) * (z > 0)
        d_embed = np.zeros_like(self.embed)
        d_filters, d_bias = [], []
        for j, (w, filt) in enumerate(zip(WIDTHS, self.filters)):
            g = dh[:, j * FILTERS:(j + 1) * FILTERS]
            pos = at[j][:, :, None] + np.arange(w)
            seen = x[np.arange(b)[:, None, None], pos]
            vec = self.embed[seen]
            d_filters.append(np.einsum("bf,bfke->kef", g, vec))
            d_bias.append(g.sum(0))
            np.add.at(d_embed, seen, np.einsum("bf,kef->bfke", g, filt))
        return [d_embed, *d_filters, *d_bias, d_out, d_out_bias]

    def tables(self) -> list[list[tuple[int, bool, np.ndarray]]]:
        """For each width, (offset, over pairs, table [256 or 65536, F]) to be summed."""
        out = []
        for w, filt in zip(WIDTHS, self.filters):
            single = [self.embed @ filt[k] for k in range(w)]
            parts = []
            for k in range(0, w - 1, 2):
                pair = single[k][None, :, :] + single[k + 1][:, None, :]
                parts.append((k, True, np.ascontiguousarray(pair.reshape(65536, FILTERS))))
            if w % 2:
                parts.append((w - 1, False, np.ascontiguousarray(single[-1])))
            out.append(parts)
        return out

    def probabilities(self, x: np.ndarray, tables=None) -> np.ndarray:
        """[n, window] byte classes to [n, labels]."""
        tables = tables or self.tables()
        pairs = x[:, :-1].astype(np.uint16) | (x[:, 1:].astype(np.uint16) << 8)
        pooled = []
        for w, bias, parts in zip(WIDTHS, self.bias, tables):
            n = x.shape[1] - w + 1
            z = None
            for k, over_pairs, tab in parts:
                v = tab.take((pairs if over_pairs else x)[:, k:k + n], axis=0)
                z = v if z is None else np.add(z, v, out=z)
            while z.shape[1] > 1:
                half = z.shape[1] // 2
                z, odd = np.maximum(z[:, :half], z[:, half:2 * half]), z[:, 2 * half:]
                if odd.shape[1]:
                    z[:, :1] = np.maximum(z[:, :1], odd)
            pooled.append(z[:, 0] + bias)
        logits = np.maximum(np.concatenate(pooled, 1), 0) @ self.out + self.out_bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def predict_texts(net: ByteNet | None, texts: list[str | None], tables=None) -> tuple[list[str], list[float]]:
    if net is None or not net.labels:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    tables = tables or net.tables()
    sums = np.zeros((len(texts), len(net.labels)))
    held: list[tuple[int, np.ndarray]] = []
    n_held = 0

    def flush() -> None:
        if not held:
            return
        x = np.concatenate([v for _, v in held])
        owner = np.repeat([i for i, _ in held], [len(v) for _, v in held])
        p = net.probabilities(x, tables) * (x != 32).sum(1)[:, None]
        np.add.at(sums, owner, p)
        held.clear()

    known = [bool(t) and LETTER.search(t) is not None for t in texts]
    for i, t in enumerate(texts):
        if not known[i]:
            continue
        x = cut_windows(t.encode("utf-8", "replace"), WINDOW)
        for j in range(0, len(x), CHUNK_WINDOWS):
            part = x[j:j + CHUNK_WINDOWS]
            held.append((i, part))
            n_held += len(part)
            if n_held >= CHUNK_WINDOWS:
                flush()
                n_held = 0
    flush()
    total = sums.sum(1)
    best = sums.argmax(1)
    labels = [net.labels[b] if k else UNKNOWN for k, b in zip(known, best)]
    scores = [float(sums[i, b] / total[i]) if known[i] and total[i] > 0 else 0.0 for i, b in enumerate(best)]
    return labels, scores


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
          per_label: int = SAMPLE_PER_LABEL) -> ByteNet | None:
    """Fits a network on ``per_label`` texts of each non-null label, those of
    the least id hashes. Ids are ranked without their texts, after a cut by
    count that leaves about twice as many; only windows of the chosen travel."""
    keyed = rows.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    ids = keyed.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    place = F.xxhash64("id") / F.lit(2.0 ** 64) + 0.5
    share = ids.groupBy("label").agg((F.lit(2.0 * per_label) / F.count("*")).alias("share"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("place", "id"))
    chosen = (ids.withColumn("place", place).join(share, "label").where("place < share")
              .withColumn("_r", rank).where(F.col("_r") <= per_label).select("id").distinct())
    texts = keyed.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    n = F.length("text")
    # Three places of a text: its start, middle and end.
    # Most texts are left out by a filter of bounded size, not shuffled to the exact join.
    few = near_slots(texts, chosen.select(F.col("id").alias("_id")), "id")
    sample = (few.join(chosen, "id").select(
        "label", F.explode(F.array(F.substring("text", 1, WINDOW),
                                   F.substring(F.col("text"), F.greatest(F.lit(1), n.bitwiseAND(-2) / 2).cast("int"), F.lit(WINDOW)),
                                   F.substring(F.col("text"), F.greatest(F.lit(1), n - WINDOW), F.lit(WINDOW)))).alias("part"))
              .distinct().withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("part"), "part")))
              .where(F.col("_r") <= 3 * per_label).select("label", "part").collect())
    parts_of: dict[str, list[str]] = {}
    for r in sorted(sample):
        parts_of.setdefault(r.label, []).append(r.part)
    labelled = [(label, [p for p in parts if LETTER.search(p)]) for label, parts in parts_of.items()]
    labelled = [(label, parts) for label, parts in labelled if parts]
    if not labelled:
        return None
    x = np.concatenate([cut_windows(p.encode("utf-8", "replace"), WINDOW)[:1] for _, parts in labelled for p in parts])
    y = np.repeat(np.arange(len(labelled)), [len(parts) for _, parts in labelled])
    net = ByteNet([label for label, _ in labelled])
    net.fit(x, y)
    return net


def predict(docs: DataFrame, net: ByteNet | None, keep: list[Column] | None = None,
            text_col: str = "text") -> DataFrame:
    """The ``keep`` columns (default: all) with lang_pred and score."""
    kept = docs.select(F.struct(*(keep or columns(docs, ("lang_pred", "score")))).alias("row"), F.col(text_col).alias("text"))

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for batch in batches:
            labels, scores = predict_texts(net, batch.column(1).to_pylist(), tables)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                                             names=["row", "lang_pred", "score"])

    row_type = kept.schema["row"].dataType.simpleString()
    return kept.mapInArrow(label, f"row {row_type}, lang_pred string, score double").select("row.*", "lang_pred", "score")


def held_out(id_col: str = "doc_id") -> Column:
    """One fold of five by the checksum of the id; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0
