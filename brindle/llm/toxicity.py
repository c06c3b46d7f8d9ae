"""Toxicity by subword-bag embeddings averaged into a linear softmax.

Every word gives itself and its character n-grams of 3 to 5 bytes, word borders included, as hashed rows of one
embedding table; a text is the average of its rows, and a linear softmax over that average gives the classes. Table
and softmax are trained jointly, in numpy, on a bounded labelled sample, in one task of an executor; the driver gets the
trained model only. A misspelling never seen in training still shares most of its n-grams, and so its vectors, with the
word it comes from.

As averaging and softmax are linear up to the last step, the trained model is applied as one number per table row:
scoring a text is a gather and a mean.

Defined cases: null, empty and blank texts score the bias alone; without labels, or with one class only, every score
is that class's share with one of each class added; repeated rows are scored alike, and so are texts with equal counts of
words and n-grams; a long text is read whole, a slab at a time; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.words import _SPACE, SLAB, mix, pieces, raw_texts, spans, word_hashes

BITS = 18
#: Shares of rows are small numbers; they are scaled so that a text's average has the size of single rows.
SCALE = 30.0
GRAMS = (3, 4, 5)
DIM = 8
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def rows_of(text: bytes) -> Iterator[np.ndarray]:
    """Table rows of a text's words and n-grams, repeats included, a slab at a time."""
    shift = np.uint64(64 - BITS)
    for piece in pieces(text):
        raw = np.full(len(piece) + 2, 32, np.uint8)
        raw[1:-1] = _LOWER[np.frombuffer(piece, np.uint8)]
        first, after = spans(raw)
        if not len(first):
            continue
        found = [word_hashes(raw, first, after) >> shift]
        gap = _SPACE[raw]
        flat = np.where(gap, 32, raw).astype(np.uint64)
        for n in GRAMS:
            m = len(raw) - n + 1
            if m < 1:
                continue
            inner = np.zeros(m, bool)
            packed = np.zeros(m, np.uint64)
            for k in range(n):
                packed = (packed << np.uint64(8)) | flat[k : k + m]
                if 0 < k < n - 1:
                    inner |= gap[k : k + m]
            packed = packed[~inner]
            found.append((packed * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93) >> shift)
        yield np.concatenate(found).astype(np.int32)


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a text, and their shares in half precision: what a sampled document holds on the driver."""
    total = np.zeros(1 << BITS, np.int64) if len(text) > 4 * SLAB else None
    parts = []
    for rows in rows_of(text):
        if total is None:
            parts.append(rows)
        else:
            total += np.bincount(rows, minlength=len(total))
    if total is None:
        rows, counts = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int32), return_counts=True)
    else:
        rows = np.flatnonzero(total)
        counts = total[rows]
    return rows.astype(np.int32), (counts * SCALE / max(1, counts.sum())).astype(np.float16)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, rate: float = 0.5, batch: int = 32, seed: int = 7) -> tuple[np.ndarray, float]:
    """Logit contribution of every table row, and the bias, after joint training of table and softmax by Adagrad."""
    random = np.random.default_rng(seed)
    table = (random.standard_normal((1 << BITS, DIM)) / DIM).astype(np.float32)
    heads = (random.standard_normal((DIM, 2)) / DIM).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_t, seen_h, seen_b = np.full(1 << BITS, 1e-8, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    for epoch in range(epochs):
        order = random.permutation(len(bags))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            size = [len(bags[i][0]) for i in own]
            rows = np.concatenate([bags[i][0] for i in own])
            share = np.concatenate([bags[i][1] for i in own]).astype(np.float32)
            doc = np.repeat(np.arange(len(own)), size)
            taken = table[rows]
            mean = np.stack([np.bincount(doc, share * taken[:, k], len(own)) for k in range(DIM)], axis=1).astype(np.float32)
            logits = mean @ heads + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), labels[own]] -= 1
            slope = (p / len(own)).astype(np.float32)
            back = slope @ heads.T
            g_heads, g_bias = mean.T @ slope, slope.sum(axis=0)
            distinct, place = np.unique(rows, return_inverse=True)
            g_rows = np.stack([np.bincount(place, share * back[doc, k], len(distinct)) for k in range(DIM)], axis=1).astype(np.float32)
            seen_t[distinct] += (g_rows**2).mean(axis=1)
            table[distinct] -= rate * g_rows / np.sqrt(seen_t[distinct])[:, None]
            seen_h += g_heads**2
            heads -= rate * 0.1 * g_heads / np.sqrt(seen_h)
            seen_b += g_bias**2
            bias -= rate * 0.1 * g_bias / np.sqrt(seen_b)
    return (table @ (heads[:, 1] - heads[:, 0]) * np.float32(SCALE)).astype(np.float32), float(bias[1] - bias[0])


def fit(sample: DataFrame, shares: tuple[float, float]) -> tuple[np.ndarray, float]:
    """Model of a sample of (id, text, label) from labels whose classes 0 and 1 have the given shares.

    The sample, of bounded bytes, is made into bags by all executors and then trained on by one task, in the order of
    its ids and texts, so that a task that is run again gives the same model. Classes may be as large as each other;
    the bias is moved to the shares of all labels.
    """
    base = float(np.log(shares[1] / shares[0]))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [bag(t or b"") for t in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r, _ in got], pa.binary()), pa.array([s.tobytes() for _, s in got], pa.binary())], names=["id", "label", "rows", "shares"])

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, labels = [], []
        for batch in batches:
            labels += batch.column(1).to_pylist()
            held += [(np.frombuffer(r, np.int32), np.frombuffer(s, np.float16)) for r, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        if 0 < sum(labels) < len(labels):
            table, bias = train(held, np.array(labels, np.int64))
            mean = sum(labels) / len(labels)
            yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary()), pa.array([bias + base - float(np.log(mean / (1 - mean)))])], names=["model", "bias"])

    made = sample.mapInArrow(bags, "id long, label int, rows binary, shares binary")
    got = made.repartition(1).sortWithinPartitions("id", "rows", "shares").mapInArrow(trained, "model binary, bias double").collect()
    if not got:
        return np.zeros(1 << BITS, np.float32), base
    return np.frombuffer(bytes(got[0]["model"]), np.float32), got[0]["bias"]


def score(text: bytes, table: np.ndarray, bias: float) -> float:
    total, n = 0.0, 0
    for rows in rows_of(text):
        total += float(table[rows].sum(dtype=np.float64))
        n += len(rows)
    return float(1 / (1 + np.exp(-np.clip(bias + total / max(1, n), -30, 30))))


def scores(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row; the model, of fixed size, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = shared.value
        for batch in batches:
            got = [score(t or b"", table, bias) for t in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=["id", "score"])

    kept = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return kept.mapInArrow(run, "id long, score double")


def clean(docs: DataFrame, model: tuple[np.ndarray, float], most: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, whose score is below ``most``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = shared.value
        for batch in batches:
            yield batch.filter(pa.array([score(t or b"", table, bias) < most for t in raw_texts(batch.column(place))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
