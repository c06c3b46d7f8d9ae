"""Quality by compression: how much smaller a text gets with a dictionary of good text than with one of bad text.

Two zstandard dictionaries are built from good and from bad labelled documents. A text is compressed in blocks of
``BLOCK`` bytes, each once with either dictionary, so that a long text can't teach the compressor more than the
dictionary did; the difference of the sizes over the text's own size becomes a score by a logistic curve fitted on
labelled documents that neither dictionary has seen.

Defined cases: null and empty texts have the difference zero; without labels, or with one class only, every score is
that class's share with one of each class added; repeated rows are scored alike; long texts are compressed whole, block
by block, and teach dictionaries with all their blocks; a class with too few blocks for the library's builder has its
blocks themselves as dictionary; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.words import raw_texts

BLOCK = 1024
LEVEL = 3
DICTIONARY_BYTES = 112 << 10


class Model(NamedTuple):
    good: bytes
    bad: bytes
    curve: tuple[float, ...]


def blocks_of(text: bytes) -> list[bytes]:
    return [text[at : at + BLOCK] for at in range(0, len(text), BLOCK)]


def dictionary(blocks: list[bytes]) -> bytes:
    """A dictionary of ``blocks``, by the library's builder; if it refuses them as too few, they are the dictionary."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    made = zstandard.ZstdCompressionDict(content)
    made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)


def difference(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """Size with the bad dictionary less size with the good one, over the text's size."""
    if not text:
        return 0.0
    gain = 0
    for block in blocks_of(text):
        gain += len(bad.compress(block)) - len(good.compress(block))
    return gain / len(text)


def _terms(x: np.ndarray) -> np.ndarray:
    """What the curve weighs: the difference in both directions, bounded, and one."""
    x = np.clip(x * 10, -4, 4)
    return np.stack([np.maximum(x, 0), np.minimum(x, 0), np.ones_like(x)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Newton's method with a small ridge."""
    a, w = _terms(x), np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + 1e-3 * np.eye(3)
        step = np.linalg.solve(h, a.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(sample: DataFrame, shares: tuple[float, float]) -> Model:
    """Model of a bounded sample of (id, text, label): half of it builds dictionaries, the rest fits the curve."""
    half = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)) == 0

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [blocks_of(t or b"") for t in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got, pa.list_(pa.binary()))], names=["id", "label", "blocks"])

    build = sample.where(half).select(F.col("id").cast("long"), "text", "label").mapInArrow(blocks, "id long, label int, blocks array<binary>").toArrow().sort_by("id")
    rows = list(zip(build["label"].to_pylist(), build["blocks"].to_pylist()))
    good, bad = (dictionary([b for y, own in rows for b in own if y == k]) for k in (1, 0))
    rest = differences(sample.where(~half), good, bad, "id", "text", "label").toArrow().sort_by([("id", "ascending"), ("x", "ascending")])
    x, y = rest["x"].to_numpy(), rest["label"].to_numpy().astype(float)
    base = float(np.log(shares[1] / shares[0]))
    if not 0 < y.sum() < len(y):
        return Model(good, bad, (0.0, 0.0, base))
    w = _logistic(x, y)
    return Model(good, bad, (*w[:2].tolist(), float(w[2] + base - np.log(y.mean() / (1 - y.mean())))))


def differences(docs: DataFrame, good: bytes, bad: bytes, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(id, x, more...): the normalised difference of every text. The dictionaries, of bounded size, are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast((good, bad))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = [_compressor(c) for c in shared.value]
        for batch in batches:
            got = [difference(t or b"", *pair) for t in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64()), *batch.columns[2:]], names=["id", "x", *more])

    kept = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(c).cast("int").alias(c) for c in more])
    return kept.mapInArrow(run, ", ".join(["id long, x double", *[f"{c} int" for c in more]]))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row."""
    up, down, base = model.curve
    x = F.greatest(F.least(F.col("x") * 10, F.lit(4.0)), F.lit(-4.0))
    logit = F.greatest(x, F.lit(0.0)) * up + F.least(x, F.lit(0.0)) * down + base
    found = differences(docs, model.good, model.bad, id_col, text_col)
    return found.select("id", (1 / (1 + F.exp(-logit))).alias("score"))
