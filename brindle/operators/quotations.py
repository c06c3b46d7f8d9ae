"""Quotes in documents: candidates by hashed runs and by automata, each pair then decided on its texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import quotes, uniform
from brindle.sources.shared import spread

#: Quotes of fewer tokens are sought letter by letter: edges of a word or number can change all their runs.
SHORT = 8
#: Bytes of quotes, and quotes, that one automaton is made of.
BLOCK_BYTES, BLOCK_QUOTES = 8 << 20, 100_000


#: Bytes of texts that a task takes apart at once: tokens as Python's strings are many times as large.
SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most SLICE_BYTES of a column's texts, or of one text."""
    start = size = 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if k > start and size + n > SLICE_BYTES:
            yield batch.slice(start, k - start)
            start, size = k, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, g): number of tokens, and the hashes of the distinct six-token runs."""
    for batch in (part for whole in batches for part in slices(whole, 1)):
        split = [uniform.tokens(t, True) for t in uniform.folded(pd.Series(batch.column(1).to_pylist(), dtype=object))]
        hashed = []
        for words in split:
            one = pd.util.hash_array(np.array(words, dtype=object)).astype(np.uint64) if words else np.zeros(0, np.uint64)
            whole = np.zeros(max(len(one) - quotes.RUN + 1, 0), np.uint64)
            for k in range(quotes.RUN):  # wraps round 2**64
                whole = whole * np.uint64(0x9E3779B97F4A7C15) + one[k : k + len(whole)]
            hashed.append(np.unique(whole).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in split], pa.int64()), pa.array(hashed, pa.list_(pa.int64()))], names=["id", "n", "g"])


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, 2)):
        source, rows = quotes.Source(None), []
        for text, quote in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            source = source if text == source.text else quotes.Source(text)
            rows.append(source.find(quote))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m for m, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.float64())], names=["doc_id", "item_id", "match", "coverage"])


def _blocks(short: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Short quotes, streamed in blocks of bounded bytes."""
    block, size = [], 0
    for row in short.toLocalIterator():
        quote = quotes.bare(row["quote"])
        if quote:
            block.append((row["item_id"], quote))
            size += len(quote.encode())
        if size >= BLOCK_BYTES or len(block) >= BLOCK_QUOTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _spotted(docs: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
    """(doc_id, item_id) of documents that hold a short quote's letters, its tokens, or a run of them; documents stream once."""
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def automaton(patterns: dict[str, set[int]]):
        import ahocorasick

        found = ahocorasick.Automaton()
        for pattern, items in patterns.items():
            found.add_word(pattern, tuple(items))
        found.make_automaton()
        return found

    def spot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters: dict[str, set[int]] = {}
        tokens: dict[str, set[int]] = {}
        for item, quote in sent.value:
            letters.setdefault(quote, set()).add(item)
            words = uniform.tokens(quote)
            for run in [words, *quotes.run_keys(words)] if words else ():
                tokens.setdefault(f" {' '.join(run)} ", set()).add(item)
        by_letters, by_tokens = automaton(letters), automaton(tokens) if tokens else None
        for batch in (part for whole in batches for part in slices(whole, 1)):
            ids, items = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = {i for _, found in by_letters.iter(text or "") for i in found}
                if by_tokens:
                    held.update(i for _, found in by_tokens.iter(f" {' '.join(uniform.tokens(text))} ") for i in found)
                ids += [doc] * len(held)
                items += sorted(held)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.int64())], names=["doc_id", "item_id"])

    return docs.mapInArrow(spot, "doc_id long, item_id long")


def located(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, match, coverage) of the quotes of items (item_id, quote) that documents (doc_id, text) hold.

    Long quotes meet documents by the hash of any six-token run. Short ones make automata, a block of them at a time, and
    documents stream through each. What is met is decided on the texts. Null and empty quotes are nowhere.
    """
    docs = spread(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id")
    items = items.select(F.col("item_id").cast("long"), "quote")
    shape = "id long, n long, g array<long>"
    wanted = items.mapInArrow(_runs, shape)
    long = wanted.where(F.col("n") >= SHORT).select(F.col("id").alias("item_id"), F.explode("g").alias("g"))
    held = docs.mapInArrow(_runs, shape).select(F.col("id").alias("doc_id"), F.explode("g").alias("g"))
    pairs = held.join(long, "g").select("doc_id", "item_id").distinct()
    short = items.join(wanted.where(F.col("n") < SHORT).select(F.col("id").alias("item_id")), "item_id", "left_semi")
    for block in _blocks(short):
        pairs = pairs.unionByName(_spotted(docs, block).distinct())
    texts = pairs.join(docs, "doc_id").join(items, "item_id").select("doc_id", "item_id", "text", "quote")
    return texts.mapInArrow(_decide, "doc_id long, item_id long, match string, coverage double").where("match != 'absent'")
