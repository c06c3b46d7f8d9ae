"""Benchmark decontamination: SimHash of item-sized windows, then exact weighted-shingle similarity.

Words are taken in lower case (A-Z). For every length among the benchmark's items, the fingerprints of all windows of
that many words come from running bit counts of word-pair hashes, so a window costs the same whatever its length. A
multi-index finds all windows within ``RADIUS`` bits of an item: a fingerprint is four blocks of 16 bits, and within 11
bits one of them is within two. So an index of each block holds every item under all values within two bits of its own;
a window looks its four blocks up and meets the items found there alone. What is in range is verified by the exact
similarity of five-word shingles, weighted by how often each occurs (sum of minima over sum of maxima), at
``SIMILARITY`` or more.

The items are a stated set: they are broadcast in blocks of at most ``ITEM_BYTES`` of text and about ``ITEMS`` items, each
run over all documents; documents are never shuffled. Items of 50 words or more are grouped by lengths that differ by two per cent at most; the
group's windows are as long as its longest item, and verification tries every window of the item's own length inside.
A document shorter than an item is a single window.

Defined cases: null and empty texts have no windows, items without words none either; sequences of fewer words than a
shingle are one shingle; ties of a document's windows for an item go to the first; repeated rows are each reported; a long
text is read in steps of STEP windows, plus the longest item's words, whose running counts take 64 numbers a word; an
empty table on either side gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.words import Slab, mix, raw_texts, slabs, spans, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 11
ITEM_BYTES = 16 << 20
ITEMS = 20_000
#: Windows whose bit counts are held at once.
STEP = 1 << 15


class Match(NamedTuple):
    item: int
    start: int
    n_words: int
    hamming: int
    similarity: float


class Length(NamedTuple):
    words: int
    items: list[int]  # places in the list of items
    prints: np.ndarray
    tables: np.ndarray  # by block << 16 | value: the items there, a bit each if there are eight at most, else whether there are any
    keys: np.ndarray  # of all four indexes, block << 16 | value, in order
    owners: np.ndarray  # places in items, for each key


def similarity(a: list[bytes], b: list[bytes]) -> float:
    """Weighted Jaccard similarity of two word sequences' shingles."""

    def weights(words: list[bytes]) -> Counter:
        return Counter(tuple(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1)))

    x, y = weights(a), weights(b)
    shared = sum(min(n, y[s]) for s, n in x.items() if s in y)
    return shared / (sum(x.values()) + sum(y.values()) - shared)


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of pairs of words, or of words where windows have one word only."""
    if size < 2 or len(hashes) < 2:
        return hashes if size < 2 else hashes[:0]
    return mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])


def _kind(grams: int) -> type:
    """The narrowest numbers that tell the counts of a window of so many grams apart."""
    return np.uint8 if grams < 1 << 8 else np.uint16 if grams < 1 << 16 else np.uint32


def _sums(hashes: np.ndarray, size: int, kind: type) -> np.ndarray:
    """Running counts of each bit, modulo what ``kind`` holds, one row more than there are grams."""
    grams = _grams(hashes, size)
    out = np.zeros((len(grams) + 1, 64), kind)
    bits = np.unpackbits(grams.view(np.uint8), bitorder="little").reshape(-1, 64)
    np.cumsum(bits, axis=0, dtype=kind, out=out[1:])
    return out


def _prints(counts: np.ndarray, grams: int) -> np.ndarray:
    return np.packbits((counts > grams // 2).reshape(-1), bitorder="little").view(np.uint64)


#: Where the tables of the blocks of STEP windows begin.
_TABLE = np.tile(np.arange(4, dtype=np.intp) << 16, STEP)
_NEAR = np.array([0] + [1 << i for i in range(16)] + [1 << i | 1 << j for i in range(16) for j in range(i)], np.uint16)


class Index:
    """The benchmark's items by length, with the multi-index of their fingerprints."""

    def __init__(self, ids: list[int], texts: list[bytes]) -> None:
        words = [t.lower().split() for t in texts]
        self.ids = [i for i, w in zip(ids, words) if w]
        self.words = [w for w in words if w]
        groups: dict[int, list[int]] = {}
        top = 0
        for at in sorted(range(len(self.words)), key=lambda k: -len(self.words[k])):
            n = len(self.words[at])
            if n * 1.02 < top or not top:  # below 50 words, any difference
                top = n
            groups.setdefault(top, []).append(at)
        self.lengths = []
        for top, items in sorted(groups.items()):
            prints = np.array([self._print(at) for at in items], np.uint64)
            keys = (prints.view(np.uint16).reshape(-1, 4)[:, :, None] ^ _NEAR).astype(np.int32) | (np.arange(4, dtype=np.int32) << 16)[:, None]
            tables = np.zeros(4 << 16, np.uint8)
            for place, own in enumerate(keys.reshape(len(items), -1)):
                tables[own] |= 1 << place if len(items) <= 8 else 1
            order = np.argsort(keys.ravel(), kind="stable")
            owners = np.repeat(np.arange(len(items), dtype=np.int32), 4 * len(_NEAR))[order]
            self.lengths.append(Length(top, items, prints, tables, keys.ravel()[order], owners))
        self.longest = max(groups, default=0)

    def _print(self, at: int) -> int:
        raw = np.frombuffer(b" ".join(self.words[at]), np.uint8)
        hashes = word_hashes(raw, *spans(raw))
        sums = _sums(hashes, len(hashes), _kind(len(hashes)))
        return int(_prints(sums[-1:] - sums[:1], len(sums) - 1)[0])

    def _verified(self, slab: Slab, doc_start: int, doc_end: int, start: int, size: int, item: int, hamming: int) -> Match | None:
        own = self.words[item]
        end = min(start + size, doc_end)
        text = slab.text
        words = [text[a:b] for a, b in zip(slab.first[start:end].tolist(), slab.after[start:end].tolist())]
        best = None
        for shift in range(max(0, len(words) - len(own)) + 1):
            part = words[shift : shift + len(own)]
            s = similarity(part, own)
            if s >= SIMILARITY and (best is None or s > best.similarity):
                best = Match(item, start + shift - doc_start, len(part), hamming, s)
        return best

    def _near(self, length: Length, prints: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(window, item, distance) of all fingerprints within the radius."""
        places = prints.view(np.uint16).astype(np.intp)
        places += _TABLE[: len(places)]
        # The four answers of a window are the four bytes of one number.
        hit = length.tables.take(places, mode="wrap")
        windows = np.flatnonzero(hit.view(np.uint32))
        if len(length.items) <= 8:
            found = np.bitwise_or.reduce(hit.reshape(-1, 4)[windows], axis=1)
            row, item = np.nonzero(np.unpackbits(found[:, None], axis=1, bitorder="little"))
            at = windows[row]
        else:
            row, block = np.nonzero(hit.reshape(-1, 4)[windows])
            key = places.reshape(-1, 4)[windows[row], block].astype(np.int32)
            first = np.searchsorted(length.keys, key)
            n = np.searchsorted(length.keys, key, "right") - first
            at = np.repeat(windows[row], n)
            item = length.owners[np.arange(len(at)) + np.repeat(first - np.cumsum(n) + n, n)]
        apart = np.bitwise_count(prints[at] ^ length.prints[item])
        near = np.flatnonzero(apart <= RADIUS)
        if not near.size:
            return iter(())
        # An item met through several blocks counts once.
        near = near[np.unique(at[near] * len(length.items) + item[near], return_index=True)[1]]
        at, item, apart = at[near], item[near], apart[near]
        return zip(at.tolist(), [length.items[k] for k in item.tolist()], apart.tolist())

    def matches(self, slab: Slab) -> dict[int, dict[int, Match]]:
        """For each document of the slab, by its place in it, the best window for each item that it leaks."""
        found: dict[int, dict[int, Match]] = {}
        starts = np.r_[0, slab.ends[:-1]]
        sizes = slab.ends - starts

        def keep(doc: int, start: int, size: int, item: int, hamming: int) -> None:
            match = self._verified(slab, int(starts[doc]), int(slab.ends[doc]), start, size, item, hamming)
            if match and (match.item not in found.setdefault(doc, {}) or match.similarity > found[doc][match.item].similarity):
                found[doc][match.item] = match

        n = len(slab.hashes)
        doc_of = np.repeat(np.arange(len(starts)), sizes)
        for at in range(0, n, STEP):
            hashes = slab.hashes[at : at + STEP + self.longest]
            made: dict[tuple, np.ndarray] = {}
            for length in self.lengths:
                grams = max(1, length.words - 1)
                key = (min(length.words, 2), _kind(grams))
                if key not in made:
                    made[key] = _sums(hashes, *key)
                sums = made[key]
                counts = sums[grams : grams + STEP] - sums[: max(0, len(sums) - grams)][:STEP]
                for window, item, hamming in self._near(length, _prints(counts, grams)):
                    start = at + window
                    doc = int(doc_of[start])
                    if start + length.words <= slab.ends[doc]:
                        keep(doc, start, length.words, item, hamming)
        shortest = SIMILARITY * min((x.words for x in self.lengths), default=0)
        for doc in np.flatnonzero((sizes < self.longest) & (sizes >= shortest) & (sizes > 0)).tolist():
            size, start = int(sizes[doc]), int(starts[doc])
            own = None
            for length in self.lengths:
                # Shorter than the group's windows: the document is the only one.
                if not SIMILARITY * min(len(self.words[i]) for i in length.items) <= size < length.words:
                    continue
                if own is None:
                    sums = _sums(slab.hashes[start : start + size], size, _kind(size))
                    own = _prints(sums[-1:] - sums[:1], len(sums) - 1)
                for _, item, hamming in self._near(length, own):
                    keep(doc, start, size, item, hamming)
        return found


def _indexes(items: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """Indexes of blocks of items of about ITEM_BYTES each."""
    kept = items.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    size, n = kept.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("text")).first()
    blocks = max(-(-size // ITEM_BYTES), -(-n // ITEMS))
    for k in range(blocks):
        got = kept.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).toArrow().sort_by([("id", "ascending"), ("text", "ascending")])
        yield Index(got["id"].to_pylist(), [t.encode() for t in got["text"].to_pylist()])


_SCHEMA = "id long, item long, start long, n_words long, hamming int, similarity double"


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, start, n_words, hamming, similarity): the best window of every document and item that it leaks."""
    spark = docs.sparkSession
    kept = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = spark.createDataFrame([], _SCHEMA)
    for index in _indexes(items, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names = ["id", "item", "start", "n_words", "hamming", "similarity"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for slab in slabs([t.lower() if t else t for t in raw_texts(batch.column(1))]):
                    rows = [(ids[slab.docs[doc]], shared.value.ids[m.item], *m[1:]) for doc, own in shared.value.matches(slab).items() for m in own.values()]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        out = out.unionByName(kept.mapInArrow(run, _SCHEMA))
    return out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, that leak no item."""
    for index in _indexes(items, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for slab in slabs([t.lower() if t else t for t in raw_texts(batch.column(text_col))]):
                    keep[[slab.docs[doc] for doc, own in shared.value.matches(slab).items() if own]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
