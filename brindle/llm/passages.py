"""Substring dedup: words covered by a window that also starts in a document with a smaller id are removed.

A window is ``WINDOW`` consecutive words. Each has an anchor, the least hash among its ``GRAM``-word sequences, so equal
windows share an anchor wherever they stand, and about one word in five is one. The steps:

1. Anchors are counted by documents; those of two documents or more are kept, as a table and as a bitmap of bounded
   size, which lets some others through and none of these out.
2. Every document's windows with such an anchor become contexts: the words that windows round one anchor span. Contexts
   are dealt to shards by anchor.
3. A shard confirms which windows recur in documents of different ids and who holds each first, compiles them into
   Aho-Corasick automata over word numbers, a bounded number of patterns at a time, and streams its contexts through.
4. The occurrences found go back to their documents.

Anchors of more than ``HOT`` contexts are not confirmed in one task: their windows are aggregated across the cluster,
before and after the shuffle, and the confirmed ones go to as many salted shards as the anchor's contexts need.

Defined cases: null and empty texts have no words; documents of fewer words than a window lose none; rows with the
same id don't take words from each other; a row without an id neither loses words nor takes any; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.storage import cut, drop, partitions, release
from brindle.llm.words import Slab, mix, raw_texts, slabs, sliding_min

WINDOW = 13
GRAM = 5
#: Contexts of one anchor that a shard takes at most; more such anchors than HOT_MOST raise the bound.
HOT = 2000
HOT_MOST = 1_000_000
#: Bits of the bitmap of recurring anchors: this many for each, at most BITMAP_MOST.
BITS_EACH = 32
BITMAP_MOST = 1 << 29
#: Words in the patterns of one automaton.
PATTERN_WORDS = 400_000


def normal(text: bytes | None) -> bytes:
    return b" ".join((text or b"").split())


def anchors(slab: Slab) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document in the slab, first window, last window, anchor) for every stretch of windows with one anchor."""
    h = slab.hashes
    width = WINDOW - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(h) < WINDOW:
        return none, none, none, none.view(np.uint64)
    gram = h[: len(h) - GRAM + 1].copy()
    for k in range(1, GRAM):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - GRAM + 1 + k]
    gram = mix(gram)
    least = sliding_min(gram, width)
    start = np.r_[0, slab.ends[:-1]]
    last = slab.ends - WINDOW  # last window of each document
    doc = np.repeat(np.arange(len(slab.ends)), np.diff(np.r_[0, slab.ends]))[: len(least)]
    inside = np.arange(len(least)) <= last[doc]
    # A stretch ends where the anchor or the document changes; equal anchors further on make a stretch of their own.
    new = np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])] & inside
    at = np.flatnonzero(new)
    stop = np.r_[at[1:], len(least)] - 1
    stop = np.minimum(stop, last[doc[at]])
    # Repeats of an anchor's words can hold one value for long: stretches are cut to what one anchor can span.
    long = np.flatnonzero(stop - at >= width)
    if long.size:
        extra = [np.arange(at[k] + width, stop[k] + 1, width) for k in long]
        at = np.sort(np.concatenate([at, *extra]))
        stop = np.minimum(np.r_[at[1:] - 1, len(least) - 1], last[doc[at]])
    own = doc[at]
    return own, at - start[own], stop - start[own], least[at]


def _kept(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, text): row tells rows of one id with different texts apart."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))


def _recurring(rows: DataFrame) -> DataFrame:
    """(anchor, n) of anchors that documents of different ids hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for slab in slabs(raw_texts(batch.column(2))):
                doc, _, _, anchor = anchors(slab)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(ids[np.array(slab.docs)][doc])], names=["anchor", "id"])

    found = rows.where("id is not null").mapInArrow(run, "anchor long, id long")
    ends = found.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("n"))
    return cut(ends.where("a < b").select("anchor", "n"), "anchors")


def bitmap(keys: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, map) of a table of longs; slices of the map are made on executors."""
    bits = 1 << 16
    while bits < min(BITMAP_MOST, keys.count() * BITS_EACH):
        bits *= 2
    slice_bits = min(bits, 1 << 20)
    place = F.pmod(F.col("anchor"), F.lit(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy()
            for k in np.unique(at // slice_bits).tolist():
                part = own.setdefault(k, np.zeros(slice_bits, bool))
                part[at[at // slice_bits == k] % slice_bits] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array([np.packbits(v).tobytes() for v in own.values()], pa.binary())], names=["k", "part"])

    spread = keys.select(place.alias("at")).repartition(partitions(keys.sparkSession), (F.col("at") / slice_bits).cast("long"))
    whole = np.zeros(bits // 8, np.uint8)
    for k, part in zip(*spread.mapInArrow(run, "k long, part binary").toArrow().to_pydict().values()):
        whole[k * slice_bits // 8 : (k + 1) * slice_bits // 8] = np.frombuffer(part, np.uint8)
    return bits, whole


def _contexts(rows: DataFrame, known: tuple[int, np.ndarray], hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(anchor, salts, id, row, start, text) of every stretch of windows whose anchor may recur.

    hot: at most HOT_MOST anchors in order, and the number of shards of each; salts is 0 for all others.
    """
    shared = rows.sparkSession.sparkContext.broadcast((*known, *hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, whole, many, shards = shared.value
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for slab in slabs([normal(t) for t in raw_texts(batch.column(2))]):
                doc, first, last, anchor = anchors(slab)
                at = (anchor % np.uint64(bits)).astype(np.int64)
                held = np.flatnonzero(whole[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
                if not held.size:
                    continue
                doc, first, last, anchor = doc[held], first[held], last[held], anchor[held]
                base = np.r_[0, slab.ends[:-1]][doc]
                begin, end = slab.first[base + first], slab.after[base + last + WINDOW - 1]
                text = [slab.text[a:b] for a, b in zip(begin.tolist(), end.tolist())]
                source = np.array(slab.docs)[doc]
                anchor = anchor.view(np.int64)
                at = np.searchsorted(many, anchor)
                salts = np.where(many[np.minimum(at, len(many) - 1)] == anchor, shards[np.minimum(at, len(many) - 1)], 0) if len(many) else np.zeros(len(anchor), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(salts), pa.array(ids[source]), pa.array(keys[source]), pa.array(first.astype(np.int32)), pa.array(text, pa.binary())], names=["anchor", "salts", "id", "row", "start", "text"])

    return rows.where("id is not null").mapInArrow(run, "anchor long, salts long, id long, row long, start int, text binary")


def _windows(text: bytes) -> list[bytes]:
    words = text.split(b" ")
    return [b" ".join(words[k : k + WINDOW]) for k in range(len(words) - WINDOW + 1)]


def confirmed(contexts: dict[bytes, tuple[int, int]]) -> dict[bytes, int]:
    """Passages of one anchor that recur, each with the smallest id that holds it.

    contexts: text -> (smallest, largest id). A passage is the whole context if there is only one, else a window.
    """
    if len(contexts) == 1:
        return {text: low for text, (low, high) in contexts.items() if low < high}
    held: dict[bytes, tuple[int, int]] = {}
    for text, (low, high) in contexts.items():
        for window in _windows(text):
            a, b = held.get(window, (low, high))
            held[window] = (min(a, low), max(b, high))
    return {window: a for window, (a, b) in held.items() if a < b}


class Automaton:
    """Aho-Corasick over word numbers: patterns with owners, compiled once, then streamed through."""

    def __init__(self, patterns: dict[bytes, int]) -> None:
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for text, owner in patterns.items():
            words = text.split(b" ")
            key = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words)
            self.machine.add_word(key, (len(words), owner))
        self.machine.make_automaton()

    def occurrences(self, text: bytes) -> list[tuple[int, int, int]]:
        """(first word, words, owner) of every pattern in a text, in order of their ends."""
        number = self.numbers.get
        return [(end - n + 1, n, owner) for end, (n, owner) in self.machine.iter(tuple(number(w, 0) for w in text.split(b" ")))]


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over a shard sorted by (g, kind): rows (g, kind, id, row, start, text) -> (row, id, start, n) to be removed.

    Kind 0: a confirmed pattern and its owner, kind 1: a context. Groups without patterns confirm their own.
    """
    group: dict[bytes, tuple[int, int]] = {}
    given: dict[bytes, int] = {}
    current = None
    patterns: dict[bytes, int] = {}
    rows: list[tuple[list, list, list, list]] = []
    words = 0

    def close_group() -> None:
        nonlocal words
        found = given or (confirmed(group) if group else {})
        patterns.update(found)
        words += sum(text.count(b" ") + 1 for text in found)

    def stream() -> Iterator[pa.RecordBatch]:
        if not patterns:
            return
        automaton = Automaton(patterns)
        seen: dict[bytes, list[tuple[int, int, int]]] = {}
        out: list[tuple[int, int, int, int]] = []
        for ids, keys, starts, texts in rows:
            for i, key, start, text in zip(ids, keys, starts, texts):
                found = seen.get(text)
                if found is None:
                    found = seen[text] = automaton.occurrences(text)
                a = b = -1
                for at, n, owner in found:
                    if owner >= i:
                        continue
                    if a >= 0 and at <= b:
                        a, b = min(a, at), max(b, at + n)
                        continue
                    if a >= 0:
                        out.append((key, i, start + a, b - a))
                    a, b = at, at + n
                if a >= 0:
                    out.append((key, i, start + a, b - a))
            if len(seen) > 50_000:
                seen.clear()
        if out:
            columns = np.array(out, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2].astype(np.int32)), pa.array(columns[3].astype(np.int32))], names=["row", "id", "start", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column(0).to_numpy()
        new = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]).tolist()
        kinds, ids, keys, starts, texts = (c.to_pylist() for c in batch.columns[1:])
        for a, b in zip(new, [*new[1:], len(g)]):
            if g[a] != current:
                close_group()
                group, given, current = {}, {}, g[a]
                if words > PATTERN_WORDS or len(rows) > 200_000:
                    yield from stream()
                    patterns, rows, words = {}, [], 0
            while a < b and kinds[a] == 0:
                given[texts[a]] = ids[a]
                a += 1
            if a == b:
                continue
            if not given:
                for k in range(a, b):
                    low, high = group.get(texts[k], (ids[k], ids[k]))
                    group[texts[k]] = (min(low, ids[k]), max(high, ids[k]))
            rows.append((ids[a:b], keys[a:b], starts[a:b], texts[a:b]))
    close_group()
    yield from stream()


def occurrences(rows: DataFrame) -> DataFrame:
    """(row, id, start, n): stretches of words that a document with a smaller id holds too."""
    spark = rows.sparkSession
    n = partitions(spark)
    known = _recurring(rows)
    release(spark)
    bound = max(HOT, (known.agg(F.sum("n")).first()[0] or 0) // HOT_MOST)
    large = known.where(F.col("n") > bound).select("anchor", F.ceil(F.col("n") / bound).cast("long").alias("salts")).toArrow().sort_by("anchor")
    hot = (large["anchor"].to_numpy(), large["salts"].to_numpy())
    found = cut(_contexts(rows, bitmap(known.select("anchor")), hot), "contexts")
    shard = F.when(F.col("salts") == 0, F.col("anchor")).otherwise(F.xxhash64("anchor", F.pmod(F.xxhash64("row"), F.greatest("salts", F.lit(1)))))
    contexts = found.select(shard.alias("g"), F.lit(1).alias("kind"), "id", "row", "start", "text")
    many = found.where("salts > 0")
    split = F.split(F.col("text").cast("string"), " ")
    each = F.transform(F.sequence(F.lit(1), F.size("s") - (WINDOW - 1)), lambda k: F.array_join(F.slice("s", k, F.lit(WINDOW)), " "))
    windows = many.groupBy("anchor", "salts", "text").agg(F.min("id").alias("a"), F.max("id").alias("b")).withColumn("s", split)
    held = windows.select("anchor", "salts", "a", "b", F.explode(each).alias("w")).groupBy("anchor", "salts", "w").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a < b")
    salt = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))
    patterns = held.select("anchor", "a", "w", salt.alias("salt")).select(F.xxhash64("anchor", "salt").alias("g"), F.lit(0).alias("kind"), F.col("a").alias("id"), F.lit(0).cast("long").alias("row"), F.lit(0).alias("start"), F.col("w").cast("binary").alias("text"))
    both = patterns.unionByName(contexts).repartition(n, "g").sortWithinPartitions("g", "kind")
    gone = cut(both.mapInArrow(_located, "row long, id long, start int, n int"), "removed")
    release(spark)
    drop(found, known)
    return gone


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, n_words, n_removed, kept_sha256, kept): one row per row of docs; kept is null where nothing went.

    row is the text's xxhash64; ``kept`` holds the kept words, joined by one space, where words were removed.
    """
    rows = _kept(docs, id_col, text_col)
    gone = occurrences(rows)
    n = partitions(docs.sparkSession)
    order = F.lit(1).alias("kind")
    texts = rows.select("id", "row", order, F.lit(0).alias("start"), F.lit(0).alias("n"), "text")
    marks = gone.select("id", "row", F.lit(0).alias("kind"), "start", "n", F.lit("").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, marked = None, []
        names = ["id", "row", "n_words", "n_removed", "kept_sha256", "kept"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for i, row, kind, start, length, text in zip(*(c.to_pylist() for c in batch.columns[:5]), raw_texts(batch.column(5))):
                if (i, row) != current:
                    current, marked = (i, row), []
                if kind == 0:
                    marked.append((start, length))
                    continue
                words = text.split()
                kept = words
                if marked:
                    drop_it = np.zeros(len(words) + 1, np.int32)
                    for a, m in marked:
                        drop_it[a] += 1
                        drop_it[a + m] -= 1
                    covered = np.cumsum(drop_it[:-1]) > 0
                    kept = [w for w, c in zip(words, covered.tolist()) if not c]
                joined = b" ".join(kept)
                out.append((i, row, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "replace") if marked else None))
                size += len(joined)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    both = marks.unionByName(texts).repartition(n, "id", "row").sortWithinPartitions("id", "row", "kind")
    return both.mapInArrow(run, "id long, row long, n_words long, n_removed long, kept_sha256 string, kept string")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` with what :func:`occurrences` finds cut out of their texts.

    A text that loses words becomes its other words, joined by one space; others stay as they are, nulls included.
    ``size_col`` names a column that holds the text's length in characters and follows it.
    """
    rows = _kept(docs, id_col, text_col)
    gone = occurrences(rows)
    n = partitions(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # Columns go by number inside, out of the way of the operator's names.
    numbered = [F.col(f"`{c}`").alias(str(k)) for k, c in enumerate(docs.columns)]
    carried = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.xxhash64(text).alias("_row"), F.lit(1).alias("_kind"), F.lit(0).alias("_start"), F.lit(0).alias("_size"), *numbered)
    marks = gone.select(F.col("id").alias("_id"), F.col("row").alias("_row"), F.lit(0).alias("_kind"), F.col("start").alias("_start"), F.col("n").alias("_size"))
    names = docs.columns
    place = names.index(text_col)
    sized = names.index(size_col) if size_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, marked = None, []
        for batch in batches:
            own = batch.columns[5:]
            column = own[place]
            texts, changed, keep = raw_texts(column), {}, []
            for at, (i, row, kind, start, length) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:5]))):
                if (i, row) != current:
                    current, marked = (i, row), []
                if kind == 0:
                    marked.append((start, length))
                    continue
                keep.append(at)
                if marked:
                    words = (texts[at] or b"").split()
                    edge = np.zeros(len(words) + 1, np.int32)
                    for a, m in marked:
                        edge[a] += 1
                        edge[a + m] -= 1
                    covered = np.cumsum(edge[:-1]) > 0
                    changed[at] = b" ".join(w for w, c in zip(words, covered.tolist()) if not c).decode("utf-8", "replace")
            if not keep:
                continue
            if changed:
                kind = column.type
                own[place] = pa.array([changed.get(k) if k in changed else (t.decode("utf-8", "replace") if t is not None else None) for k, t in enumerate(texts)], kind)
                if sized is not None:
                    sizes = own[sized].to_pylist()
                    own[sized] = pa.array([len(changed[k]) if k in changed else v for k, v in enumerate(sizes)], own[sized].type)
            yield pa.RecordBatch.from_arrays(own, names=names).take(pa.array(keep, pa.int64()))

    both = marks.unionByName(carried, allowMissingColumns=True).repartition(n, "_id", "_row").sortWithinPartitions("_id", "_row", "_kind")
    return both.mapInArrow(run, docs.schema)
