"""SimHash near-duplicate groups by segment popcounts.

Fingerprints are 64 bits over word shingles. Each is embedded as the bit counts of 32 two-bit segments; the Manhattan
distance of two such vectors never exceeds the Hamming distance of the fingerprints. The range join lays grids over
the embedding: the 32 axes form seven blocks, and as a distance of at most four can touch only four of them, two
fingerprints in range share a unit cell in at least one of the 35 grids spanned by three blocks. Pairs met in a cell
are tested by the Manhattan bound, then by the exact Hamming distance.

A cell of thousands of fingerprints gives a spanning forest of its links, never all pairs; a cell beyond
``CELL_ROWS`` is passed on as it streams by and dealt out as pairs of blocks, so that no task holds an unbounded group.

Defined cases: a null or empty text has no words and the fingerprint zero, linked like any other; fewer words than a
shingle make one shingle; repeated rows get the same component; an empty table gives an empty result; other columns
of the table are ignored, whatever their names. Rows with a null id are kept out of groups' smallest ids only if all
ids of the group are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.components import roots
from brindle.llm.storage import cut, partitions
from brindle.llm.words import raw_texts

SEED = 42
RADIUS = 4
BLOCKS = 7
#: Fingerprints of one cell that a task takes at once.
CELL_ROWS = 4096
_LOW = 0x5555555555555555


def fingerprint(text: bytes, size: int) -> int:
    """The fingerprint, as an unsigned number, of a text's word shingles."""
    from xxhash import xxh64_intdigest as digest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return digest(joined, SEED)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    first = end - length
    n = len(words) - size + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(first[at:to].tolist(), end[at + size - 1 : to + size - 1].tolist())), np.uint64, to - at)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for part in range(0, to - at, 255):
            counts += bits[part : part + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(id, fp): the fingerprint of every text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t or b"", size) for t in raw_texts(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["id", "fp"])

    kept = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return kept.mapInArrow(run, "id long, fp long")


def _masks(radius: int) -> list[int]:
    """Bit masks of the grids: each keeps BLOCKS - radius of the blocks of axes."""
    edges = [round(i * 32 / BLOCKS) * 2 for i in range(BLOCKS + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(block, BLOCKS - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def unary(prints: np.ndarray) -> np.ndarray:
    """Bit counts of two-bit segments written in unary, so that XOR and a bit count give the Manhattan distance."""
    low, odd = np.uint64(_LOW), prints >> np.uint64(1)
    return (prints | odd) & low | (prints & odd & low) << np.uint64(1)


def _forest(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among a cell's fingerprints, breadth first."""
    axes = unary(points)
    left = np.arange(len(points))
    out = []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(axes[left] ^ axes[at]) <= radius
            near &= np.bitwise_count(points[left] ^ points[at]) <= radius
            if near.any():
                got = left[near]
                out.extend((at, g) for g in got)
                queue.extend(got)
                left = left[~near]
    return out


def _cell_links(radius: int, most: int):
    """Over a partition sorted by cell, rows (cell, fp): links (null, a, b) of each cell's forest.

    Rows of a cell of more than ``most`` come out as they are, (cell, fp, null), for :func:`_dealt`; no more than
    ``most`` rows and one batch are held.
    """

    def batch_of(cells: np.ndarray | None, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        columns = [none if cells is None else pa.array(cells), pa.array(a), none if b is None else pa.array(b)]
        return pa.RecordBatch.from_arrays(columns, names=["cell", "a", "b"])

    def links(cells: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1], True])
        pairs = []
        for k in np.flatnonzero(np.diff(new) > 1):
            start, end = new[k], new[k + 1]
            if end - start > most:
                yield batch_of(cells[start:end], prints[start:end], None)
            else:
                own = prints[start:end]
                pairs += [(own[x], own[y]) for x, y in _forest(own.view(np.uint64), radius)]
        if pairs:
            found = np.array(pairs, np.int64)
            yield batch_of(None, found[:, 0], found[:, 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, prints = np.zeros(0, np.int64), np.zeros(0, np.int64)
        streaming = None  # the cell too large to hold
        for batch in batches:
            cells = np.concatenate([cells, batch.column(0).to_numpy()])
            prints = np.concatenate([prints, batch.column(1).to_numpy()])
            if not len(cells):
                continue
            if streaming is not None:
                same = int(np.searchsorted(cells, streaming, "right"))
                if same:
                    yield batch_of(cells[:same], prints[:same], None)
                    cells, prints = cells[same:], prints[same:]
                if len(cells):
                    streaming = None
                else:
                    continue
            last = int(np.searchsorted(cells, cells[-1]))
            yield from links(cells[:last], prints[:last])
            cells, prints = cells[last:], prints[last:]
            if len(cells) > most:
                streaming = cells[0]
                yield batch_of(cells, prints, None)
                cells, prints = cells[:0], prints[:0]
        yield from links(cells, prints)

    return run


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """(cell, fp) of large cells, each cell dealt out as all pairs of blocks of about half of CELL_ROWS."""
    blocks = rows.groupBy("cell").agg(F.ceil(2 * F.count(F.lit(1)) / CELL_ROWS).cast("long").alias("k"))
    own = rows.join(blocks, "cell").select("cell", "a", "k", F.pmod(F.xxhash64("a"), F.col("k")).alias("own"))
    dealt = own.select("cell", "a", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("other"))
    cell = F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))
    return dealt.select(cell.alias("cell"), F.col("a").alias("fp")).repartition(n, "cell").sortWithinPartitions("cell")


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that span every group of distinct fingerprints in range.

    prints: one column ``fp`` of distinct signed longs.
    """
    n = partitions(prints.sparkSession)
    low = F.lit(_LOW)
    x = F.col("fp")
    odd = F.shiftrightunsigned(x, 1)
    axes = x.bitwiseOR(odd).bitwiseAND(low).bitwiseOR(F.shiftleft(x.bitwiseAND(odd).bitwiseAND(low), 1))
    grids = F.array(*[F.xxhash64(F.lit(g), F.col("axes").bitwiseAND(F.lit(_signed(m)))) for g, m in enumerate(_masks(radius))])
    cells = prints.select("fp", axes.alias("axes")).select(F.explode(grids).alias("cell"), "fp")
    schema = "cell long, a long, b long"
    first = cells.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(_cell_links(radius, CELL_ROWS), schema)
    first = cut(first, "links")
    large = _dealt(first.where("cell is not null"), n).mapInArrow(_cell_links(radius, 1 << 62), schema)
    return first.where("cell is null").select("a", "b").unionByName(large.select("a", "b")).distinct()


def _rooted(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, root, least) of every fingerprint: its group, and the smallest id that has it."""
    least = prints.groupBy("fp").agg(F.min("id").alias("least"))
    tree = roots(links(least.select("fp"), radius)).withColumnRenamed("vertex", "fp")
    return cut(least.join(tree, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component): one row per row of docs; component is the smallest id that links reach."""
    prints = cut(fingerprints(docs, id_col, text_col, size), "prints")
    rooted = _rooted(prints, radius)
    component = rooted.groupBy("root").agg(F.min("least").alias("component"))
    by_print = rooted.join(component, "root").select("fp", "component")
    return prints.join(by_print, "fp").select("id", "fp", "component")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs``, as it is, of each group: one with the smallest id. Rows without an id stay.

    Groups are told apart by their fingerprints, so that rows of one id in different groups each stand for their own.
    """
    sound = docs.where(F.col(f"`{id_col}`").isNotNull())
    # Columns go by number inside, out of the way of the operator's names.
    names = docs.columns
    numbered = sound.select(*[F.col(f"`{c}`").alias(str(k)) for k, c in enumerate(names)])
    own, place = str(names.index(id_col)), names.index(text_col)
    schema = T.StructType([*numbered.schema.fields, T.StructField("fp", T.LongType())])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t or b"", size) for t in raw_texts(batch.column(place))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], names=schema.names)

    rooted = _rooted(cut(fingerprints(sound, id_col, text_col, size), "prints"), radius)
    first = rooted.groupBy("root").agg(F.min(F.struct("least", "fp")).alias("one")).select(F.col("one.least").alias("id"), F.col("one.fp").alias("fp"))
    rows = numbered.mapInArrow(marked, schema).withColumnRenamed("fp", "print")
    kept = rows.join(first, (F.col(own).cast("long") == F.col("id")) & (F.col("print") == F.col("fp")), "left_semi").dropDuplicates([own, "print"])
    return kept.drop("print").toDF(*names).unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
