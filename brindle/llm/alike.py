"""Near-duplicate groups by the similarity of five-word shingles, verified exactly.

Two texts are linked when the Jaccard similarity of their sets of shingles is SIMILAR or more; groups are what links
connect. Candidates come first from the range join of ``simhash``: fingerprints over the same shingles, met by the bit
counts of their segments, that differ in RADIUS bits or fewer. A pair of similarity 0.8 differs in some ten bits, for
which there is no index, so each text also has BANDS x ROWS minima of hashed shingles, and pairs that share a band's
minima, a cell, are candidates too; a pair of similarity 0.8 shares no cell with a probability of 3e-6, and less above. A
candidate counts only once its sets have been compared.

Texts with equal sets are one vertex from the start. First the pairs of the range join are compared, and every cell's
members with one centre, that which shares most cells with others and so is nearest to them all. Cells whose members are
still in several parts are then searched in tasks, which hold a cell of at most CELL_SHINGLES shingles; a larger one is
dealt out as pairs of blocks. There a member is compared with those of other parts only, by bitmaps first, whose bound of
the similarity loses nothing, then by the sets; parts that a link joins aren't compared any more. So tasks put out links
that join parts, never pairs.

Defined cases: a null or empty text has no shingles and equals every other such text; fewer words than a shingle make
one shingle; repeated rows get the same component; long texts are read whole; ties go to the smaller id; an empty table
gives an empty result; other columns are ignored, whatever their names. Sets hold 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import simhash
from brindle.llm.components import roots
from brindle.llm.storage import cut, partitions
from brindle.llm.words import mix, raw_texts, slabs

SIZE = 5
#: Links need this similarity, as a fraction of whole numbers.
SIMILAR = (4, 5)
BANDS = 24
ROWS = 4
#: Shingles of one cell's members that a task takes at once.
CELL_SHINGLES = 2 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)
#: Shingles of a long text that are hashed at once.
_CHUNK = 4096
#: Rows of a batch whose arrays are made and passed on at once.
_ROWS = 512


def _sets(texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(place in the batch, sorted distinct hashes of the lower-cased text's shingles) for every text."""
    for slab in slabs([t.lower() if t else t for t in texts]):
        for doc, a, b in zip(slab.docs, np.r_[0, slab.ends[:-1]].tolist(), slab.ends.tolist()):
            words = slab.hashes[a:b]
            width = min(SIZE, len(words))
            out = np.zeros(len(words) - width + 1 if width else 0, np.uint64)
            for j in range(width):
                out = out * _PRIME + words[j : j + len(out)]
            yield doc, np.unique(mix(out))


def _key(own: np.ndarray) -> int:
    from xxhash import xxh64_intdigest as digest

    return digest(own.tobytes(), 42)


def _cells(own: np.ndarray) -> np.ndarray:
    """A hash of each band's minima."""
    if not len(own):
        return np.zeros(0, np.uint64)
    flip, odd = _SALT[0][:, None], _SALT[1][:, None] | np.uint64(1)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(own), _CHUNK):
        np.minimum(least, ((own[None, at : at + _CHUNK] ^ flip) * odd).min(axis=1), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = mix(out * _PRIME + column)
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _prints(docs: DataFrame) -> DataFrame:
    """(id, key, fp, cells) of docs' (id, text): the key of the set of shingles, the text's SimHash and its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = raw_texts(batch.column(1))
            keys, cells = np.zeros(len(texts), np.uint64), [None] * len(texts)
            for place, own in _sets(texts):
                keys[place], cells[place] = _key(own), _cells(own).view(np.int64)
            prints = np.array([simhash.fingerprint(t or b"", SIZE) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys.view(np.int64)), pa.array(prints.view(np.int64)), pa.array(cells, pa.list_(pa.int64()))], names=["id", "key", "fp", "cells"])

    return docs.mapInArrow(run, "id long, key long, fp long, cells array<long>")


def _own(docs: DataFrame) -> DataFrame:
    """(id, key, own) of docs' (id, text): the set of shingles and its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            keys, sets = np.zeros(batch.num_rows, np.uint64), [None] * batch.num_rows
            for place, own in _sets(raw_texts(batch.column(1))):
                keys[place], sets[place] = _key(own), own.view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys.view(np.int64)), pa.array(sets, pa.list_(pa.int64()))], names=["id", "key", "own"])

    return docs.mapInArrow(run, "id long, key long, own array<long>")


def _near(prints: DataFrame) -> DataFrame:
    """(a, b): keys of prints (key, fp) that the range join of their fingerprints proposes; those of one fingerprint go with its first."""
    first = cut(prints.groupBy("fp").agg(F.min("key").alias("first")), "firsts")
    same = prints.join(first, "fp").where("key != first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    ends = [first.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")) for c in ("a", "b")]
    met = simhash.links(first.select("fp")).join(ends[0], "a").join(ends[1], "b").select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    return same.unionByName(met)


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough."""
    sides = [sets.select(F.col("key").alias(c), F.col("own").alias(f"own_{c}")) for c in ("a", "b")]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    common = F.size(F.array_intersect("own_a", "own_b"))
    union = F.size("own_a") + F.size("own_b") - F.col("common")
    return both.withColumn("common", common).where(F.col("common") * SIMILAR[1] >= union * SIMILAR[0]).select("a", "b")


def _bitmaps(flat: np.ndarray, row: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A bitmap of each set, of the same number of bits, about eight for each shingle of a set of middle size."""
    bits = max(6, int(np.median(sizes)).bit_length() + 3)
    held = np.zeros((len(sizes), 1 << bits), bool)
    held[row, flat >> np.uint64(64 - bits)] = True
    return np.packbits(held, axis=1).view(np.uint64)


def _forest(parts: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> list[tuple[int, int]]:
    """Links, as places, that join the parts of a cell's members; flat holds their sorted sets one after the other."""
    part = np.unique(parts, return_inverse=True)[1]
    root = np.arange(part.max() + 1)
    if len(root) < 2:
        return []
    end = np.cumsum(sizes)
    maps = _bitmaps(flat, np.repeat(np.arange(len(sizes)), sizes), sizes)
    largest = np.bincount(part).argmax()
    out = []
    for i in np.flatnonzero(part != largest).tolist():
        others = np.flatnonzero((root[part] != root[part[i]]) & ((part == largest) | (np.arange(len(part)) > i)))
        # A bit that only one of two sets has is a shingle, at least, that the other lacks.
        mine = sizes[i] - np.bitwise_count(maps[i] & ~maps[others]).sum(axis=1, dtype=np.int64)
        theirs = sizes[others] - np.bitwise_count(maps[others] & ~maps[i]).sum(axis=1, dtype=np.int64)
        most = np.minimum(mine, theirs)
        for j in others[most * SIMILAR[1] >= (sizes[i] + sizes[others] - most) * SIMILAR[0]].tolist():
            if root[part[i]] == root[part[j]]:
                continue
            common = len(np.intersect1d(flat[end[i] - sizes[i] : end[i]], flat[end[j] - sizes[j] : end[j]], assume_unique=True))
            if common * SIMILAR[1] >= (sizes[i] + sizes[j] - common) * SIMILAR[0]:
                out.append((i, j))
                root[root == root[part[j]]] = root[part[i]]
    return out


def _cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over a partition sorted by cell, rows (cell, key, part, own): (a, b) of each cell's links."""
    current, held = None, []

    def links() -> Iterator[pa.RecordBatch]:
        keys, parts = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        own = pa.concat_arrays([h[2] for h in held])
        sizes = own.value_lengths().to_numpy().astype(np.int64)
        found = np.array(_forest(parts, sizes, own.flatten().to_numpy().view(np.uint64)), np.int64).reshape(-1, 2)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(keys[found].min(axis=1)), pa.array(keys[found].max(axis=1))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cells = batch.column(0).to_numpy()
        new = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]).tolist()
        for a, b in zip(new, [*new[1:], len(cells)]):
            if held and cells[a] != current:
                yield from links()
                held = []
            current = cells[a]
            part = batch.slice(a, b - a)
            held.append((part.column(1).to_numpy(), part.column(2).to_numpy(), part.column(3)))
    if held:
        yield from links()


def _tree(near_pairs: DataFrame, cells: DataFrame, sets: DataFrame) -> DataFrame | None:
    """(vertex, root) of what links connect among near_pairs (a, b) and the keys of cells (cell, key, n), n members each; None without a link."""
    n = partitions(cells.sparkSession)
    near = cells.groupBy("key").agg(F.sum("n").alias("near"))
    rows = cells.join(near, "key").select("cell", "key", "near")
    centre = rows.groupBy("cell").agg(F.max(F.struct("near", F.xxhash64("key"), "key")).alias("c")).select("cell", F.col("c.key").alias("other"))
    pairs = rows.join(centre, "cell").where("key != other").select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b"))
    pairs = pairs.unionByName(near_pairs).distinct()
    links = cut(_similar(cut(pairs, "pairs"), sets), "links")
    tree = cut(roots(links), "tree")
    now = cells.join(tree.withColumnRenamed("vertex", "key"), "key", "left").select("cell", "key", F.coalesce("root", "key").alias("part"))
    now = cut(now.join(sets.select("key", F.size("own").alias("size")), "key"), "parts")
    # Cells of one part are done; large ones are dealt out as all pairs of blocks.
    blocks = F.ceil(2 * F.sum("size") / CELL_SHINGLES).cast("long")
    apart = now.groupBy("cell").agg(F.min("part").alias("_lo"), F.max("part").alias("_hi"), F.when(F.sum("size") > CELL_SHINGLES, blocks).otherwise(1).alias("k")).where("_lo < _hi")
    own = F.pmod(F.xxhash64("key"), F.col("k"))
    dealt = now.join(apart.select("cell", "k"), "cell").select("cell", "key", "part", own.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("j"))
    dealt = dealt.select(F.xxhash64("cell", F.least("i", "j"), F.greatest("i", "j")).alias("cell"), "key", "part").join(sets, "key").select("cell", "key", "part", "own")
    more = cut(dealt.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(_cell_links, "a long, b long"), "links")
    if more.isEmpty():
        return None if links.isEmpty() else tree
    return cut(roots(links.unionByName(more)), "tree")


def _groups(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, key) of every row, and (key, root, id) of every key: its group, and the smallest id that has it."""
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    prints = cut(_prints(narrow), "prints")
    least = prints.groupBy("key").agg(F.min("id").alias("id"))
    near_pairs = cut(_near(prints.groupBy("key").agg(F.min("fp").alias("fp"))), "near")
    cells = prints.select(F.explode("cells").alias("cell"), "key").distinct()
    shared = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cells = cut(cells.join(shared, "cell"), "cells")
    asked = cells.select("key").unionByName(near_pairs.select(F.explode(F.array("a", "b")).alias("key"))).distinct()
    wanted = cut(least.join(asked, "key"), "wanted")
    own = _own(narrow.join(wanted.select("id").distinct(), "id", "left_semi"))
    sets = cut(own.join(wanted, ["id", "key"], "left_semi").select("key", "own").dropDuplicates(["key"]), "sets")
    tree = _tree(near_pairs, cells, sets)
    if tree is None:
        return prints.select("id", "key"), least.select("key", F.col("key").alias("root"), "id")
    return prints.select("id", "key"), cut(least.join(tree.withColumnRenamed("vertex", "key"), "key", "left").select("key", F.coalesce("root", "key").alias("root"), "id"), "roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component): one row per row of docs; component is the smallest id that links reach."""
    prints, rooted = _groups(docs, id_col, text_col)
    component = rooted.groupBy("root").agg(F.min("id").alias("component"))
    return prints.join(rooted.join(component, "root").select("key", "component"), "key").select("id", "component")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, as it is, of each group: one with the smallest id. Rows without an id stay.

    Rows of an id that no other row has are told by it. Where rows share an id, groups are told apart by their sets of
    shingles, so that rows of one id in different groups each stand for their own.
    """
    sound = docs.where(F.col(f"`{id_col}`").isNotNull())
    # Columns go by number inside, out of the way of the operator's names.
    names = docs.columns
    numbered = sound.select(*[F.col(f"`{c}`").alias(str(k)) for k, c in enumerate(names)])
    own, place = str(names.index(id_col)), names.index(text_col)
    schema = T.StructType([*numbered.schema.fields, T.StructField("print", T.LongType())])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            keys = np.zeros(batch.num_rows, np.uint64)
            for at, shingles in _sets(raw_texts(batch.column(place))):
                keys[at] = _key(shingles)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.view(np.int64))], names=schema.names)

    prints, rooted = _groups(sound, id_col, text_col)
    first = rooted.groupBy("root").agg(F.min(F.struct("id", "key")).alias("one")).select("one.id", "one.key")
    first = cut(first.join(prints.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id"), "first")
    kept = numbered.join(first.where("n = 1").select("id"), F.col(own).cast("long") == F.col("id"), "left_semi")
    repeated = first.where("n > 1").select("id", "key")
    if not repeated.isEmpty():
        rows = numbered.join(repeated.select("id").distinct(), F.col(own).cast("long") == F.col("id"), "left_semi").mapInArrow(marked, schema)
        rows = rows.join(repeated, (F.col(own).cast("long") == F.col("id")) & (F.col("print") == F.col("key")), "left_semi").dropDuplicates([own, "print"])
        kept = kept.unionByName(rows.drop("print"))
    return kept.toDF(*names).unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
