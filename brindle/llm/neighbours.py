"""Approximate nearest neighbours by cosine with a forest of random-projection trees.

The trees split a bounded sample at medians of projections on random directions; every row is then put into one leaf
of each tree. A query walks all trees through one priority queue, ordered by the sum of squared margins of the splits
that it crosses, until the leaves that it has taken hold ``share`` of the rows, counted once per tree. Rows of those
leaves are compared exactly, in double precision.

Every row goes to its bucket of leaves once, and no more: a task holds one bucket, about ``BUCKET_ROWS`` rows, while queries
stream by, each with the list of leaves it wants there. Of rows with the
same vector only the ``k`` + 1 smallest ids are indexed, as no others can be among the nearest of any row; equal
queries are searched once. The sample has at most ``SAMPLE_ROWS`` rows and ``SAMPLE_BYTES``, leaves have about ``LEAF_ROWS`` rows of the table
while the table has fewer than ``SAMPLE_ROWS * LEAF_ROWS / 2`` rows, and grow with it beyond.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; vectors of
different lengths are searched apart, each length by itself; fewer than ``k`` candidates give fewer rows; an empty table gives an empty result; rows of one
id are one query and one candidate, with the best score of any of their vectors; ties go to smaller ids; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.storage import cut, partitions

TREES = 3
SHARE = 0.95
LEAF_ROWS = 256
SAMPLE_ROWS = 65_536
#: Bytes of the sample's vectors; the trees' normals, fewer than one for two of its rows and tree, follow it.
SAMPLE_BYTES = 64 << 20
BUCKET_ROWS = 65_536
RESULT = "query_id long, rank int, id long, score double"
#: Queries of a task that are compared at once.
STEP = 4096


class Tree(NamedTuple):
    normals: np.ndarray  # of inner nodes
    cuts: np.ndarray
    children: np.ndarray  # two per inner node; a leaf l is ~l
    held: np.ndarray  # sample rows of each leaf


def build(rows: np.ndarray, leaf: int, random: np.random.Generator) -> Tree:
    """A tree over unit vectors with about ``leaf`` sample rows in a leaf."""
    normals, cuts, children, held = [], [], [], []

    def grow(own: np.ndarray) -> int:
        if len(own) > leaf:
            normal = random.standard_normal(rows.shape[1])
            normal /= np.linalg.norm(normal)
            on = rows[own] @ normal
            at = np.median(on)
            left = on < at
            if left.any() and not left.all():
                k = len(cuts)
                normals.append(normal)
                cuts.append(at)
                children.append([0, 0])
                children[k][0] = grow(own[left])
                children[k][1] = grow(own[~left])
                return k
        held.append(len(own))
        return ~(len(held) - 1)

    grow(np.arange(len(rows)))
    n = len(cuts)
    return Tree(np.array(normals).reshape(n, rows.shape[1]), np.array(cuts), np.array(children, np.int64).reshape(n, 2), np.array(held))


def leaves_of(tree: Tree, units: np.ndarray) -> np.ndarray:
    """Leaf of each row, all rows a level at a time."""
    at = np.zeros(len(units), np.int64) if len(tree.cuts) else np.full(len(units), -1)
    while (going := np.flatnonzero(at >= 0)).size:
        nodes = at[going]
        right = (units[going] * tree.normals[nodes]).sum(axis=1) >= tree.cuts[nodes]
        at[going] = tree.children[nodes, right.astype(np.int64)]
    return ~at


def search(forest: list[Tree], unit: np.ndarray, share: float) -> list[list[int]]:
    """Leaves of each tree that a query takes, nearest first over all trees together."""
    margins = [(t.normals @ unit - t.cuts).tolist() if len(t.cuts) else [] for t in forest]
    queue = [(0.0, k, 0 if len(t.cuts) else -1) for k, t in enumerate(forest)]
    wanted = share * forest[0].held.sum()
    taken: list[list[int]] = [[] for _ in forest]
    got = 0
    while queue and got < wanted:
        far, k, node = heapq.heappop(queue)
        if node < 0:
            taken[k].append(~node)
            got += forest[k].held[~node]
            continue
        margin = margins[k][node]
        near, other = forest[k].children[node][:: 1 if margin < 0 else -1].tolist()
        heapq.heappush(queue, (far, k, near))
        heapq.heappush(queue, (far + margin * margin, k, other))
    return taken


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def _units(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def valid(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    sound = F.forall("v", lambda x: x.isNotNull() & (x == x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.coalesce(sound, F.lit(False)))
    return rows


def _placed(rows: DataFrame, shared, buckets: int) -> DataFrame:
    """(tree, bucket, leaf, id, v) for every row and tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            units = _units(_matrix(batch.column(1)))
            for k, tree in enumerate(forest):
                leaf = leaves_of(tree, units)
                n = len(leaf)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k)), pa.array(leaf % buckets), pa.array(leaf), *batch.columns[:2]], names=["tree", "bucket", "leaf", "id", "v"])

    return rows.mapInArrow(run, "tree long, bucket long, leaf long, id long, v array<double>")


def _routed(queries: DataFrame, shared, buckets: int, share: float) -> DataFrame:
    """(tree, bucket, leaves, id, v) for every query and bucket that holds leaves it takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[tuple] = []
            for row, unit in enumerate(_units(_matrix(batch.column(1)))):
                for k, taken in enumerate(search(forest, unit, share)):
                    leaves = np.array(taken, np.int64)
                    own = leaves % buckets
                    out.extend((k, int(b), leaves[own == b].tolist(), row) for b in np.unique(own))
            rows = pa.array([o[3] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64())))), batch.column(0).take(rows), batch.column(1).take(rows)], names=["tree", "bucket", "leaves", "id", "v"])

    return queries.mapInArrow(run, "tree long, bucket long, leaves array<long>, id long, v array<double>")


class _Bucket:
    """The rows of one bucket, sorted by leaf."""

    def __init__(self, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.leaf, self.ids, self.rows = (np.concatenate([h[k] for h in held]) for k in range(3))
        self.units = _units(self.rows)

    def best(self, ids: np.ndarray, rows: np.ndarray, wants: pa.Array, k: int) -> pa.RecordBatch:
        """(query, id, score): of each query's wanted leaves the best ``k`` rows."""
        units = _units(rows)
        leaf = wants.flatten().to_numpy()
        query = np.repeat(np.arange(len(wants)), wants.value_lengths().to_numpy())
        order = np.argsort(leaf, kind="stable")
        leaf, query = leaf[order], query[order]
        best, best_ids = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        for at in np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]]).tolist() if len(leaf) else ():
            q = query[at : np.searchsorted(leaf, leaf[at], "right")]
            a, b = np.searchsorted(self.leaf, leaf[at]), np.searchsorted(self.leaf, leaf[at], "right")
            if a == b:
                continue
            rough = units[q] @ self.units[a:b].T
            keep = min(k, b - a)
            floor = np.maximum(np.partition(rough, -keep, axis=1)[:, -keep], best[q, -1]) - 1e-9
            i, j = np.nonzero(rough >= floor[:, None])
            x, y = rows[q[i]], self.rows[a:b][j]
            exact = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
            score = np.concatenate([best[q].ravel(), exact])
            found = np.concatenate([best_ids[q].ravel(), self.ids[a:b][j]])
            owner = np.concatenate([np.repeat(np.arange(len(q)), k), i])
            rank = np.lexsort((found, -score, owner))
            top = rank[np.searchsorted(owner[rank], np.arange(len(q)))[:, None] + np.arange(k)]
            best[q], best_ids[q] = score[top], found[top]
        real = np.isfinite(best)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k).reshape(real.shape)[real]), pa.array(best_ids[real]), pa.array(best[real])], names=["query", "id", "score"])


def _compared(k: int):
    """Best ``k`` of each query in each bucket; rows sorted by (g, kind, leaf), candidates before queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, bucket = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in (0, 1)], axis=1)
            new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]).tolist()
            for a, b in zip(new, [*new[1:], len(keys)]):
                g, kind = keys[a].tolist()
                if g != current:
                    current, held, bucket = g, [], None
                part = batch.slice(a, b - a)
                if kind == 0:
                    held.append((part.column("leaf").to_numpy(), part.column("id").to_numpy(), _matrix(part.column("v"))))
                    continue
                if bucket is None:
                    if not held:
                        continue  # leaves without rows
                    bucket, held = _Bucket(held), []
                for at in range(0, b - a, STEP):
                    some = part.slice(at, STEP)
                    yield bucket.best(some.column("id").to_numpy(), _matrix(some.column("v")), some.column("leaves"), k)

    return run


def nearest(table: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, share: float = SHARE, seed: int = 11) -> DataFrame:
    """(query_id, rank, id, score): for every row for which ``is_query`` (over a column ``id``) holds, its ``k`` nearest.

    A cosine is of vectors of one length, so each length is an index of its own.
    """
    rows = valid(table, id_col, vector_col)
    lengths = sorted(row["n"] for row in rows.select(F.size("v").alias("n")).distinct().collect())
    parts = [_of_length(rows.where(F.size("v") == n), is_query, k, trees, share, seed) for n in lengths]
    found = reduce(DataFrame.unionByName, parts) if parts else table.sparkSession.createDataFrame([], RESULT)
    if len(parts) < 2:
        return found
    # An id with vectors of several lengths is one query, and one candidate with its best score.
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("int")
    best = found.groupBy("query_id", "id").agg(F.max("score").alias("score")).select("query_id", place.alias("rank"), "id", "score")
    return best.where(F.col("rank") <= k)


def _of_length(rows: DataFrame, is_query: Column, k: int, trees: int, share: float, seed: int) -> DataFrame:
    """The ``k`` nearest among rows (id, v) of one length."""
    spark = rows.sparkSession
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    index = cut(rows.withColumn("r", rank).where(F.col("r") <= k + 1).select("id", "v"), "vectors")
    n = index.count()
    if not n:
        return spark.createDataFrame([], RESULT)
    most = max(256, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * len(index.select("v").first()["v"]))))
    sample = index.orderBy(F.xxhash64("id"), "id").limit(most).toArrow()
    units = _units(_matrix(sample["v"].combine_chunks()))
    leaf = max(2, round(min(LEAF_ROWS, max(8, n / 64)) * len(units) / n))
    random = np.random.default_rng(seed)
    shared = spark.sparkContext.broadcast([build(units, leaf, random) for _ in range(trees)])
    groups = partitions(spark)
    buckets = max(1, -(-groups // trees), -(-n // BUCKET_ROWS))

    asked = rows.where(is_query)
    searched = cut(asked.groupBy("v").agg(F.min("id").alias("id")).select("id", "v"), "queries")
    none = F.lit(None).cast("array<long>")
    group = F.xxhash64("tree", "bucket").alias("g")
    wanted = _routed(searched.repartition(groups, "id"), shared, buckets, share)
    wanted = wanted.select(group, F.lit(1).cast("long").alias("kind"), F.lit(0).cast("long").alias("leaf"), "leaves", "id", "v")
    placed = _placed(index, shared, buckets).select(group, F.lit(0).cast("long").alias("kind"), "leaf", none.alias("leaves"), "id", "v")
    both = wanted.unionByName(placed).repartition(groups, "g").sortWithinPartitions("g", "kind", "leaf")
    found = both.mapInArrow(_compared(k + 1), "query long, id long, score double")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    found = found.groupBy("query", "id").agg(F.max("score").alias("score")).withColumn("r", best).where(F.col("r") <= k + 1)
    # Every query with the vector of a searched one.
    names = asked.join(searched.select(F.col("id").alias("query"), F.col("v").alias("w")), F.col("v") == F.col("w")).select(F.col("id").alias("query_id"), "query").distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    mine = names.join(found.drop("r"), "query").where("id != query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return mine.select("query_id", place.cast("int").alias("rank"), "id", "score").where(F.col("rank") <= k)
