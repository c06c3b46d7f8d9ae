"""Centroid clustering of whole-numbered vectors by subvector dictionaries, exact in every round.

Vectors are dealt into chunks of CHUNK rows, and a chunk into blocks of WIDTH dimensions. The distinct subvectors of a
block are its dictionary, without loss, and a vector is its codes. In a round the squared distances of each dictionary's
subvectors to the centroids' parts are computed once; a vector's distance to a centroid is the sum over blocks of what
stands under its codes, and a cluster's sum is its codes' counts times the subvectors. Chunks are rows of a table
written once; a round reads them and brings (clusters * components) numbers to the driver, whatever the table's size.
Dictionaries belong to a chunk, like a column file's, so none of them grows with the table and none is broadcast.

Defined cases: vectors of another length than ``dims``, null vectors and those with null or non-finite components take
no part; vectors without an id are assigned but don't start a centroid; repeated rows each count; of equal hashes that
with the smaller vector starts first; with fewer vectors than ``clusters`` there are fewer centroids; ties go to the
smaller number, and a centroid without vectors stays; an empty table gives no rows; other columns are not looked at.
Components beyond LARGEST make a distance that no long holds; a task that meets one fails and says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.storage import cut

CHUNK = 16_384
WIDTH = 2
LARGEST = 1 << 27
_ENCODED = "ids array<long>, sizes array<int>, subvectors binary, codes binary"


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as whole numbers."""
    scaled = np.floor(scale * vectors.astype(np.float64))
    if scaled.size and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST / scale:g}; its distances don't fit in 64 bits")
    return scaled.astype(np.int64)


def _encode(ids: list, vectors: np.ndarray, width: int) -> pa.RecordBatch:
    """One row: a dictionary of subvectors for each block of dimensions, and codes block after block."""
    sizes, entries, codes = [], [], []
    for at in range(0, vectors.shape[1], width):
        distinct, code = np.unique(vectors[:, at : at + width], axis=0, return_inverse=True)
        sizes.append(len(distinct))
        entries.append(distinct.astype("<i4").tobytes())
        codes.append(code.reshape(-1).astype("<u2").tobytes())
    columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([b"".join(entries)], pa.binary()), pa.array([b"".join(codes)], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["ids", "sizes", "subvectors", "codes"])


class Chunk:
    """A chunk's dictionaries and codes."""

    def __init__(self, ids: list, sizes: list[int], subvectors: bytes, codes: bytes, dims: int, width: int):
        self.ids, self.rows, self.dims, self.width = ids, len(ids), dims, width
        flat, self.blocks, at = np.frombuffer(subvectors, "<i4").astype(np.int64), [], 0
        for k, size in enumerate(sizes):
            w = min(width, dims - k * width)
            self.blocks.append(flat[at : at + size * w].reshape(size, w))
            at += size * w
        self.codes = np.frombuffer(codes, "<u2").reshape(len(sizes), self.rows)

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's centroid, the first of the nearest, and its squared distance."""
        total = np.zeros((self.rows, len(centroids)), np.int64)
        for k, (entries, codes) in enumerate(zip(self.blocks, self.codes, strict=True)):
            gap = entries[:, None, :] - centroids[None, :, k * self.width : k * self.width + entries.shape[1]]
            total += (gap * gap).sum(axis=2)[codes]
        best = total.argmin(axis=1)
        return best, total[np.arange(self.rows), best]

    def sums(self, best: np.ndarray, clusters: int) -> np.ndarray:
        """Componentwise sums of each cluster's vectors."""
        parts = []
        for entries, codes in zip(self.blocks, self.codes, strict=True):
            n = np.bincount(best * len(entries) + codes, minlength=clusters * len(entries)).reshape(clusters, -1)
            parts.append(n.astype(np.int64) @ entries)
        return np.concatenate(parts, axis=1)


def _chunks(batches: Iterator[pa.RecordBatch], dims: int, width: int) -> Iterator[Chunk]:
    for batch in batches:
        for row in range(batch.num_rows):
            ids, sizes = batch.column("ids")[row].as_py(), batch.column("sizes")[row].as_py()
            yield Chunk(ids, sizes, batch.column("subvectors")[row].as_py(), batch.column("codes")[row].as_py(), dims, width)


def encoded(vectors: DataFrame, dims: int, scale: int, width: int = WIDTH) -> DataFrame:
    """The chunks of ``vectors`` (id, vector), written."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[np.ndarray] = []
        for batch in batches:
            column = batch.column("vector")
            flat = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
            held.append(whole(flat, scale))
            ids += batch.column("id").to_pylist()
            while len(ids) >= CHUNK:
                every = np.concatenate(held)
                yield _encode(ids[:CHUNK], every[:CHUNK], width)
                ids, held = ids[CHUNK:], [every[CHUNK:]]
        if ids:
            yield _encode(ids, np.concatenate(held), width)

    return cut(vectors.mapInArrow(encode, _ENCODED), "subvectors")


def starts(vectors: DataFrame, clusters: int, dims: int, scale: int) -> np.ndarray:
    """The vectors of the ``clusters`` smallest sha256 of ``1:<id>``."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    first = vectors.where("id is not null").orderBy(order, "vector").limit(clusters).collect()
    return whole(np.array([row["vector"] for row in first], np.float64).reshape(len(first), dims), scale)


def moved(chunks: DataFrame, centroids: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The centroids after one round: floors of the means of the vectors that are nearest."""
    clusters, dims = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(clusters, np.int64), np.zeros((clusters, dims), np.int64)
        for chunk in _chunks(batches, dims, width):
            best, _ = chunk.nearest(centroids)
            n += np.bincount(best, minlength=clusters)
            sums += chunk.sums(best, clusters)
        columns = [pa.array(np.arange(clusters), pa.int32()), pa.array(n), pa.array(list(sums), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "sums"])

    parts = chunks.mapInArrow(add, "cluster int, n long, sums array<long>")
    exact = [F.sum(F.col("sums")[d].cast("decimal(20,0)")).alias(f"s{d}") for d in range(dims)]
    after = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect():
        if row["n"]:
            after[row["cluster"]] = [int(row[f"s{d}"]) // row["n"] for d in range(dims)]
    return after


def assigned(chunks: DataFrame, centroids: np.ndarray, width: int = WIDTH) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    dims = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, dims, width):
            best, distance = chunk.nearest(centroids)
            columns = [pa.array(chunk.ids, pa.int64()), pa.array(best, pa.int32()), pa.array(distance, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "cluster", "distance"])

    return chunks.mapInArrow(assign, "id long, cluster int, distance long")


def clustered(rows: DataFrame, clusters: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid): every vector with its centroid after ``rounds``."""
    vectors = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = vectors.where((F.size("vector") == dims) & finite)
    centroids = starts(vectors, clusters, dims, scale)
    shape = "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not len(centroids):  # none has an id: nothing to be near to
        return vectors.sparkSession.createDataFrame([], shape)
    chunks = encoded(vectors, dims, scale, width)
    for _ in range(rounds):
        centroids = moved(chunks, centroids, width)
    found = cut(assigned(chunks, centroids, width), "assigned")
    inertia = dict.fromkeys(range(len(centroids)), 0)
    inertia |= {row["cluster"]: int(row["d"]) for row in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    # One row a cluster: at most ``clusters`` of them are broadcast.
    about = [(k, inertia[k], sum(inertia.values()), [int(x) for x in centroids[k]]) for k in range(len(centroids))]
    about = found.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(about), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


