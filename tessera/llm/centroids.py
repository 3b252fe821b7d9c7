"""Centroid clustering of integer vectors: distances by one matrix product a block, sums by treeAggregate.

Vectors become integers, in blocks of rows that are written once as a table (the
ids, the components in as few bytes as hold them, the largest magnitude). In a
round every block's squared distances to all centroids are |x|^2 - 2 x.c + |c|^2
with one product of matrices in double precision. All that is added up there is
at most d (max|x| + max|c|)^2; while this bound is below 2^53 every step is
exact, beyond it the same sum is taken in 64-bit integers, and beyond 2^63 in
integers without a bound. Sums and counts of a block are likewise a product with
the matrix of its assignments; RDD.treeAggregate combines those of all blocks,
so the driver gets one set of k sums a round, which are Python's integers.

A round reads the blocks once; nothing but sums is shuffled, and no group of
rows meets in a task. Lost executors: blocks are read again.

Defined results: vectors that are null, not of ``dims`` components, or hold null
or non-finite ones take no part; repeated rows and ids count as often as they
are there (equal hashes are put in order by the vectors); rows without an id are
assigned, but become seeds only after all others; with fewer vectors than seeds
there are fewer clusters; equal distances go to the smaller number; a centroid
without rows stays; an empty table gives an empty table; components from 2^62 on
and sums that are no 64-bit integer in the result make it fail; further columns
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Vectors, floors, materialize, narrow

#: Rows of a block at most.
BLOCK = 4_096
_OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"


def blocks(vectors: DataFrame, dims: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """ids, data (row by row, ``width`` bytes a component) and width of blocks of usable vectors."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                rows, x = Vectors(part.column(1)).of(dims)
                if len(rows):
                    x = narrow(floors(x, scale))
                    yield pa.RecordBatch.from_pylist([{"ids": part.column(0).take(pa.array(rows)).to_pylist(), "data": x.tobytes(), "width": x.itemsize}], _BLOCK)

    named = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    return materialize(named.mapInArrow(cut, "ids array<long>, data binary, width int"))


_BLOCK = pa.schema([("ids", pa.list_(pa.int64())), ("data", pa.binary()), ("width", pa.int32())])


def seeds(vectors: DataFrame, k: int, dims: int, scale: int, salt: str, id_col: str = "vec_id", vector_col: str = "embedding") -> list[list[int]]:
    """The integers of the k usable vectors with the least SHA-256 of ``salt:id``, in that order."""
    named = vectors.select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col(f"`{id_col}`").cast("long").cast("string")).cast("binary"), 256).alias("h"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    fine = (F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    first = named.filter(fine).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).select("v").collect()
    return [floors(np.array(r.v), scale).tolist() for r in first]


def distances(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances of the rows of x to all centroids, as doubles below 2^53, else as integers."""
    c = np.array(centroids, object)
    bound = x.shape[1] * (_most(x) + max(abs(v) for row in centroids for v in row)) ** 2 if x.size else 0
    kind = np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object
    x, c = x.astype(kind), c.astype(kind)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)


def _most(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def assign(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the smaller number of equals, and the squared distance."""
    apart = distances(x, centroids)
    nearest = apart.argmin(axis=1)
    least = apart[np.arange(len(x)), nearest]
    return nearest, least.astype(np.int64) if least.dtype == np.float64 else least


def _summed(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """A row for each centroid, of Python's integers: sums of its rows' components, their number, the sum of their distances."""
    nearest, least = assign(x, centroids)
    member = nearest[:, None] == np.arange(len(centroids))
    bound = len(x) * _most(x)
    kind = np.float64 if bound < 2**53 else object
    sums = member.T.astype(kind) @ x.astype(kind)
    apart = [sum(least[member[:, j]].tolist()) for j in range(len(centroids))]
    exact = sums.astype(np.int64).astype(object) if kind is np.float64 else sums
    return np.hstack([exact, member.sum(axis=0).astype(object)[:, None], np.array(apart, object)[:, None]])


def _unpacked(data: bytes, width: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{width}").reshape(-1, dims).astype(np.int64)


def totals(packed: DataFrame, centroids: list[list[int]], dims: int) -> np.ndarray:
    """For each centroid: sums of the components of its rows, their number, the sum of their distances; exact."""
    zero = np.zeros((len(centroids), dims + 2), object)
    rows = packed.select("data", "width").rdd
    return rows.treeAggregate(zero, lambda held, r: held + _summed(_unpacked(bytes(r.data), r.width, dims), centroids), lambda a, b: a + b)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid of every usable vector after that many rounds and a last assignment."""
    packed = blocks(vectors, dims, scale, id_col, vector_col)
    centroids = seeds(vectors, k, dims, scale, salt, id_col, vector_col)
    if not centroids:
        return vectors.sparkSession.createDataFrame([], _OUT)
    for _ in range(rounds):
        held = totals(packed, centroids, dims)
        centroids = [[s // row[dims] for s in row[:dims]] if row[dims] else old for row, old in zip(held.tolist(), centroids, strict=True)]
    spent = [row[dims + 1] for row in totals(packed, centroids, dims).tolist()]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                nearest, least = assign(_unpacked(row["data"], row["width"], dims), centroids)
                at = pa.array(nearest.astype(np.int32))
                of = lambda values, kind: pa.array(values, kind).take(at)
                columns = [pa.array(row["ids"], pa.int64()), at, pa.array(least.tolist(), pa.int64()), of(spent, pa.int64()), of([sum(spent)] * len(spent), pa.int64()), of(centroids, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"])

    return packed.mapInArrow(told, _OUT)
