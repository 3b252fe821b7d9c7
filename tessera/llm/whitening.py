"""Whitening of vectors by their principal components, from a covariance that is summed in tiles.

Components c become the integers x = floor(scale * c) + shift. A first pass sums
them for each dimension. In the second, every batch of rows is a row-block and
is cut into column blocks of ``TILE`` dimensions (the integers in as few bytes as
hold them); column blocks are shuffled by row-block, so that those of a row-block
meet, are centred (n x - S, exact in integers, over n) and multiplied pair by
pair: a pair of column blocks is a tile of the covariance. A task adds up each of
its tiles over all its row-blocks, and a sum by tile and place adds up the tasks.
The driver assembles the d x d matrix, the only thing that it gets, and takes its
eigenvectors. Further passes project every vector: the covariance of the result
is measured in the same rows that are returned.

A row-block holds ``BLOCK_VALUES`` numbers at most (one row at least), a task the
tiles of one matrix beside it: memory is bounded by d^2, not by the rows.

Defined results: vectors that are null or hold null or non-finite components, and
those of another length than most (of the longer one in a tie), take no part;
rows without an id and repeated rows count as they are; there are as many
components as dimensions at most; a component whose variance is nothing (below
1e-12 of the whole) has null for ``whitened``, and if all are, ``explained`` and
``identity_error`` are null; empty vectors and empty tables give no rows;
components from 2^62 on make it fail; further columns are left out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Vectors, floors, narrow

TILE, BLOCK_VALUES = 16, 1 << 19
_NOTHING = 1e-12
_OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


class Fit(NamedTuple):
    """How many vectors, how many dimensions, the sums of the integers, and how these are made."""

    n: int
    dims: int
    sums: tuple[int, ...]
    scale: int
    shift: int

    def spread(self, x: np.ndarray) -> np.ndarray:
        """n x - S of integers without the shift: exact, in 64 bits where all fit, else in Python's integers."""
        most = max((abs(s) for s in self.sums), default=0) + self.n * (int(np.abs(x).max()) + abs(self.shift) if x.size else 0)
        kind = np.int64 if most < 2**63 else object
        return x.astype(kind) * self.n - (np.array(self.sums, object) - self.n * self.shift).astype(kind)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.spread(x).astype(np.float64) / self.n


def _named(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("v"))


def fit(vectors: DataFrame, scale: int = 1024, shift: int = 100_000, vector_col: str = "embedding") -> Fit | None:
    """Number and sums of the usable vectors; None if there is none."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = defaultdict(lambda: [0, 0])
        for batch in batches:
            found = Vectors(batch.column(0))
            for d in np.unique(found.lengths[found.finite]).tolist():
                rows, x = found.of(d)
                x = floors(x, scale)
                wide = x.astype(object) if x.size and int(np.abs(x).max()) * len(x) >= 2**63 else x
                held[d][0] += len(rows)
                held[d][1] = held[d][1] + wide.sum(axis=0).astype(object)
        rows = [(d, n, k, Decimal(int(s) + n * shift)) for d, (n, sums) in held.items() for k, s in enumerate(sums)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SUMS, strict=True)], ["d", "n", "k", "s"])

    parts = vectors.select(F.col(f"`{vector_col}`").alias("v")).mapInArrow(summed, "d int, n long, k int, s decimal(38,0)")
    each = parts.groupBy("d", "k").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))
    most = each.groupBy("d").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("k", "s"))).alias("sums")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return Fit(most[0].n, most[0].d, tuple(int(x.s) for x in most[0].sums), scale, shift) if most else None


_SUMS = (pa.int32(), pa.int64(), pa.int32(), pa.decimal128(38, 0))


def covariance(vectors: DataFrame, of: Fit, vector_col: str = "embedding", tile: int = TILE) -> np.ndarray:
    """The d x d covariance of the integers over all usable vectors, divisor n, centred before multiplying."""
    parts = [slice(a, min(a + tile, of.dims)) for a in range(0, of.dims, tile)]
    most = max(1, BLOCK_VALUES // of.dims)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            x = floors(Vectors(batch.column(0)).of(of.dims)[1], of.scale)
            for start in range(0, len(x), most):
                columns = [narrow(x[start : start + most, p]) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array([c.itemsize for c in columns], pa.int32()), pa.array([c.tobytes() for c in columns], pa.binary())], ["row_block", "col_block", "width", "data"])
                block += 1

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        columns: list[np.ndarray] = []
        for row in (r for b in batches for r in b.to_pylist()):
            part = parts[row["col_block"]]
            x = np.frombuffer(row["data"], f"<i{row['width']}").reshape(-1, part.stop - part.start).astype(np.int64)
            columns.append(of._replace(sums=of.sums[part]).centred(x))
            if len(columns) == len(parts):  # the last of a row-block, as they are sorted
                for i, a in enumerate(columns):
                    for j, b in enumerate(columns[i:], i):
                        held[i, j] = held.get((i, j), 0.0) + a.T @ b
                columns = []
        for (i, j), product in held.items():
            n = product.size
            yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int32()), pa.array([j] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(product.ravel())], ["i", "j", "place", "value"])

    column_blocks = vectors.select(F.col(f"`{vector_col}`").alias("v")).mapInArrow(cut, "row_block long, col_block int, width int, data binary")
    met = column_blocks.repartition("row_block").sortWithinPartitions("row_block", "col_block")
    tiles = met.mapInArrow(multiplied, "i int, j int, place int, value double").groupBy("i", "j", "place").agg(F.sum("value").alias("value"))
    out = np.zeros((of.dims, of.dims))
    i, j, place, value = (c.to_numpy() for c in tiles.select("i", "j", "place", "value").toArrow().columns)
    wide = np.minimum(tile, of.dims - j * tile)
    out[i * tile + place // wide, j * tile + place % wide] = value / of.n
    return np.triu(out) + np.triu(out, 1).T


class Axes(NamedTuple):
    """The first components of a covariance (a row each), with their variances and the sum of all variances."""

    rows: np.ndarray
    values: np.ndarray
    trace: float

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened coordinates; NaN where a component has no variance."""
        some = self.values > _NOTHING * self.trace
        return centred @ self.rows.T / np.sqrt(np.where(some, self.values, np.nan))


def axes(v: np.ndarray, k: int) -> Axes:
    values, columns = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:k]
    rows = columns.T[order]
    sign = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)])  # the largest entry is positive
    return Axes(rows * sign[:, None], values[order], float(np.trace(v)))


def identity_error(vectors: DataFrame, of: Fit, by: Axes, vector_col: str = "embedding") -> float | None:
    """The largest absolute entry of the whitened vectors' covariance minus the identity; None without a component of some variance.

    Vectors are centred on their exact mean before they are projected.
    """
    some = np.flatnonzero(by.values > _NOTHING * by.trace)
    if not len(some):
        return None

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(some), len(some)))
        for batch in batches:
            z = by.project(of.centred(floors(Vectors(batch.column(0)).of(of.dims)[1], of.scale)))[:, some]
            held += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(held.size), pa.int32()), pa.array(held.ravel())], ["place", "value"])

    found = vectors.select(F.col(f"`{vector_col}`").alias("v")).mapInArrow(moments, "place int, value double").groupBy("place").agg((F.sum("value") / of.n).alias("value"))
    return found.agg(F.max(F.abs(F.col("value") - F.when(F.col("place") % (len(some) + 1) == 0, 1.0).otherwise(0.0)))).first()[0]


def whiten(vectors: DataFrame, k: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each usable vector and each of its first k components."""
    of = fit(vectors, scale, shift, vector_col)
    if of is None:
        return vectors.sparkSession.createDataFrame([], _OUT)
    by = axes(covariance(vectors, of, vector_col), k)
    error = identity_error(vectors, of, by, vector_col)
    share = [v / by.trace for v in by.values.tolist()] if by.trace > 0 else [None] * len(by.values)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = Vectors(batch.column(1)).of(of.dims)
            if not len(rows):
                continue
            spread = of.spread(floors(x, scale))
            z = by.project(spread.astype(np.float64) / of.n)
            wide = spread if int(np.abs(spread).max()) ** 2 * of.dims < 2**63 else spread.astype(object)
            deviation = (wide * wide).sum(axis=1)
            exact = pa.array(deviation).cast(pa.decimal128(38, 0)) if deviation.dtype == np.int64 else pa.array([Decimal(v) for v in deviation], pa.decimal128(38, 0))
            coordinates = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), exact, coordinates], ["vec_id", "deviation", "z"])

    done = _named(vectors, id_col, vector_col).mapInArrow(projected, "vec_id long, deviation decimal(38,0), z array<double>")
    explained = F.array(*(F.lit(s).cast("double") for s in share))
    each = done.select("vec_id", "deviation", F.posexplode("z").alias("k", "whitened"))
    return each.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(of.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
