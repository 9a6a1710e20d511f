"""Whiten vectors: principal components of unit variance (operator 13).

Entries are put on a grid of 1/``GRID`` (rounded down), so that sums are exact
integers.  Each distinct vector counts once in the fit; its mean and covariance
(divisor n) give the components, and every usable row is projected on the
leading ones and divided by their standard deviations.

Method: Chan's merging.  Each partition of the distinct vectors computes its
count, sums, local mean and centred scatter; ``treeReduce`` merges them two by
two; ``eigh`` runs on the driver over a matrix of dimensions squared, whatever
the number of rows.  A second pass computes the covariance of the whitened
vectors by the same merging, and how far it is from the identity comes back
with every row.

Rows whose vector is null or holds null or non-finite entries are dropped.
Vectors of another length than most distinct ones (the longer of equally many)
have no covariance with them and are dropped too, as are those with an entry
beyond 2**52 on the grid.  Components without variance (to the precision of
doubles) are left out: one vector alone, or an empty table, gives no rows.  Rows
that repeat, a null id and ties of eigenvalues need no care: the first count
once in the fit and are all projected, and components of equal eigenvalues are
those that ``eigh`` finds.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.common import slices, stored

GRID, COMPONENTS = 256, 4
_FAR = float(1 << 52)


def gridded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Usable rows of a column of lists, their lengths, and all their entries on the grid."""
    column = column.cast(pa.list_(pa.float64()))
    size = pc.list_value_length(column).fill_null(-1).to_numpy()
    row = np.repeat(np.arange(len(size)), np.maximum(size, 0))
    entry = pc.fill_null(column.flatten(), float("nan")).to_numpy()
    x = np.floor(GRID * entry)
    good = size > 0
    good[row[~(np.abs(x) < _FAR)]] = False
    return np.flatnonzero(good), size[good], x[good[row]].astype(np.int64)


def distinct(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """``(size, x)``: each distinct usable vector once, as its little-endian grid integers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            _, size, x = gridded(b.column(0))
            end = np.cumsum(size)
            raw = [x[e - n : e].astype("<i8").tobytes() for n, e in zip(size.tolist(), end.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(size.astype(np.int32)), pa.array(raw, pa.binary())], names=["size", "x"])

    return vectors.select(F.col(vector_col)).mapInArrow(work, "size int, x binary").distinct()


@dataclass
class Moments:
    """Count, exact sums, mean, and scatter about the mean of some vectors."""

    n: int
    total: np.ndarray
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        mean = x.mean(axis=0)
        off = x - mean
        return Moments(len(x), x.sum(axis=0), mean, off.T @ off)

    def merge(self, other: Moments) -> Moments:
        """Chan's formula for two parts; sums that no longer fit 64 bits are kept as Python's integers."""
        n = self.n + other.n
        d = other.mean - self.mean
        mean = self.mean + d * (other.n / n)
        scatter = self.scatter + other.scatter + np.outer(d, d) * (self.n * other.n / n)
        return Moments(n, self.total.astype(object) + other.total.astype(object), mean, scatter)


def moments(rows: DataFrame, column: str, made=None) -> Moments | None:
    """Moments of the vectors in a column of little-endian integers, or of what ``made`` makes of them; None without rows.

    Each partition sends one set of them, and they are merged two by two.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in batches:
            for s in slices([b]):
                x = np.frombuffer(b"".join(s.column(0).to_pylist()), "<i8").reshape(s.num_rows, -1)
                m = Moments.of(x if made is None else made(x))
                own = m if own is None else own.merge(m)
        if own is not None:
            total = [str(t) for t in own.total.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([own.n]), pa.array([total]), pa.array([own.mean.tolist()]), pa.array([own.scatter.ravel().tolist()])], names=["n", "total", "mean", "scatter"])

    def read(r) -> Moments:
        total = np.array([int(t) if made is None else float(t) for t in r["total"]], object)
        return Moments(r["n"], total, np.array(r["mean"]), np.array(r["scatter"]).reshape(len(r["mean"]), -1))

    parts = rows.select(column).mapInArrow(work, "n long, total array<string>, mean array<double>, scatter array<double>")
    parts = stored(parts, "moments")
    return None if parts.isEmpty() else parts.rdd.map(read).treeReduce(Moments.merge)


@dataclass
class Whitening:
    """A fitted whitening: ``n`` vectors with exact sums ``total``; ``axes`` are unit columns with variances ``eigen`` out of ``trace``."""

    n: int
    total: list[int]
    axes: np.ndarray
    eigen: np.ndarray
    trace: float
    identity_error: float = 0.0

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of grid vectors, a row each."""
        mean = np.array([t / self.n for t in self.total])
        return (x - mean) @ self.axes / np.sqrt(self.eigen)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of ``(n * x - total)**2`` of each row; None where it does not fit 64 bits."""
        far = max(int(np.abs(x).max(initial=0)), 1) * self.n + max(map(abs, self.total), default=0)
        if far * far * x.shape[1] < 1 << 63:
            d = self.n * x - np.array(self.total, np.int64)
            return (d * d).sum(axis=1).tolist()
        d = self.n * x.astype(object) - np.array(self.total, object)
        return [s if s < 1 << 63 else None for s in (d * d).sum(axis=1).tolist()]


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct usable vectors; None where there are none of any variance."""
    every = stored(distinct(vectors, vector_col), "vectors")
    common = every.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if common is None:
        return None
    rows = every.where(F.col("size") == common["size"])
    m = moments(rows, "x")
    value, axis = np.linalg.eigh(m.scatter / m.n)
    value, axis = value[::-1], axis[:, ::-1]
    real = int((value[:components] > max(value[0], 0) * len(value) * np.finfo(float).eps * 8).sum()) if value[0] > 0 else 0
    if not real:
        return None
    value, axis = value[:real], axis[:, :real]
    axis = axis * np.where(axis[np.abs(axis).argmax(axis=0), np.arange(real)] < 0, -1, 1)  # the largest entry is positive
    w = Whitening(m.n, [int(t) for t in m.total], axis, value, float(np.trace(m.scatter) / m.n))
    again = moments(rows, "x", w.apply)
    w.identity_error = float(np.abs(again.scatter / again.n - np.eye(real)).max())
    return w


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: a row for each usable vector and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    w = fit(vectors, vector_col, components)
    if w is None:
        return vectors.sparkSession.createDataFrame([], schema)
    k, dimensions = len(w.eigen), len(w.total)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            row, size, x = gridded(b.column(1))
            fits = size == dimensions
            row, x = row[fits], x[np.repeat(fits, size)].reshape(-1, dimensions)
            many = len(row)
            ids = b.column(0).take(pa.array(np.repeat(row, k)))
            deviation = pa.array([d for d in w.deviation(x) for _ in range(k)], pa.int64())
            component = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many))
            explained = pa.array(np.tile(w.eigen / w.trace, many))
            yield pa.RecordBatch.from_arrays([ids, component, pa.array(np.full(many * k, w.n)), deviation, pa.array(w.apply(x).ravel()), explained, pa.array(np.full(many * k, w.identity_error))], names=[f.split()[0] for f in schema.split(", ")])

    return vectors.select(F.col(id_col).cast("long"), F.col(vector_col)).mapInArrow(work, schema)
