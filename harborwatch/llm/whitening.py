"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

1. Every entry c becomes the integer ``x = floor(scale * c) + shift``. A first pass counts the rows and sums every dimension.
2. A second pass centres each row on the rounded means *before* it multiplies: tasks add products of small integers, which
   floats hold exactly, and Spark adds their parts as decimals. The scatter that reaches the driver is a square of the
   dimension, whatever the number of rows, and is exact until it becomes the covariance V.
3. V = L L' by Cholesky with the largest remaining diagonal entry as the pivot, which shows the rank. Rotations of pairs of
   columns of L (one-sided Jacobi, the pairs of a tournament round side by side) make the columns orthogonal; then their
   squared norms are the eigenvalues and the columns over their norms are the components.
4. A third pass measures the covariance of the whitened rows, a last one returns them.

Defined results: rows whose vector is null or empty or holds null or non-finite entries, or entries of 2**37 or more in size
(their squares fit no long), take no part; of vectors of different lengths only those of the commonest length (the longer at
a tie) do. Repeated rows count as often as they stand there. A null id stays null. Components without variance have no whitened
values, so there are as many components as V has rank; a table without two different sound rows gives no rows, as does an
empty one. Equal eigenvalues keep the order in which the rotations left them; the largest entry of a component is positive.
Other columns don't matter, and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborwatch.session import staged

#: Entries this large take no part.
LARGEST = 2.0**37
#: Floats hold integers up to here.
EXACT = 2.0**53
SWEEPS = 60


@dataclass
class Whitening:
    """n rows, integer sums by dimension, eigenvalues falling, unit components as columns, trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    scale: float
    shift: int

    def __post_init__(self):
        self.size = len(self.sums)
        self.means = np.array([s / self.n for s in self.sums])
        self.near = [round_half(s, self.n) for s in self.sums]  # integer means
        self.rest = [s - self.n * m for s, m in zip(self.sums, self.near, strict=True)]

    def whiten(self, x: np.ndarray, count: int) -> np.ndarray:
        """Rows of integer entries on the first components, over their deviations."""
        near = np.array(self.near, dtype=np.int64)
        centred = (x - near) - np.array([r / self.n for r in self.rest])
        return centred @ (self.components[:, :count] / np.sqrt(self.values[:count]))


def round_half(total: int, n: int) -> int:
    return (2 * total + n) // (2 * n)


def entries(column: pa.Array, scale: float, shift: int, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer entries) of the sound vectors of a column, one matrix for each length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths > 0]) if size is None else [size]:
        rows = np.flatnonzero(lengths == d)
        if not len(rows):
            continue
        flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
        c = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), int(d)) * scale
        sound = (np.abs(c) < LARGEST).all(axis=1)  # false for what isn't a number
        if sound.any():
            yield rows[sound], np.floor(c[sound]).astype(np.int64) + shift


def _vectors(df: DataFrame, vector_col: str, *others) -> DataFrame:
    return df.select(F.col(vector_col).cast("array<double>").alias("v"), *others)


def _whole(total: DataFrame) -> list:
    """Sums of ``value`` by ``cell``; as many rows as cells, never as rows of the table."""
    return total.groupBy("cell").agg(F.sum("value").alias("value")).collect()


def totals(df: DataFrame, vector_col: str, scale: float, shift: int) -> tuple[int, list[int]]:
    """Number of vectors of the commonest length, and their sums."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for rows, x in entries(batch.column(0), scale, shift):
                at = found.setdefault(x.shape[1], [0] * (x.shape[1] + 1))
                for k, part in enumerate([len(rows), *map(int, x.sum(axis=0))]):
                    at[k] += part
        for size, parts in found.items():
            yield _cells(size, np.arange(-1, size), parts)

    parts = _vectors(df, vector_col).mapInArrow(add, "size int, cell long, value decimal(38,0)")
    sums = staged(parts.groupBy("size", "cell").agg(F.sum("value").alias("value")), "whitening-sums")
    most = sums.filter("cell = -1").orderBy(F.desc("value"), F.desc("size")).limit(1).collect()
    if not most:
        return 0, []
    rows = {r["cell"]: int(r["value"]) for r in sums.filter(F.col("size") == most[0]["size"]).collect()}
    n = rows.pop(-1)
    return n, [rows[k] for k in range(len(rows))]


def _cells(size: int, cells: np.ndarray, values: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(cells), size), pa.int32()), pa.array(cells, pa.int64()),
        pa.array([Decimal(v) for v in values], pa.decimal128(38, 0)),
    ], ["size", "cell", "value"])


def products(d: np.ndarray) -> np.ndarray:
    """d' d of integers, exact: by floats as long as they hold the sums, else by whole numbers of any size."""
    most = float(np.abs(d).max(initial=0))
    block = int(EXACT / max(1.0, most * most))
    if block < 1:
        return d.astype(object).T @ d.astype(object)
    total = np.zeros((d.shape[1], d.shape[1]), dtype=object)
    for k in range(0, len(d), block):
        f = d[k : k + block].astype(np.float64)
        total += (f.T @ f).astype(np.int64).astype(object)
    return total


def covariance(df: DataFrame, vector_col: str, n: int, sums: list[int], scale: float, shift: int) -> np.ndarray:
    """Covariance (divisor n) of the integer entries."""
    size = len(sums)
    near = [round_half(s, n) for s in sums]
    upper = np.triu_indices(size)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, centre = None, np.array(near, dtype=np.int64)
        for batch in batches:
            for _, x in entries(batch.column(0), scale, shift, size):
                part = products(x - centre)[upper]
                total = part if total is None else total + part
        if total is not None:
            yield _cells(size, upper[0] * size + upper[1], total.tolist())

    rest = [s - n * m for s, m in zip(sums, near, strict=True)]
    v = np.zeros((size, size))
    for row in _whole(_vectors(df, vector_col).mapInArrow(scatter, "size int, cell long, value decimal(38,0)")):
        i, j = divmod(row["cell"], size)
        v[i, j] = v[j, i] = (n * int(row["value"]) - rest[i] * rest[j]) / (n * n)
    return v


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with V = L L', a column for each pivot; its rows in the pivots' order are a lower triangle."""
    left = np.diag(v).astype(float).copy()
    least = len(v) * np.finfo(float).eps * left.max(initial=0.0)
    factor = np.zeros((len(v), 0))
    while factor.shape[1] < len(v):
        p = int(np.argmax(left))
        if left[p] <= least:
            break
        column = (v[:, p] - factor @ factor[p]) / np.sqrt(left[p])
        column[left == -np.inf] = 0.0  # rows of earlier pivots
        column[p] = np.sqrt(left[p])
        factor = np.column_stack([factor, column])
        left = left - column * column
        left[p] = -np.inf
    return factor


def rounds(count: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rounds of a tournament of an even number of players: every pair once, no player twice in a round."""
    ring = list(range(1, count))
    out = []
    for _ in range(count - 1):
        seats = [0, *ring]
        out.append((np.array(seats[: count // 2]), np.array(seats[: count // 2 - 1 : -1])))
        ring = ring[-1:] + ring[:-1]
    return out


def jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of L L', by rotating the columns of L."""
    rank = factor.shape[1]
    if rank == 0:
        return np.zeros(0), factor
    a = np.column_stack([factor, np.zeros((len(factor), rank % 2))])
    schedule = rounds(a.shape[1]) if a.shape[1] > 1 else []
    for _ in range(SWEEPS):
        off = 0.0
        for p, q in schedule:
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            size = np.sqrt(xx * yy)
            angle = np.divide(np.abs(xy), size, out=np.zeros_like(size), where=size > 0)
            off = max(off, float(angle.max()))
            turn = angle > np.finfo(float).eps
            if not turn.any():
                continue
            p, q, x, y = p[turn], q[turn], x[:, turn], y[:, turn]
            zeta = (yy[turn] - xx[turn]) / (2 * xy[turn])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
        if off <= 4 * np.finfo(float).eps:
            break
    norms = np.sqrt((a * a).sum(axis=0))[:rank]
    order = np.argsort(-norms, kind="stable")
    units = a[:, order] / norms[order]
    most = np.abs(units).argmax(axis=0)
    return norms[order] ** 2, units * np.where(units[most, np.arange(rank)] < 0, -1.0, 1.0)


def fit(vectors: DataFrame, vector_col: str = "embedding", scale: float = 1024.0, shift: int = 100_000) -> Whitening | None:
    """The whitening of all sound vectors; None where there are none."""
    n, sums = totals(vectors, vector_col, scale, shift)
    if not n:
        return None
    v = covariance(vectors, vector_col, n, sums, scale, shift)
    values, units = jacobi(pivoted_cholesky(v))
    return Whitening(n, sums, values, units, float(np.trace(v)), scale, shift)


def identity_error(model: Whitening, vectors: DataFrame, vector_col: str, count: int) -> float:
    """Largest entry of the whitened rows' covariance minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count + 1, count))
        for batch in batches:
            for _, x in entries(batch.column(0), model.scale, model.shift, model.size):
                w = model.whiten(x, count)
                total += np.vstack([w.T @ w, w.sum(axis=0)])
        cells = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total.ravel())], ["cell", "value"])

    total = np.zeros((count + 1) * count)
    for row in _whole(_vectors(vectors, vector_col).mapInArrow(run, "cell long, value double")):
        total[row["cell"]] = row["value"]
    total = total.reshape(count + 1, count) / model.n
    return float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(count)).max(initial=0.0))


def whiten(
    vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: float = 1024.0, shift: int = 100_000,
) -> DataFrame:
    """(vec_id, component, n, deviation decimal, whitened, explained, identity_error) of each sound row and component."""
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fit(vectors, vector_col, scale, shift)
    count = min(components, len(model.values)) if model else 0
    if not count:
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(model, vectors, vector_col, count)
    explained = model.values[:count] / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, rest = np.array(model.near, dtype=np.int64), np.array(model.rest, dtype=object)
        for batch in batches:
            for rows, x in entries(batch.column(0), scale, shift, model.size):
                d = x - near
                w = model.whiten(x, count)
                wide = d.astype(object)
                deviation = ((model.n * wide - rest) ** 2).sum(axis=1)
                times = np.repeat(np.arange(len(rows)), count)
                yield pa.RecordBatch.from_arrays([
                    batch.column(1).take(pa.array(rows)).cast(pa.int64()).take(pa.array(times)),
                    pa.array(np.tile(np.arange(1, count + 1), len(rows)), pa.int32()),
                    pa.array(np.full(len(times), model.n), pa.int64()),
                    pa.array([Decimal(v) for v in deviation], pa.decimal128(38, 0)).take(pa.array(times)),
                    pa.array(w.ravel()),
                    pa.array(np.tile(explained, len(rows))),
                    pa.array(np.full(len(times), error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return _vectors(vectors, vector_col, F.col(id_col).cast("long").alias("i")).mapInArrow(run, schema)
