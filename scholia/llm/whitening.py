"""Whitening of embeddings: a distributed centred scatter, and cyclic Jacobi rotations on the driver.

Components become whole steps, so the count and the sums are exact. A second pass centres every vector by the
exact mean (its whole part is taken off in integers, the rest as a fraction) and sums the products of each task;
tasks meet in a grouped sum by cell of the matrix, so the driver gets one number a cell, whatever the input. Jacobi
rotations on that matrix stop when each off-diagonal entry is nothing beside the two diagonal ones it lies between,
which keeps small eigenvalues as accurate as large ones. A third pass measures the covariance of what comes out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import Shared, arrow_schema, drop_saved, save, session
from scholia.llm.vectors import halves, longs, matrices, slim, squares, steps

#: Steps in 1, what is added to each, and components kept.
SCALE, OFFSET, TOP = 64, 1_000_000, 32
#: The longest vectors taken: their covariance is a square matrix on the driver.
MOST_DIMENSIONS = 2048
#: Sweeps of rotations before giving up, and what counts as nothing beside 1.
_SWEEPS, _EPS = 80, 2.0**-52
#: Vectors whose answers are held at a time.
_SLICE = 2048


@dataclass
class Whitening:
    """What a fit learns: the mean of n vectors as whole + rest / n, the top eigenvalues and unit eigenvectors (columns) of the covariance, and its trace."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    scale: int
    offset: int
    identity_error: float | None = None

    @property
    def size(self) -> int:
        return len(self.whole)

    def steps(self, x: np.ndarray) -> np.ndarray:
        return steps(x, self.scale, self.offset)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sums over dimensions of (n * x - sum of x)^2, exact."""
        y = x - self.whole
        most = max(int(y.max(initial=0)), -int(y.min(initial=0))) + 1
        if most * self.n < 2**62:
            return squares(y * self.n - self.rest)
        y = y.astype(object) * self.n - self.rest.astype(object)
        return (y**2).sum(axis=1)


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix without negative eigenvalues."""
    a, d = np.array(matrix, np.float64), len(matrix)
    q, least = np.eye(d), _EPS * _EPS * max(np.trace(matrix), 0.0)
    for _ in range(_SWEEPS):
        still = True
        for i in range(d - 1):
            for j in range(i + 1, d):
                x = a[i, j]
                if abs(x) <= max(_EPS * np.sqrt(abs(a[i, i] * a[j, j])), least):
                    continue
                still = False
                half = (a[j, j] - a[i, i]) / (2 * x)
                tan = (1.0 if half >= 0 else -1.0) / (abs(half) + np.hypot(1.0, half))
                cos = 1 / np.hypot(1.0, tan)
                turn = np.array([[cos, tan * cos], [-tan * cos, cos]])
                di, dj = a[i, i] - tan * x, a[j, j] + tan * x
                pair = [i, j]
                a[:, pair] = a[:, pair] @ turn
                a[pair, :] = a[:, pair].T
                a[i, i], a[j, j], a[i, j], a[j, i] = di, dj, 0.0, 0.0
                q[:, pair] = q[:, pair] @ turn
        if still:
            break
    else:
        raise RuntimeError(f"off-diagonal entries are left after {_SWEEPS} sweeps")
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], q[:, order]


def _sums(rows: DataFrame, scale: int, offset: int) -> DataFrame:
    """(size, place, n, hi, lo): for vectors of each length their number and the sums of their steps at each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for _, x in matrices(batch.column(1)):
                had = total.get(x.shape[1], (0, 0, 0))
                total[x.shape[1]] = [a + b for a, b in zip(had, (len(x), *halves(steps(x, scale, offset))))]
        for size, (n, hi, lo) in total.items():
            yield pa.RecordBatch.from_pydict({"size": np.full(size, size), "place": np.arange(size), "n": np.full(size, n), "hi": hi, "lo": lo}, schema=arrow_schema("size long, place long, n long, hi long, lo long"))

    parts = rows.mapInArrow(run, "size long, place long, n long, hi long, lo long")
    return parts.groupBy("size", "place").agg(*(F.sum(c).alias(c) for c in ("n", "hi", "lo")))


def _scatter(rows: DataFrame, held: Shared, made: Callable[[Whitening, np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """Sum over the vectors of the products of what made gives, as a square matrix."""
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = held.value, np.zeros((d, d))
        for batch in batches:
            for _, x in matrices(batch.column(1)):
                if x.shape[1] == model.size:
                    y = made(model, model.steps(x))
                    total += y.T @ y
        yield pa.RecordBatch.from_pydict({"cell": np.arange(len(upper[0])), "s": total[upper]}, schema=arrow_schema("cell long, s double"))

    cells = rows.mapInArrow(run, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect()  # d (d + 1) / 2 rows
    out = np.zeros((d, d))
    for cell, s in cells:
        out[upper[0][cell], upper[1][cell]] = out[upper[1][cell], upper[0][cell]] = s
    return out


def fit(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET, top: int = TOP) -> Whitening | None:
    """The whitening of a table's vectors; None if it holds none.

    Vectors that are null, empty or hold null or non-finite values are left out, and so are those of another
    length than the commonest (of equally common ones the longest), since they have no place in one covariance.
    Repeated rows count as often as they occur. Directions in which the vectors don't vary have no component.
    """
    own = slim(rows, key, vector)
    sums = save(_sums(own, scale, offset), "sums")
    best = sums.where("place = 0").orderBy(F.col("n").desc(), F.col("size").desc()).first()
    if best is None:
        return None
    n, size = best["n"], best["size"]
    if size > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {size} entries; the covariance of more than {MOST_DIMENSIONS} has no room on the driver")
    whole, rest = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for r in sums.where(F.col("size") == size).collect():
        whole[r["place"]], rest[r["place"]] = divmod((r["hi"] << 32) + r["lo"], n)
    drop_saved(sums)
    model = Whitening(n, whole, rest, np.zeros(0), np.zeros((size, 0)), 0.0, scale, offset)
    spark = session(rows)
    cover = _scatter(own, Shared(spark, model), Whitening.centred, size) / n
    values, vectors = jacobi(cover)
    model.trace = float(np.trace(cover))
    k = int(np.sum(values[:top] > model.trace * size * _EPS))
    model.values, model.vectors = values[:k], vectors[:, :k]
    if k:
        # what is whitened is centred already: its mean is zero but for rounding
        found = _scatter(own, Shared(spark, model), Whitening.whitened, k) / n
        model.identity_error = float(np.abs(found - np.eye(k)).max())
    return model


def transform(rows: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, deviation, whitened): for each vector of the fitted length its squared distance from the mean, times n^2,
    and its whitened components. Rows that fit() leaves out are missing; a deviation that no long holds is null."""
    held = Shared(session(rows), model)
    ddl = "vec_id long, deviation long, whitened array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        k = len(own.values)
        for batch in batches:
            for at, x in matrices(batch.column(1)):
                for i in range(0, len(at) if x.shape[1] == own.size else 0, _SLICE):
                    y = own.steps(x[i : i + _SLICE])
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * k, pa.int32()), pa.array(own.whitened(y).ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[i : i + _SLICE])), longs(own.deviations(y)), lists], schema=want)

    want = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])
    return slim(rows, key, vector).mapInArrow(run, ddl)


def report(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error.

    A table without vectors, or whose vectors are all the same, gives no row.
    """
    model = fit(rows, key, vector)
    if model is None or not len(model.values):
        return session(rows).createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    shares = F.array(*(F.lit(float(e / model.trace)) for e in model.values))
    each = transform(rows, model, key, vector).select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return each.select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("i")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
