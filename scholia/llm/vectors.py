"""Vectors inside tasks: matrices of the rows of one length, and exact integers made of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Larger integers are cut to this, so that a difference of two still fits in a long.
_MOST = 2.0**61


def slim(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Only the key (as long) and the vector; whatever else the table holds is left behind."""
    return rows.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("v"))


def matrices(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the numbers of the rows that hold finite values only, and their values as doubles. Null and empty vectors, and those that hold nulls, are in none."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        flat = pc.list_flatten(lists.take(pa.array(at))).cast(pa.float64())
        x = flat.to_numpy(zero_copy_only=False).reshape(len(at), size)  # nulls become nan
        good = np.isfinite(x).all(axis=1)
        if good.any():
            yield at[good], x[good]


def steps(x: np.ndarray, scale: int, offset: int = 0) -> np.ndarray:
    """floor(scale * x) + offset as longs."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * scale), -_MOST, _MOST).astype(np.int64) + offset


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by column as two longs, of the upper and of the lower 32 bits, so that no sum of 2^31 rows overflows."""
    return (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)


def squares(x: np.ndarray) -> np.ndarray:
    """Exact sums of squares by row: longs, or Python's integers where longs may not hold them."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if most * most * x.shape[1] < 2**63:
        return np.einsum("ij,ij->i", x, x)
    return (x.astype(object) ** 2).sum(axis=1)


def longs(x: np.ndarray) -> pa.Array:
    """An Arrow column; null where a long doesn't hold the number."""
    if x.dtype != object:
        return pa.array(x, pa.int64())
    return pa.array([v if v < 2**63 else None for v in map(int, x)], pa.int64())
