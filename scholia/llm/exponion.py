"""k-means by exponion search, in exact integers.

Each vector keeps its centroid, an upper bound of the distance to it and a lower bound of that to any other. Centroids
move, the bounds move with them, and a vector is looked at again only where they can't tell. Then only centroids
inside a ball around its own one are scanned: those within twice the upper bound and the gap to the nearest other
centroid, a prefix of the centroid's sorted list of distances to all others. Bounds are doubles, widened by more
than their rounding, and the ball's edge belongs to it; what they leave open is settled by exact squared distances,
ties by the smaller number, so the labels are those of the plain algorithm.

Every round writes vectors and bounds to a table of the shared folder and reads them from there, so a lost executor
costs one round's tasks. The sums that move the centroids come as rows of their own at the end of each task's file;
they are summed by cluster and place, and the driver gets as many numbers as the centroids have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import Shared, drop_saved, save, session
from scholia.llm.vectors import halves, longs, matrices, slim, squares, steps

#: Length of a vector, steps in 1, clusters, rounds, and what is put before an id to draw the first centroids.
SIZE, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, "3:"
#: The most clusters taken: the distances between all of them are held by each task.
MOST_CLUSTERS = 4096
#: By how much bounds are widened; their rounding is some 2^-50.
_WIDE = 2.0**-40
_STATE = "vec_id long, x array<long>, cluster int, upper double, lower double, members long, low array<long>"
_FIELDS = pa.schema([("vec_id", pa.int64()), ("x", pa.list_(pa.int64())), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("members", pa.int64()), ("low", pa.list_(pa.int64()))])


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel(), pa.int64()))


class Centroids:
    """The centroids of one round: distances between them, sorted for each, and how far each has come since the round before."""

    def __init__(self, points: np.ndarray, before: np.ndarray | None = None) -> None:
        self.points, k = points, len(points)
        apart = np.stack([np.sqrt(squares(points - p).astype(np.float64)) for p in points])
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        np.fill_diagonal(apart, np.inf)
        self.gap = apart.min(axis=1)
        self.moved = np.zeros(k) if before is None else np.sqrt(squares(points - before).astype(np.float64)) * (1 + _WIDE)
        top = np.argsort(-self.moved, kind="stable")[:2]
        self.others = np.full(k, self.moved[top[0]])  # the longest way that any other came
        self.others[top[0]] = self.moved[top[1]] if k > 1 else 0.0

    def distances(self, x: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        return np.stack([squares(x - self.points[j]) for j in numbers], axis=1)

    def search(self, x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Label and bounds, from the centroids of these numbers (rising)."""
        far = self.distances(x, numbers)
        best = far.argmin(axis=1)  # the first of equal ones
        roots = np.sqrt(far.astype(np.float64))
        rows = np.arange(len(x))
        upper = roots[rows, best] * (1 + _WIDE)
        roots[rows, best] = np.inf
        return numbers[best].astype(np.int32), upper, roots.min(axis=1) * (1 - _WIDE)

    def assign(self, x: np.ndarray, label: np.ndarray | None, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = len(self.points)
        if label is None:
            return self.search(x, np.arange(k))
        label = label.copy()
        upper = (upper + self.moved[label]) * (1 + _WIDE)
        others = self.others[label]
        lower = lower - others - _WIDE * (np.where(np.isinf(lower), 0.0, np.abs(lower)) + others)
        safe = lambda at: upper[at] < np.maximum(lower[at], self.gap[label[at]] / 2 * (1 - _WIDE))
        left = np.flatnonzero(~safe(slice(None)))
        if len(left):
            upper[left] = np.sqrt(squares(x[left] - self.points[label[left]]).astype(np.float64)) * (1 + _WIDE)
            left = left[~safe(left)]
        for a in np.unique(label[left]):
            own = left[label[left] == a]
            ball = (2 * upper[own] + (self.gap[a] if k > 1 else 0.0)) * (1 + _WIDE)
            inside = np.searchsorted(self.apart[a], ball, side="right")
            rings = np.minimum(2 ** np.ceil(np.log2(inside)).astype(np.int64), k)  # few sizes, so that rows are scanned together
            for m in np.unique(rings):
                at = own[rings == m]
                label[at], upper[at], lower[at] = self.search(x[at], np.sort(self.order[a, :m]))
        return label, upper, lower


def _vectors(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """(vec_id, x): whole vectors as integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, v in matrices(batch.column(1)):
                if v.shape[1] == size:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), _lists(steps(v, scale))], names=["vec_id", "x"])

    return rows.mapInArrow(run, "vec_id long, x array<long>")


def _matrix(lists: pa.Array, size: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _round(rows: DataFrame, held: Shared, size: int, first: bool) -> DataFrame:
    """Vectors with label and bounds, and for each task and cluster a row with the number of members and the halves of their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = held.value
        total: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), size)
            old = [None] * 3 if first else [c.to_numpy(zero_copy_only=False) for c in batch.columns[2:5]]
            label, upper, lower = centroids.assign(x, *old)
            for a in np.unique(label):
                mine = x[label == a]
                total[int(a)] = [p + q for p, q in zip(total.get(int(a), (0, 0, 0)), (len(mine), *halves(mine)))]
            none = lambda kind, n=len(x): pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(label, pa.int32()), pa.array(upper), pa.array(lower), none(pa.int64()), none(pa.list_(pa.int64()))], schema=_FIELDS)
        if total:
            n, hi, lo = (np.array([t[i] for t in total.values()]) for i in range(3))
            none = lambda kind: pa.nulls(len(total), kind)
            yield pa.RecordBatch.from_arrays([none(pa.int64()), _lists(hi), pa.array(list(total), pa.int32()), none(pa.float64()), none(pa.float64()), pa.array(n, pa.int64()), _lists(lo)], schema=_FIELDS)

    return rows.mapInArrow(run, _STATE)


def _moved(state: DataFrame, points: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean; empty ones stay."""
    parts = state.where("members is not null").select("cluster", "members", F.posexplode(F.arrays_zip("x", "low")).alias("place", "s"))
    sums = parts.groupBy("cluster", "place").agg(F.sum("members").alias("n"), F.sum("s.x").alias("hi"), F.sum("s.low").alias("lo")).collect()  # clusters x places
    out = points.copy()
    for r in sums:
        out[r["cluster"], r["place"]] = ((r["hi"] << 32) + r["lo"]) // r["n"]
    return out


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of seed and id, in that order; of one id the smaller vector comes first, a null id counts as empty."""
    drawn = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["x"] for r in vectors.orderBy(drawn, "x").limit(k).select("x").collect()], np.int64)


def cluster(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = SIZE, scale: int = SCALE, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each vector that has size entries, none null or non-finite, and the centroids.

    Other rows are left out. Repeated rows count as often as they occur. With fewer vectors than k there are as
    many centroids. A squared distance that no long holds is null. Rounds end early once no centroid moves.
    """
    if not 0 < k <= MOST_CLUSTERS:
        raise ValueError(f"k must lie between 1 and {MOST_CLUSTERS}")
    spark = session(rows)
    state = _vectors(slim(rows, key, vector), size, scale)
    points = first_centroids(state, k, seed)
    if not len(points):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), points
    before, first, table = None, True, state
    for _ in range(rounds):
        old, table = table, save(_round(state, Shared(spark, Centroids(points, before)), size, first), "clusters")
        drop_saved(old)
        state = table.where("members is null")
        before, points, first = points, _moved(table, points), False
        if np.array_equal(before, points):
            break
    held = Shared(spark, Centroids(points, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = held.value
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), size)
                label, _, _ = centroids.assign(x, *([None] * 3 if first else [c.to_numpy(zero_copy_only=False) for c in batch.columns[2:5]]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label, pa.int32()), longs(squares(x - centroids.points[label]))], names=["vec_id", "cluster", "distance"])

    out = save(state.mapInArrow(run, "vec_id long, cluster int, distance long"), "labels")
    drop_saved(table)
    return out, points


def report(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256. Sums that no long holds are null."""
    found, points = cluster(rows, key, vector)
    if not len(points):
        return found.selectExpr("*", "cast(null as long) cluster_inertia", "cast(null as long) inertia", "cast(null as string) centroid_sha256")
    sums = {r["cluster"]: int(r["s"] or 0) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a cluster
    fits = lambda v: F.lit(v if v < 2**63 else None).cast("long")
    each = lambda values: F.get(F.array(*values), F.col("cluster"))
    prints = [hashlib.sha256(",".join(map(str, map(int, p))).encode()).hexdigest() for p in points]
    return found.select(
        "vec_id", "cluster", "distance", each([fits(sums.get(j, 0)) for j in range(len(points))]).alias("cluster_inertia"), fits(sum(sums.values())).alias("inertia"), each([F.lit(p) for p in prints]).alias("centroid_sha256"),
    )


def report_sql(size: int = SIZE, scale: int = SCALE, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED) -> str:
    """The same report for DuckDB, by the plain algorithm: one pair of views a round."""
    ctes = [
        f"""kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
        "cells AS MATERIALIZED (SELECT r, unnest(x) AS v, generate_subscripts(x, 1) AS p FROM kept)",
        f"c0 AS MATERIALIZED (SELECT j, unnest(x) AS v, generate_subscripts(x, 1) AS p FROM (SELECT x, row_number() OVER (ORDER BY sha256('{seed}' || vec_id), x) - 1 AS j FROM kept) WHERE j < {k})",
    ]
    for n in range(rounds + 1):
        ctes.append(f"""a{n} AS MATERIALIZED (
  SELECT r, min((d, j)) AS best FROM (SELECT r, j, sum((cells.v - c.v) * (cells.v - c.v)) AS d FROM cells JOIN c{n} AS c USING (p) GROUP BY r, j) GROUP BY r)""")
        if n < rounds:
            ctes.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT c.j, c.p, coalesce(m.v, c.v) AS v
  FROM c{n} AS c LEFT JOIN (SELECT best[2] AS j, p, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*)) AS BIGINT) AS v FROM cells JOIN a{n} USING (r) GROUP BY ALL) AS m ON m.j = c.j AND m.p = c.p)""")
    views = ",\n".join(ctes)
    return f"""WITH {views},
found AS (SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, CAST(best[1] AS BIGINT) AS distance FROM kept JOIN a{rounds} USING (r)),
prints AS (SELECT j, sha256(string_agg(v, ',' ORDER BY p)) AS h FROM c{rounds} GROUP BY j)
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM found JOIN prints ON j = cluster"""
