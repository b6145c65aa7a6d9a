import hashlib
import math
import random

import numpy as np
import pytest
from scholia.llm import exponion, whitening

KIND = "vec_id long, embedding array<float>, label int"


def odd(size):
    """Rows that both operators leave out, and what else a table may hold."""
    return [(900, None, 1), (901, [], 1), (902, [0.5] * (size - 1) + [None], 1), (903, [math.nan] * size, 1), (904, [0.5] * (size - 1) + [math.inf], 1), (905, [0.25] * (size - 1), 1)]


def single(values):
    return [float(np.float32(v)) for v in values]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, single(rng.gauss(i % 5 / 3, 0.4) * (1 + p % 7) for p in range(64)), 0) for i in range(300)]
    return out + [(7, out[7][1], 0), (None, out[9][1], None), (8, out[11][1], 0)] + odd(64)


def good(rows, size):
    return [(i, v) for i, v, _ in rows if v and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]


def test_whitening_matches_a_plain_one(spark, rows):
    own = good(rows, 64)
    x = np.array([[math.floor(64 * e) + 1_000_000 for e in v] for _, v in own], np.int64)
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = whitening.report(spark.createDataFrame(rows, KIND).repartition(5)).collect()
    assert len(got) == n * 32 and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 33))
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, set()).add(round(r.whitened, 12))
    deviations = [sum(int(d) ** 2 for d in n * a - s) for a in x]
    assert sorted((str(i), d) for i, d in by) == sorted({(str(i), d) for (i, _), d in zip(own, deviations)})
    for component in range(1, 33):
        share = next(r.explained for r in got if r.component == component)
        assert share == pytest.approx(values[component - 1] / values.sum(), rel=1e-9)
        want = centred @ vectors[:, component - 1] / math.sqrt(values[component - 1])
        found = np.array([next(iter(by[i, d][component])) for (i, _), d in zip(own, deviations)])
        sign = np.sign(found @ want)
        assert np.abs(found * sign - want).max() < 1e-8
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10


def test_rotations_keep_small_eigenvalues():
    rng = np.random.default_rng(1)
    grades = 10.0 ** -np.arange(0, 24, 2)
    b = rng.normal(size=(12, 12))
    b = b @ b.T / 12 + np.eye(12)
    a = np.sqrt(grades)[:, None] * b * np.sqrt(grades)
    values, vectors = whitening.jacobi(a)
    assert np.abs(vectors.T @ vectors - np.eye(12)).max() < 1e-12
    from fractions import Fraction

    def determinant(m):
        m, out = [list(map(Fraction, r)) for r in m], Fraction(1)
        for i in range(len(m)):
            out *= m[i][i]
            for r in m[i + 1 :]:
                f = r[i] / m[i][i]
                r[i:] = [p - f * q for p, q in zip(r[i:], m[i][i:])]
        return out

    assert float(np.prod(values)) == pytest.approx(float(determinant(a.tolist())), rel=1e-9)  # which only holds if all are accurate
    flat = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 10))
    values, _ = whitening.jacobi(flat.T @ flat)
    assert np.allclose(values, np.linalg.eigvalsh(flat.T @ flat)[::-1], atol=1e-9)


def test_whitening_of_odd_tables(spark):
    assert whitening.report(spark.createDataFrame([], KIND)).count() == 0
    assert whitening.report(spark.createDataFrame(odd(64)[:5], KIND)).count() == 0
    assert whitening.report(spark.createDataFrame([(1, [0.5] * 4, 0)] * 3, KIND)).count() == 0  # no direction in which they vary
    some = [(i, single([i, 2 * i, 7, i * i % 5]), 0) for i in range(30)]
    got = whitening.report(spark.createDataFrame(some + odd(64), KIND))
    assert {r.component for r in got.collect()} == {1, 2}  # two entries depend on one another and one never varies
    wide = spark.createDataFrame([(i, "x", [i * 1e30, 1.0 + i % 3], 1) for i in range(5)], "vec_id long, v string, embedding array<double>, `a.b` int")
    assert all(r.deviation is None for r in whitening.report(wide).collect() if r.component == 1 and r.vec_id != 2)


def plain(rows, size=64, k=8, rounds=10):
    own = [(i, [math.floor(1024 * x) for x in v]) for i, v in good(rows, size)]
    drawn = sorted(own, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in drawn[:k]]
    for step in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in own]
        if step == rounds:
            break
        for j in range(len(centres)):
            mine = [v for (_, v), (_, b) in zip(own, near) if b == j]
            if mine:
                centres[j] = [sum(col) // len(mine) for col in zip(*mine)]
    inertia = [sum(d for d, b in near if b == j) for j in range(len(centres))]
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, b, d, inertia[b], sum(inertia), prints[b]) for (i, _), (d, b) in zip(own, near)]


def test_exponion_matches_plain_rounds(spark, rows):
    got = exponion.report(spark.createDataFrame(rows, KIND).repartition(5))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain(rows)))


@pytest.mark.parametrize("seed", range(3))
def test_searches_with_bounds_give_the_plain_labels(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-4, 5, (500, 3)).astype(np.int64)  # many ties
    points = x[rng.choice(500, 40)].copy()
    points[3] = points[7]
    label, upper, lower, before = None, None, None, None
    for _ in range(12):
        own = exponion.Centroids(points, before)
        label, upper, lower = own.assign(x, label, upper, lower)
        far = ((x[:, None, :] - points[None]) ** 2).sum(axis=2)
        assert (label == far.argmin(axis=1)).all()
        before = points
        points = np.array([x[label == j].sum(axis=0) // max(1, (label == j).sum()) if (label == j).any() else points[j] for j in range(40)])


def test_exponion_of_odd_tables(spark):
    assert exponion.report(spark.createDataFrame([], KIND)).count() == 0
    assert exponion.report(spark.createDataFrame(odd(64), KIND)).count() == 0
    few = [(i, [float(i)] * 64, 0) for i in range(3)]
    assert sorted(map(tuple, exponion.report(spark.createDataFrame(few * 2 + odd(64), KIND)).collect())) == sorted(plain(few * 2))
    same = [(i, [0.25] * 64, 0) for i in range(20)]
    assert {r.cluster for r in exponion.report(spark.createDataFrame(same, KIND)).collect()} == {0}
    wide = spark.createDataFrame([(i, "x", [i * 1e30] * 64, 1) for i in range(12)], "vec_id long, x string, embedding array<double>, `a.b` int")
    assert exponion.report(wide).count() == 12
