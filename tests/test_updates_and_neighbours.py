import pathlib
import random

import numpy as np

from scholia.operators import keyed, nearest
from scholia.plans.practice import wrong_book

KIND = "k long, v string, n long"


def merge(old, new):
    from pyspark.sql import functions as F

    return old.unionByName(new).groupBy("k").agg(F.max("v").alias("v"), F.sum("n").alias("n"))


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("*.parquet")}


def test_a_batch_touches_its_own_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, KIND)
    keyed.apply(path, KIND, frame([(i, "a", 1) for i in range(100)]), 0, ["k"], merge, 8)
    before = files(path)
    keyed.apply(path, KIND, frame([(3, "b", 5), (3, "a", 1), (777, "z", 1)]), 1, ["k"], merge, 8)
    after = files(path)
    changed = {p.split("/")[0] for p in before.keys() ^ after.keys()}
    assert 1 <= len(changed) <= 2 and len({p.split("/")[0] for p in before}) == 8
    rows = {r.k: (r.v, r.n) for r in keyed.read(spark, path, KIND).collect()}
    assert rows == {i: ("a", 1) for i in range(100)} | {3: ("b", 7), 777: ("z", 1)}
    keyed.apply(path, KIND, frame([(3, "b", 5), (3, "a", 1), (777, "z", 1)]), 1, ["k"], merge, 8)
    assert files(path) == after  # the same batch again
    keyed.apply(path, KIND, frame([]), 2, ["k"], merge, 8)
    assert files(path) == after


def test_the_wrong_book_goes_on(spark):
    rng = random.Random(1)
    import datetime as dt

    rows = [(i, rng.randrange(4), rng.randrange(6), rng.randrange(2), dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(200)]
    frame = lambda r: spark.createDataFrame(r, "attempt_id long, user_id long, question_id long, is_correct int, created_at timestamp")
    whole = sorted(map(repr, wrong_book(frame(rows)).collect()))
    first = wrong_book(frame(rows[:90]))
    assert sorted(map(repr, wrong_book(frame(rows[90:]), first).collect())) == whole
    assert sorted(map(repr, wrong_book(frame(rows[:0]), wrong_book(frame(rows))).collect())) == whole


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(12, 16))
    x = middles[rng.integers(12, size=1500)] + rng.normal(size=(1500, 16)) * 0.5
    rows = [(i, [float(np.float32(v)) for v in e]) for i, e in enumerate(x)] + [(2000, None), (2001, [1.0] * 15), (2002, [0.0] * 16), (2003, [float("nan")] * 16)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    q = v.where("vec_id % 50 = 0")
    own = np.array([e for _, e in rows[:1500]], np.float32).astype(float)
    own /= np.sqrt((own**2).sum(axis=1, keepdims=True))
    got = {}
    for r in nearest.exact(v, q, 16, 10).collect():
        got.setdefault(r.query, []).append((r.rank, r.vec_id))
    want = {i: np.argsort(-(own @ own[i]), kind="stable")[:10].tolist() for i in range(0, 1500, 50)}
    assert {i: [j for _, j in sorted(w)] for i, w in got.items() if i < 1500} == want
    index = nearest.Index(v, 16)
    found = {(r.query, r.vec_id) for r in index.search(q.where("vec_id < 1500"), 10).collect()}
    truth = {(i, j) for i, w in want.items() for j in w}
    assert len(found & truth) / len(truth) >= 0.9
    all_lists = {(r.query, r.vec_id) for r in index.search(q.where("vec_id < 1500"), 10, probes=32).collect()}
    assert all_lists == truth
    assert index.rows.count() == 1501 and nearest.Index(v.where("false"), 16).search(q, 5).count() == 0
