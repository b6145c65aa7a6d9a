"""Figures that must be those of the SQL to the last digit."""

import datetime
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from scholia import registry
from scholia.adapters import Source
from scholia.functions.numbers import round_away
from scholia.functions.text import capital
from scholia.operators import nearest
from scholia.plans import linking, stats


def test_progress_multiplies_before_it_divides(spark):
    pairs = [(d, n) for n in range(1, 61) for d in range(n + 1)]
    df = spark.createDataFrame(pairs, "d long, n long")
    for stage, base, weight in (("rendering", 0.0, 0.05), ("catalog", 0.05, 0.3), ("validating", 0.95, 0.05)):
        p = linking.run_progress(F.lit(stage), F.col("d"), F.col("n"), F.lit(0.0), F.lit(0.0), F.lit(False))
        got = {(r.d, r.n): r.p for r in df.select("d", "n", round_away(p, 2).alias("p")).collect()}
        assert got == {(d, n): (min(1.0, base + weight * d / n) * 100 + 0.5) // 1 / 100 for d, n in pairs}


def test_overview_rounds_once(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    right = {(n, c): n * 1000 + c for n, c in ((80, 23), (80, 41), (80, 51), (160, 82), (7, 3))}
    rows = [(u * 1000 + i, at, u, "view" if i < c else "error", 1.0, '{"k": %d}' % i) for (n, c), u in right.items() for i in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["user_id"]: (r["accuracy"], r["today_accuracy"]) for r in stats.overview(Source(spark, str(tmp_path))).collect()}
    assert got == {u: (math.floor(c / n * 1000 + 0.5) / 10,) * 2 for (n, c), u in right.items()} and got[80_023] == (28.8, 28.8)


def test_scores_equal_when_rounded_are_ranked_by_id(spark):
    lean = lambda a: [math.cos(a), math.sin(a)]
    rows = [(0, lean(0.0))] + [(100 - i, lean(0.01 + i * 1e-6)) for i in range(40)] + [(200 + i, lean(0.01)) for i in range(40)]  # cosines in falling order, most of them equal to six decimals
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    show = {i: math.floor(math.cos(math.atan2(e[1], e[0])) * 1_000_000 + 0.5) / 1_000_000 for i, e in rows}
    got = [(r["vec_id"], r["score"]) for r in nearest.exact(v, v.where("vec_id = 0"), 2, 10, places=6).orderBy("rank").collect()]
    want = sorted(show.items(), key=lambda x: (-x[1], x[0]))[:10]
    assert got == want and len({x for _, x in want}) < 4
    raw = sorted(((-sum(a * b for a, b in zip(e, rows[0][1])), i) for i, e in rows))[:10]
    assert [i for i, _ in want] != [i for _, i in raw]


registry.load()


@pytest.mark.parametrize("name", ["wqi1_str24_extraction", "wqi2_wqi11_draft_dedup"])
def test_answers_are_one_capital(spark, tmp_path, name):
    rows = [(i, "\n".join(c + "x" * n for c in "ßŉǰᾀᾳﬁaéИ" for n in range(6))) for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for t in ("events", "part", "nation", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.select(columns).collect()) and any("ẞ" in r for r in want)


def test_capitals_of_all_letters(spark):
    con = duckdb.connect()
    letters = [chr(i) for i in range(1, 0x11000) if not 0xD800 <= i < 0xE000]
    want = dict(con.execute("SELECT x, upper(x) FROM (SELECT unnest(?) AS x)", [letters]).fetchall())
    got = {r["x"]: r["u"] for r in spark.createDataFrame([(x,) for x in letters], "x string").select("x", capital(F.col("x")).alias("u")).collect()}
    assert got == want
