"""Linking queries against their SQL on rows with nulls and large groups; pairs that aren't returned must not be formed."""

import random

import duckdb
import pytest

from scholia import registry

registry.load()
TOTALS = ["lnk8_lnk9_lnk10_decide", "lnk13_cor7_commit_gate", "join17_lnk1_unique", "lnk2_lnk21_rekey"]
PAIRS = ["join18_lnk5_cascade", "lnk6_subtype_filter"]


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    rng, path = random.Random(4), str(tmp_path_factory.mktemp("linking"))
    some = lambda x: None if rng.random() < 0.1 else x
    kinds = ("STANDARD", "ECONOMY", "MEDIUM", "PROMO", "LARGE", "SMALL")
    part = [(i * 7 % 4001, some("red bolt"), f"Brand#{rng.randrange(1, 5)}", rng.choice(kinds), some(rng.randrange(1, 9))) for i in range(500)]
    people = [(i * 7 % 5003, some(rng.randrange(25)), some(float(rng.randrange(-9, 9))), some(rng.choice("ABC")) if i % 5 else None) for i in range(400)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").repartition(3).write.parquet(f"{path}/part.parquet")
    spark.createDataFrame(people, "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").repartition(3).write.parquet(f"{path}/customer.parquet")
    return path


@pytest.mark.parametrize("name", TOTALS + PAIRS)
def test_rows_with_nulls_and_no_pairs_beside_those_returned(spark, place, name):
    con = duckdb.connect()
    for t in ("part", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{place}/{t}.parquet/*.parquet')")
    for t in ("events", "nation", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    df = registry.QUERIES[name](spark, place)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.select(columns).collect()) and want
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()  # no pairs are counted or ranked after a join
