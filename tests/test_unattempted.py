import datetime
import random

import duckdb

from scholia import registry

registry.load()


def test_unattempted_opens_shelves_last(spark, tmp_path):
    rng, at = random.Random(3), datetime.datetime(2024, 1, 1)
    part = [(k, "red bolt", "Brand#1", "SMALL", 3) for k in [*range(150), *range(16_300, 16_500), 7, 7, 20]]  # over the edge of a shelf, some ids twice
    tried = [(i, at, rng.randrange(6), "view", 1.0, '{"k": %d}' % rng.choice([rng.randrange(160), 16_390])) for i in range(400)] + [(900, at, 9, "view", 1.0, "{}"), (901, at, None, "view", 1.0, '{"k": 3}')]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(tried, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    for t in ("part", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for t in ("nation", "documents", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    df = registry.QUERIES["join9_set2_unattempted"](spark, str(tmp_path))
    want = con.execute(registry.ORACLES["join9_set2_unattempted"]).fetchall()
    key = lambda r: (r[0] is not None, r)
    assert sorted(want, key=key) == sorted(map(tuple, df.collect()), key=key) and len(want) > 500
    assert "LeftAnti" not in df._jdf.queryExecution().optimizedPlan().toString()  # it would take the pairs of users and questions through a shuffle
