import datetime as dt
import random

import pytest

from scholia.streaming import events as ev

KIND = "event_id long, ts timestamp, user_id long, event_type string"
START = dt.datetime(2024, 1, 1)


@pytest.fixture
def feed(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def put(name, rows):
        spark.createDataFrame([(i, START + dt.timedelta(hours=h), u, k) for i, h, u, k in rows], KIND).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    return put, lambda: spark.readStream.schema(KIND).parquet(str(tmp_path / "in" / "*")), str(tmp_path / "at")


def some(seed, ids, hours):
    rng = random.Random(seed)
    return [(i, hours + i % 50, rng.randrange(6), rng.choice(["view", "view", "click", "purchase", "error"])) for i in ids]


def test_state_goes_on_after_a_restart(spark, feed):
    put, stream, at = feed
    one, two = some(1, range(60), 0), some(2, range(60, 140), 60)
    put("a", one)
    ev.run_once(ev.guarded(stream()), at=at + "g")
    ev.run_once(ev.coalesced(stream()), at=at + "c")
    ev.run_once(ev.once(stream(), ["user_id", "event_type"]).select("user_id", "event_type"), at=at + "o")
    put("b", two)  # each query starts anew from its checkpoint
    guard = {(r.event_id, r.verdict) for r in ev.run_once(ev.guarded(stream()), at=at + "g").collect()}
    runs = {tuple(r) for r in ev.run_once(ev.coalesced(stream()), at=at + "c").collect()}
    once = [tuple(r) for r in ev.run_once(ev.once(stream(), ["user_id", "event_type"]).select("user_id", "event_type"), at=at + "o").collect()]
    want, ended, want_runs, state = set(), {}, set(), {}
    for i, _, u, k in one + two:
        want.add((i, "ignored" if u in ended else "ends" if k in ("purchase", "error") else "counts"))
        if k in ("purchase", "error"):
            ended.setdefault(u, i)
        revision, run, open_ = state.get(u, (0, 0, False))
        if k == "purchase":
            state[u] = (revision + 1, run + (not open_), True)
            want_runs.add((i, *state[u][:2], "initial" if revision == 0 else "incremental"))
        elif k == "error":
            state[u] = (revision, run, False)
    assert guard == want and runs == want_runs
    assert sorted(once) == sorted({(u, k) for _, _, u, k in one + two})


def test_idle_users_are_forgotten(spark, feed):
    put, stream, at = feed
    put("a", [(1, 0, 1, "purchase"), (2, 1, 2, "purchase")])
    ev.run_once(ev.coalesced(stream()), at=at)
    put("b", [(3, 24 * 100, 2, "purchase")])  # moves the watermark past the first user's time
    ev.run_once(ev.coalesced(stream()), at=at)
    put("c", [(4, 24 * 101, 1, "purchase"), (5, 24 * 101, 2, "purchase")])
    got = {r.event_id: (r.revision, r.run_type) for r in ev.run_once(ev.coalesced(stream()), at=at).collect()}
    assert got[4] == (1, "initial")  # nothing is known of user 1 any more
    assert got[1] == got[2] == (1, "initial") and got[5][0] > 1
