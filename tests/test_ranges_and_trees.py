import random

import pytest

from scholia.operators import ranges, trees, windows
from scholia.plans import recovery

ENTRY = "id long, document_id long, section_scope string, question_no int, page_start int, page_end int, marker_top int, question_type string, set_no int"


def repaired(rows):
    out, last = {}, None
    for r in sorted(rows, key=lambda r: (r[1], r[4], r[6], r[0])):
        i, doc, scope, no, start, end, _, kind, group = r
        if last and last[0] == doc and scope == last[1] and no == last[2] + 1 and start <= last[3] + 1:
            kind, group = last[4:]
        out[i] = (kind, group)
        last = (doc, scope, no, end, kind, group)
    return out


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_runs_go_on_over_ranges(spark, small_ranges):
    rng = random.Random(3)
    rows, no = [], 0
    for i in range(4000):
        no = no + 1 if rng.random() < 0.995 else rng.randrange(50)
        rows.append((i, 1, rng.choice(["a"] * 200 + ["b", None]), no, i // 3, i // 3 + i % 2, i % 3, rng.choice("xyz"), rng.randrange(4)))
    rows += [(5000 + i, 2 + i % 4, "a", i // 4, i // 4, i // 4, 0, rng.choice("xyz"), i % 5) for i in range(200)] + [(9000, 77, None, 1, 1, 1, 0, "x", 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, ENTRY).repartition(6)
    parts = ranges.ranged(df, ["document_id", "page_start", "marker_top", "id"]).where("document_id = 1").select("__part").distinct().count()
    assert parts > 1  # one document fills several ranges
    got = {r.id: (r.question_type, r.set_no) for r in windows.repair_types(df).collect()}
    assert got == repaired(rows)
    assert windows.repair_types(df.where("false")).count() == 0


def test_numbering(spark, small_ranges):
    keys = random.Random(1).sample(range(-(10**12), 10**12), 3000)
    got = {r.k: r.n for r in ranges.numbered(spark.createDataFrame([(k,) for k in keys], "k long").repartition(5), ["k"], "n", 17).collect()}
    assert got == {k: 18 + i for i, k in enumerate(sorted(keys))}
    assert ranges.numbered(spark.createDataFrame([], "k long"), ["k"], "n").count() == 0


def test_trees_of_any_depth(spark):
    rng = random.Random(2)
    nodes = [(f"n{i}", None if i % 40 == 0 else f"n{i - rng.choice([1, 1, 1, 2, 5])}" if i % 40 > 5 else f"n{i - i % 40}", f"name {i % 7}", i % 3) for i in range(200)]
    nodes += [("o1", "gone", "orphan", 1), ("o2", "o1", "below", 1), ("r1", "r2", "ring", 0), ("r2", "r1", "ring", 0), ("r3", "r1", "under a ring", 0)]
    leaves = [(rng.choice(nodes)[0], rng.randrange(5)) for _ in range(300)] + [("nowhere", 3)]
    parent = {i: p for i, p, _, _ in nodes}
    info = {i: (name, order) for i, _, name, order in nodes}
    parent = {i: p if p in parent else None for i, p in parent.items()}

    def up(i):
        out = [i]
        while parent[out[-1]] is not None and len(out) < 300:
            out.append(parent[out[-1]])
        return out

    ways = {i: up(i) for i in parent if i[0] != "r"}
    total = dict.fromkeys(ways, 0)
    for node, n in leaves:
        for a in ways.get(node, []):
            total[a] += n
    siblings = {}
    for i in ways:
        siblings.setdefault(parent[i], []).append((info[i][1], i))
    want = {(i, parent[i], len(w), tuple(info[a][0] for a in reversed(w)), sorted(siblings[parent[i]]).index((info[i][1], i)) + 1, total[i]) for i, w in ways.items()}
    found = trees.tree(spark.createDataFrame(nodes, "id string, parent string, name string, sort_order int"), spark.createDataFrame(leaves, "node string, n long"))
    assert {(r.id, r.parent, r.level, tuple(r.path), r.place, r.leaves) for r in found.collect()} == want
    assert max(len(w) for w in ways.values()) > 8


def test_uploads(spark):
    chunks = [(1, 1, "b"), (1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (3, 0, "a"), (3, 1, "x"), (1, 9, "beyond"), (5, -1, "z")]
    announced = [(1, 2, 3), (2, 2, 3), (3, 2, 9), (4, 1, 0), (5, 0, 0)]
    got = recovery.reassemble(spark.createDataFrame(chunks, "doc_id long, i int, chunk string"), spark.createDataFrame(announced, "doc_id long, n int, size long"))
    assert {r.doc_id: (r.state, r.n_bytes) for r in got.collect()} == {1: ("whole", 3), 2: ("incomplete", None), 3: ("wrong_size", None), 4: ("incomplete", None), 5: ("whole", None)}
