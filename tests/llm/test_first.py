import random
import re
from collections import Counter

import pytest
from scholia.llm import decontaminate, simhash, toxicity

import brute

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in rows], KIND)


def words(rng, n, v=30):
    return " ".join(f"W{rng.randrange(v)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "one two"), (None, "one two"), (6, "x" * 5000), (-7, "ONE TWO"), (8, "é É ÉÉ"), (8, "é É ÉÉ"), (9, "\x00 nul")]
    for i in range(20, 60):
        base = words(rng, rng.randrange(3, 60))
        out += [(i * 3, base), (i * 3 + 1, base + " w1"), (i * 3 + 2, base.replace("W1", "W2", 1))]
    return out


def test_simhash_matches_brute_force(spark, rows):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_groups(table(spark, rows)).collect()}
    prints = [(i, brute.simhash(t)) for i, t in rows]
    want = {(i, f"{p:016x}"): c for (i, p), c in zip(prints, brute.groups(prints))}
    assert got == want


def test_forest_keeps_components():
    import numpy as np

    rng = random.Random(1)
    base = rng.getrandbits(64)
    prints = sorted({base ^ sum(1 << b for b in rng.sample(range(16), rng.randrange(5))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(20)})
    want = brute.groups(list(enumerate(prints)))
    edges = simhash.forest(np.array(prints, np.uint64), simhash.pivots(), 2)
    at = {p: i for i, p in enumerate(prints)}
    root = list(range(len(prints)))
    for a, b in edges:
        x, y = root[at[a]], root[at[b]]
        root = [min(x, y) if r in (x, y) else r for r in root]
    assert root == want


def test_dense_clusters_link(spark):
    rng = random.Random(2)
    base = rng.getrandbits(63)
    prints = sorted({base ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(4))) for _ in range(400)})
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    from scholia.llm.common import components

    got = {r.node: r.component for r in components(simhash.links(df)).collect()}
    want = brute.groups([(p, p) for p in prints])
    assert [got.get(p, p) for p in prints] == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], KIND)
    assert simhash.near_groups(none).count() == 0
    assert simhash.keep_texts(none).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(none, items).count() == 0
    one = table(spark, [(1, "a b c")])
    assert not decontaminate.contamination(one, items).first().contaminated


def test_pipeline_judges_each_row_by_its_own_text(spark):
    import corpus_pipeline

    rng = random.Random(9)
    base, alone, other, third = (words(rng, 300, 5000) for _ in range(4))
    w = base.split()
    near = " ".join(w[:150] + ["zzz"] + w[151:])
    data = [(5, base), (6, near), (6, alone), (8, other), (8, "other"), (8, "other"), (None, base.upper()), (None, third), (None, third), (9, None), (10, "")]
    want = [(5, base), (6, alone), (8, other), (8, "other"), (None, third), (9, None)]
    docs = table(spark, data)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, want))


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(4)
    shared = [f"t{i}" for i in range(350)]
    data = []
    for i in range(60):  # strangers that share a template, at 0.77, and a near copy of each at 0.87 or more
        own = [f"x{i}n{j}" for j in range(50)]
        data += [(rng.randrange(10**6), " ".join(shared + own)), (rng.randrange(10**6), " ".join(shared + own[:26 + i % 20] + [f"y{i}n{j}" for j in range(24 - i % 20)]))]
    for i in range(40):
        w = words(rng, rng.randrange(8, 90), 400).split()
        data += [(rng.randrange(10**6), " ".join(w)), (rng.randrange(10**6), " ".join(w[:-2])), (rng.randrange(10**6), " ".join(w[3:]))]
    data = list(dict(data).items())
    sets = [{tuple(t.lower().split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))} for _, t in data]
    root = {i: i for i, _ in data}
    for x, (a, _) in enumerate(data):
        for y in range(x):
            n = len(sets[x] & sets[y])
            if n >= 0.8 * (len(sets[x]) + len(sets[y]) - n):
                low, high = sorted((root[a], root[data[y][0]]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert 60 < len(set(root.values())) < len(data)
    assert dict(map(tuple, simhash.near_duplicates(table(spark, data)).collect())) == root
    # candidates that the cheap round misses altogether: the second finds them alone
    assert dict(map(tuple, simhash.near_duplicates(table(spark, data), tables=1, features=200).collect())) == root


def test_contamination_matches_brute_force(spark, rows, monkeypatch):
    rng = random.Random(3)
    items = [(1, words(rng, 25, 8)), (2, words(rng, 12, 8)), (3, "alpha, beta; Gamma"), (4, "solo"), (5, ""), (6, None), (30, words(rng, 10, 3)), (30, "alpha beta gamma"), (31, "absent words only")]
    docs = list(rows) + [(200, "x " + items[0][1] + " y"), (201, "pre " + " ".join(items[0][1].split()[3:15]).upper() + "! post"), (202, "alpha -- beta gamma solo"), (203, " ".join([words(rng, 40, 3), items[6][1], items[6][1]])), (204, words(rng, 400, 8)), (204, "solo")]
    got = sorted(map(repr, (tuple(r) for r in decontaminate.contamination(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect())))
    assert got == sorted(repr((i, *brute.contamination(t, items))) for i, t in docs)
    monkeypatch.setattr(decontaminate, "BROADCAST_TERMS", 3)  # beyond it terms meet by joins
    assert got == sorted(map(repr, (tuple(r) for r in decontaminate.contamination(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect())))
    clean = decontaminate.keep_clean(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == table(spark, docs).columns
    assert clean.count() == sum(not brute.contamination(t, items)[-1] for _, t in docs)


def test_proximity_matches_brute_force(spark):
    rng = random.Random(13)
    items = [(i, words(rng, rng.randrange(1, 14), 60)) for i in range(12)] + [(12, None), (13, ""), (None, "w1 w2"), (3, "w1 w2 w3")]
    docs = [(i, words(rng, rng.randrange(0, 120), 60)) for i in range(40)] + [(90, "x " + items[5][1]), (91, " ".join(reversed(items[6][1].split()))), (92, None), (93, "")]
    split = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.ascii_lower(x or ""))
    total = Counter(w for _, t in docs for w in split(t))
    own = {}
    for i, t in items:
        if i is not None:
            own.setdefault(i, set()).update(split(t))
    want = []
    for span, rare, least in [(10, 4, 3)]:
        for i, terms in own.items():
            chosen = sorted((w for w in terms if total[w]), key=lambda w: (total[w], w.encode()))[:rare]
            for d, t in docs:
                w = split(t)
                found = [(len({x for x in w[a : a + span] if x in chosen}), -a) for a in range(len(w)) if w[a] in chosen]
                if terms and found and max(found)[0] >= min(least, len(terms)):
                    want.append((d, i, max(found)[0], -max(found)[1]))
    got = decontaminate.proximity(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"), 10, 4, 3).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 20
    assert {(90, 5), (91, 6)} <= {(d, i) for d, i, _, _ in want}


def test_segments_are_maximal():
    import numpy as np

    s = np.array([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5], float)
    assert toxicity.segments(s, 0) == [(0, 1, 4.0), (2, 3, 3.0), (4, 11, 7.0)]
    assert toxicity.segments(np.array([]), 0) == []
    rng = np.random.Generator(np.random.PCG64(2))
    for _ in range(60):
        s = rng.integers(-4, 4, rng.integers(1, 14)).astype(float)
        assert toxicity.segments(s, 0) == sorted(plain_segments(s.tolist(), 0, len(s)))


def plain_segments(s, low, high):
    """The best stretch (of equals the shortest, then the first), then those left and right of it."""
    every = [(-sum(s[a:b]), b - a, a, b) for a in range(low, high) for b in range(a + 1, high + 1)]
    if not every or min(every)[0] >= 0:
        return []
    worth, _, a, b = min(every)
    return [(a, b, -worth), *plain_segments(s, low, a), *plain_segments(s, b, high)]


def test_several_passages_count_together():
    model = toxicity.Model({b"bad": 3.0}, 1.0, 1.0, -1.0, 1.0)
    one = model.read(b"bad " + b"x " * 20)[2]
    many = model.read((b"bad bad " + b"x " * 20) * 4)
    assert len(many[1]) == 4 and many[2] > 0.7 > 0.5 > one
    assert model.read(b"")[1:] == ([], model.probability([], 0))


def test_toxicity_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    from scholia.llm.common import remainder

    model = toxicity.learn(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(remainder(5) == 0).select("score", "toxic").collect()
    right = sum((r.score >= 0.5) == (r.toxic == 1) for r in rows)
    assert len(rows) > 50 and right / len(rows) > 0.95
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "idiot " * 30)], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    empty = toxicity.learn(spark.createDataFrame([], KIND), labels.where("toxic > 5"))
    assert toxicity.score(spark.createDataFrame([], KIND), empty).count() == 0
    none = toxicity.learn(docs, labels.where("toxic = 0"))
    assert {round(r.score, 6) for r in toxicity.score(odd, none).collect()} == {0.268941}
