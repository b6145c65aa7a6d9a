import random
from collections import Counter

from scholia.operators import shared_grams
from scholia.plans import wrong_import as wi


def test_counts_are_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(2)
    say = lambda n: "".join(rng.choice("abc教𝒳") for _ in range(n))
    drafts = [(i % 2, i, say(rng.randrange(0, 14)), i % 3 == 0) for i in range(700)]
    entries = [(i % 2, i, say(rng.randrange(0, 9)), i % 4 == 0) for i in range(40)]
    d, e = spark.createDataFrame(drafts, "upload long, draft long, key string, material boolean"), spark.createDataFrame(entries, "upload long, entry long, body string, heading boolean")
    grams = lambda t: Counter(t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1))
    own = {i: grams(k) for _, i, k, _ in drafts}
    want = {(u, i, j, sum(m for g, m in grams(b).items() if g in own[j]), x, h) for u, i, b, h in entries for v, j, _, x in drafts if u == v}
    got = shared_grams.counted(d, e, 4)
    assert sorted(map(tuple, got.collect())) == sorted(w for w in want if w[3] >= 4)


def test_entries_whose_best_are_too_many_are_left_out(spark):
    rows = [(1, e, d, 0.96, False, True) for e in range(3) for d in range(9)] + [(1, 5, d, 0.99 if d == 3 else 0.9, False, True) for d in range(9)] + [(1, 6, d, 0.99, d == 7, True) for d in range(9)]
    scores = spark.createDataFrame(rows, "upload long, entry long, draft long, score double, exact boolean, ok boolean")
    kept = wi._that_count(scores, 0.015)
    assert sorted({r.entry for r in kept.collect()}) == [5, 6] and kept.where("entry = 5").count() == 5
    assert {(r.entry, r.draft) for r in wi.match_entries(scores).collect()} == {(5, 3), (6, 7)}
