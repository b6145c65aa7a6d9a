import random

import pytest
from pyspark.sql import functions as F

from scholia.functions import text
from scholia.operators import joins
from scholia.plans import recovery


@pytest.fixture(scope="module")
def sides():
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abé𝒳") for _ in range(n))
    left = [(i, i % 3, word(rng.randrange(1, 40))) for i in range(80)] + [(90, 0, ""), (91, 1, None), (92, 1, "a" * 3000)]
    right = []
    for i in range(120):
        x = rng.choice(left[:80])[2]
        cut = rng.randrange(len(x) + 1)
        right.append((1000 + i, i % 3, rng.choice([x[:cut] + word(rng.randrange(6)), word(3) + x + word(2), x[cut // 2 : cut], word(9)])))
    return left, right + [(1200, 1, "a" * 2000), (1201, 1, ""), (1202, 0, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, k int, t string").repartition(3)


def beginning(x, y):
    n = 0
    while n < min(len(x), len(y)) and x[n] == y[n]:
        n += 1
    return n


def test_contained_join_finds_every_pair_once(spark, sides):
    left, right = sides
    got = sorted((r.id, r.r_id) for r in joins.contained_join(frame(spark, left), frame(spark, right), ["k"], "t").collect())
    assert got == sorted((i, j) for i, k, x in left for j, m, y in right if k == m and x and y and x in y) and len(got) > 20


@pytest.mark.parametrize("least", [0.4, 0.75, 1.0])
def test_clear_beginning(spark, sides, least):
    left, right = sides
    want = []
    for i, k, x in left:
        scores = sorted(((1.0 if x in y or y in x else beginning(x, y) / min(len(x), len(y)), -j) for j, m, y in right if k == m and x and y), reverse=True)
        if scores and scores[0][0] >= least and scores[0][0] > (scores[1][0] if len(scores) > 1 else 0) + 0.1:
            want.append((i, -scores[0][1], round(scores[0][0], 9)))
    got = [(r.id, r.r_id, round(r.score, 9)) for r in joins.clear_beginning(frame(spark, left), frame(spark, right), ["k"], "t", least).collect()]
    assert sorted(got) == sorted(want) and want


def test_evidence_by_index_gives_what_all_pairs_give(spark):
    rng = random.Random(6)
    words = ["river", "stone", "planet", "of", "garden", "x1", "market", "quiet", "harbour"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    qs = [(i, i % 2, i % 4, i % 3, say(rng.randrange(1, 7))) for i in range(60)] + [(100, 0, 0, 0, None), (101, 0, 0, 0, "ab")]
    rs = [(1000 + i, i % 2, i % 4, i % 3, say(rng.randrange(1, 9))) for i in range(70)] + [(1100, 0, 0, 0, None)]
    kind = "id long, session int, question_no int, set_no int, {} string"
    q, r = spark.createDataFrame(qs, kind.format("stem")), spark.createDataFrame(rs, kind.format("text"))
    a, b = joins._aliased(q, r)
    every = a.join(b, (F.col("session") == F.col("r_session")) & (F.col("question_no") == F.col("r_question_no")) & joins.tolerant(F.col("set_no"), F.col("r_set_no")))
    scores = {}
    for x in every.select("id", "r_id", text.evidence_score(F.col("stem"), F.col("r_text")).alias("s")).collect():
        scores.setdefault(x.id, []).append((x.s or 0, x.r_id))
    want = sorted((i, j, s) for i, found in scores.items() for s, j in [max(found)] if s >= 36 and sum(t == s for t, _ in found) == 1)
    got = sorted((x.id, x.answer_id, x.score) for x in recovery.evidence_links(q, r).collect())
    assert got == want and want
