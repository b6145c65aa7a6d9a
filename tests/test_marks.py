import random

from pyspark.sql import functions as F

from scholia.operators import joins, marks


def test_marks_meet_and_are_few(spark):
    rng = random.Random(8)
    long = ["".join(rng.choice("abcd教𝒳") for _ in range(4000)) for _ in range(3)] + ["ab" * 1500, "x"]
    cut = [(i, long[i % 5][a : a + n]) for i, (a, n) in enumerate((rng.randrange(3000), rng.choice([1, 2, 3, 4, 7, 8, 40, 63, 64, 700])) for _ in range(60))]
    stacks = spark.createDataFrame(list(enumerate(long)), "p long, __t string").withColumn("__ns", F.array(*map(F.lit, (0, 1, 2, 4, 8, 16, 32, 256))))
    needles = marks.of_needles(spark.createDataFrame(cut, "q long, __t string"))
    held = marks.of_stacks(stacks)
    met = {(r.q, r.p) for r in needles.join(held, ["n", "g"]).select("q", "p").collect()}
    assert {(i, j) for i, t in cut for j, u in enumerate(long) if t and t in u} <= met
    assert needles.count() == sum(bool(t) for _, t in cut)
    assert held.where("n = 16 and p = 0").count() < 4000 / 6 and held.where("n = 256 and p = 0").count() < 40  # all grams were 3985 and 3745


def test_contained_texts_once_for_all_copies(spark):
    rows = [(1, "abcabcabd"), (1, "bcabd"), (2, "bcabd"), (1, "bcabd"), (1, "zz")]
    d = spark.createDataFrame(rows, "k int, t string").distinct()
    names = {r["h"]: r["t"] for r in d.select(F.xxhash64("t").alias("h"), "t").collect()}
    assert [(r.k, names[r.needle], names[r["stack"]]) for r in joins.contained_texts(d, d, ["k"], "t").collect()] == [(1, "bcabd", "abcabcabd")]


def test_clear_beginning_forms_no_pairs_of_a_common_beginning(spark):
    same = "a beginning that all of them have in common, "
    left = spark.createDataFrame([(i, 1, f"{same}left {i:05d}") for i in range(1500)] + [(5000, 1, "quite another text of some length")], "id long, k int, t string")
    right = spark.createDataFrame([(i, 1, f"{same}right {i:05d}") for i in range(1500)] + [(6000, 1, "quite another text of some")], "id long, k int, t string")
    df = joins.clear_beginning(left, right, ["k"], "t")
    assert [(r.id, r.r_id, r.score) for r in df.collect()] == [(5000, 6000, 1.0)]
    made = [0]

    def walk(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            return walk(node.plan())
        m = node.metrics().get("numOutputRows")
        if "Join" in node.nodeName() and m.isDefined():
            made.append(m.get().value())
        kids = node.children()
        for i in range(kids.size()):
            walk(kids.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    assert 0 < max(made) < 400_000  # 2,250,000 pairs share the beginning
