"""Rules that the sample tables don't reach, on small rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from scholia.functions import grading, numbers, text
from scholia.operators import joins, sets, windows
from scholia.plans import wrong_import
from scholia.plans.recovery import explicit_answer
from scholia.sources import readers
from scholia.streaming.queue import call_health


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("kind", "correct", "given", "right"),
    [
        ("single_choice", ["B"], ["b"], True), ("single_choice", ["B"], ["A"], False), ("multiple_choice", ["A", "C"], ["C", "A"], True), ("multiple_choice", ["A", "C"], ["A"], False),
        ("multiple_choice", ["A", "A"], ["A"], False), ("fill_blank", ["Monitor", "监视器锁"], ["监视器锁"], True), ("fill_blank", ["Monitor"], ["Lock"], False), ("short_answer", ["x"], ["x"], False), ("single_choice", ["B"], [], False),
    ],
)
def test_grading(spark, kind, correct, given, right):
    array = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
    assert one(spark, grading.is_correct(F.lit(kind), array(correct), array(given))) is right


@pytest.mark.parametrize(
    ("wrong", "correct", "reviews", "mastery", "result", "check"),
    [
        (1, 0, 0, 0.0, "good", lambda r: r["interval_days"] == 1 and r["mastery"] == 10),
        (2, 1, 3, 60.0, "again", lambda r: r["interval_days"] <= 0.1 and r["mastery"] < 60 and r["status"] == "learning"),
        (1, 5, 5, 90.0, "easy", lambda r: r["status"] == "mastered" and r["mastery"] > 90),
    ],
)
def test_scheduler(spark, wrong, correct, reviews, mastery, result, check):
    now = F.lit("2024-01-30 00:00:00").cast("timestamp")
    assert check(one(spark, grading.review(F.lit(wrong), F.lit(correct), F.lit(reviews), F.lit(mastery), F.lit(3.0), F.lit(None).cast("timestamp"), F.lit(result), now)))


def test_clean_page(spark):
    raw = "第 3 页\na\x07b \t c \nsame line\nsame line\nx\nx\n　wide"
    assert one(spark, text.clean_page(F.lit(raw))) == "\nab c\nsame line\nx\nx\n wide"


def test_fragments(spark):
    assert one(spark, text.overlap(F.lit("the quick brown"), F.lit("browns"))) == 5
    assert one(spark, text.merge_fragments(F.lit("the quick brown"), F.lit("browns"))) == "the quick browns"
    assert one(spark, text.overlap(F.lit("a b"), F.lit("b c"))) == 2  # blanks don't count, so the longest suffix and prefix that agree hold one each
    assert one(spark, text.merge_fragments(F.lit(""), F.lit("b"))) == "b"
    assert one(spark, text.shared_grams(F.lit("abcd"), F.lit("abab"))) == 2


def test_markers(spark):
    assert one(spark, text.printed_markers(F.lit("1. a\n 12、 b\n1234. c\nx 3. d\n1.5 kg\n3, b\n4《x\n5（y\n0. z"))) == [1, 12, 3, 4, 5]


def test_keyword_wildcards(spark):
    assert one(spark, text.contains_folded(F.lit("Red Widget"), F.lit("d_W"))) is True
    assert one(spark, text.contains_folded(F.lit("RED \\ x"), F.lit("\\"))) is True


def test_cosine(spark):
    a = F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, numbers.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(spark, numbers.cosine(a, F.array(F.lit(1.0)))) is None


def test_unique_join_refuses_ambiguity(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, k string")
    right = spark.createDataFrame([(10, "a"), (20, "b"), (21, "b")], "id int, k string")
    on = F.col("k") == F.col("r_k")
    assert [(r["id"], r["r_id"]) for r in joins.unique_join(left, right, on, "id").collect()] == [(1, 10)]
    kept = {r["id"]: (r["r_id"], r["matches"]) for r in joins.left_unique_join(left, right, on, "id", "id").collect()}
    assert kept == {1: (10, 1), 2: (None, 2), 3: (None, 0)}


def test_overlap_join_once(spark):
    a = spark.createDataFrame([(1, "k", 1, 50)], "id int, k string, s int, e int")
    b = spark.createDataFrame([(2, "k", 40, 99), (3, "k", 51, 60), (4, None, 1, 9)], "id int, k string, s int, e int")
    assert [r["r_id"] for r in joins.overlap_join(a, b, "k", "s", "e").collect()] == [2]


def test_multiset_difference(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "x int") for v in ([1, 1, 2], [1, 3]))
    assert sorted((r["x"], r["n"]) for r in sets.multiset_difference(a, b, ["x"]).collect()) == [(1, 1), (2, 1)]


def test_intervals(spark):
    d = spark.createDataFrame([("k", 1, 9), ("k", 2, 3), ("k", 10, 11), ("k", 13, 13)], "k string, s int, e int")
    assert sorted((r["s"], r["e"]) for r in windows.merge_intervals(d, ["k"], "s", "e").collect()) == [(1, 11), (13, 13)]


def test_repair_types_feeds_on(spark):
    d = spark.createDataFrame(
        [(1, 1, "s", "essay", 2, 1, 1, 1, 1), (2, 1, "s", "single", 0, 2, 1, 1, 2), (3, 1, "s", "judge", 1, 3, 2, 2, 1), (4, 1, "t", "judge", 1, 4, 2, 2, 2)],
        "id long, document_id long, section_scope string, question_type string, set_no int, question_no long, page_start long, page_end long, marker_top int",
    )
    assert {r["id"]: (r["question_type"], r["set_no"]) for r in windows.repair_types(d).collect()} == {1: ("essay", 2), 2: ("essay", 2), 3: ("essay", 2), 4: ("judge", 1)}


def test_call_health(spark):
    at = lambda i: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i)
    calls = [(1, i, at(i), 1, 10) for i in range(10)] + [(2, i + 100, at(i * 100), 0, 10) for i in range(3)] + [(3, i + 200, at(i), 1, 70_000) for i in range(12)] + [(4, i + 300, at(i * 200), 0, 1) for i in range(4)]
    got = {r["attempt_id"]: (r["may_raise"], r["breaks"]) for r in call_health(spark.createDataFrame(calls, "user int, attempt_id long, created_at timestamp, is_correct int, duration_ms long"), "user").collect()}
    assert [k for k, v in got.items() if v[0]] == [9] and [k for k, v in got.items() if v[1]] == [102]


def test_explicit_answers(spark):
    cases = [
        ("12.ABD【解析】 why", 12, "multiple_choice", (["A", "B", "D"], "why")), ("12、a, c", 12, "single_choice", (["A", "C"], "")), ("13.B", 12, "single_choice", None), ("12.√ 解析：so", 12, "true_false", (["正确"], "so")),
        (" 12 错误", 12, "true_false", (["错误"], "")), ("12. 癸卯学制（解析）old", 12, "fill_in_blank", (["癸卯学制"], "old")), ("12.G", 12, "single_choice", None), ("A is right", 12, "single_choice", None), ("12.B", 0, "single_choice", None),
    ]
    rows = spark.createDataFrame([(i, a, n, k) for i, (a, n, k, _) in enumerate(cases)], "i int, a string, n long, k string")
    got = {r["i"]: r["x"] and (r["x"]["values"], r["x"]["analysis"]) for r in rows.select("i", explicit_answer(F.col("a"), F.col("n"), F.col("k")).alias("x")).collect()}
    assert got == {i: c[3] for i, c in enumerate(cases)}


def test_user_replies(spark):
    r = spark.createDataFrame([(1, "1.B 2.对 第3题 acb\n４ 无需答案；5. 癸卯"), (2, "1.D")], "session int, reply string")
    o = spark.createDataFrame([(1, i, 10 + i, k) for i, k in enumerate(("single_choice", "true_false", "multiple_choice", "essay", "single_choice"), 1)], "session int, seq int, draft int, kind string")
    assert {x["draft"]: (x["answer"], x["none_needed"]) for x in wrong_import.user_answers(r, o).collect()} == {11: ("B", False), 12: ("对", False), 13: ("ACB", False), 14: (None, True)}


def test_boundaries(spark):
    row = "struct<stem:string,kind:string,warnings:array<string>>"
    left, cases = ("what is the", "essay", []), [("（1）first part", 0.69), ("一、first part", 0.05), ("第 3 题 x", 0.05), ("，and so on", 0.91), ("Plain.", 0.69)]
    df = spark.createDataFrame([(i, left, (b, "essay", [])) for i, (b, _) in enumerate(cases)], f"i int, left {row}, right {row}")
    got = [r["x"] for r in df.select("i", F.round(wrong_import.boundary_score(F.lit(False)), 2).alias("x")).orderBy("i").collect()]
    assert got[1:3] == [0.05, 0.05] and got[0] > 0.9 and got[3] == 0.91 and got[4] == 0.59


def test_balanced_json():
    assert wrong_import.balanced('x {"a":"}{\\"","b":{}} }') == '{"a":"}{\\"","b":{}}'
    assert wrong_import.balanced('see ["]", [1]] ]', "[", "]") == '["]", [1]]'
    assert wrong_import.balanced("none") == "none" and wrong_import.balanced("{open") == "{open" and wrong_import.balanced(None) is None


def test_matching_is_greedy(spark):
    rows = [(1, 1, 7, 0.99), (1, 1, 8, 0.9), (1, 2, 7, 0.99), (1, 2, 8, 0.95), (1, 3, 9, 0.95), (1, 3, 6, 0.94), (1, 4, 5, 0.5)]
    scores = spark.createDataFrame([(*r, False, True) for r in rows], "upload long, entry long, draft long, score double, exact boolean, ok boolean")
    got = {(r["entry"], r["draft"]) for r in wrong_import.match_entries(scores).collect()}
    assert got == {(1, 7), (2, 8)}


def test_readers(spark, tmp_path):
    (tmp_path / "a.md").write_text("# a title that is long enough to count")
    (tmp_path / "b.md").write_text("x")
    t = {r["path"].rpartition("/")[2]: r["needs_ocr"] for r in readers.text_files(spark, str(tmp_path)).collect()}
    assert t == {"a.md": False, "b.md": True}

    def pages(data: bytes) -> list[str]:
        if data == b"x":
            raise ValueError("unreadable")
        return data.decode().split(" ", 1)

    d = readers.documents(spark, str(tmp_path), pages)
    assert sorted((r["page_no"], r["text"]) for r in d.collect()) == [(1, ""), (1, "#"), (2, "a title that is long enough to count")]
    assert readers.new_files(d, d.where("text = ''")).count() == 2
    units = spark.createDataFrame([(1, "completed", '{"items":[{"no":1},{"no":2}]}'), (2, "failed", '{"items":[{"no":3}]}'), (3, "completed", "broken")], "unit_id int, status string, output_json string")
    assert sorted(r["no"] for r in readers.unit_rows(units, "no:int").collect()) == [1, 2]
    v = readers.with_vectors(spark.createDataFrame([(1, "ab"), (2, None)], "doc_id int, text string"), lambda t: [[float(len(x))] for x in t])
    assert sorted((r["doc_id"], r["vector"]) for r in v.collect()) == [(1, [2.0]), (2, [0.0])]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, s int, e int")
    assert windows.merge_intervals(none, ["k"], "s", "e").count() == 0
    assert windows.islands(none, ["k"], "s").count() == 0
    assert sets.multiset_difference(none, none, ["k"]).count() == 0
