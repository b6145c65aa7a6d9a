"""Learning statistics of all users at one as-of time, the latest attempt."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.adapters import Source
from scholia.functions.numbers import damped, percent, ratio, round1
from scholia.operators import sets, trees, windows
from scholia.registry import query


def daily(attempts: DataFrame) -> DataFrame:
    """(user_id, stat_date): additive counters, one row a user and day."""
    return attempts.groupBy("user_id", F.to_date("created_at").alias("stat_date")).agg(
        F.count("*").alias("question_count"), F.sum("is_correct").alias("correct_count"), F.sum(1 - F.col("is_correct")).alias("wrong_count"), F.sum("duration_ms").alias("duration_ms")
    )


_DAILY = """daily AS (SELECT user_id, CAST(created_at AS DATE) AS stat_date, count(*) AS question_count, sum(is_correct) AS correct_count, sum(1 - is_correct) AS wrong_count, sum(duration_ms) AS duration_ms FROM attempts GROUP BY ALL)"""


@query("mut1_daily_rollup", f", {_DAILY} SELECT user_id, CAST(stat_date AS VARCHAR) AS stat_date, question_count, CAST(correct_count AS BIGINT) AS correct_count, CAST(wrong_count AS BIGINT) AS wrong_count, CAST(duration_ms AS BIGINT) AS duration_ms FROM daily")
def daily_rollup(s: Source) -> DataFrame:
    return daily(s.attempts()).withColumn("stat_date", F.col("stat_date").cast("string"))


def mastery(attempts: DataFrame, questions: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of a user and question are added up before they meet the question, so the join sees each pair once."""
    each = attempts.groupBy("user_id", "question_id").agg(F.count("*").alias("n"), F.sum("is_correct").alias("right"))
    joined = each.join(questions.select("question_id", *keys), "question_id")
    g = joined.groupBy("user_id", *keys).agg(F.sum("n").alias("attempts"), F.sum("right").alias("correct"))
    acc = ratio(F.col("correct"), F.col("attempts")) * 100
    return g.select("user_id", *keys, "attempts", "correct", round1(acc).alias("accuracy"), round1(damped(acc, F.col("attempts"))).alias("mastery_score"))


_MASTERY = """SELECT user_id, {k}, attempts, CAST(correct AS BIGINT) AS correct, floor(correct / attempts * 100 * 10 + 0.5) / 10 AS accuracy{m}
FROM (SELECT user_id, {k}, count(*) AS attempts, sum(is_correct) AS correct FROM attempts JOIN questions USING (question_id) GROUP BY ALL)"""
_DAMPED = ", floor(CASE WHEN attempts < 5 THEN correct / attempts * 100 * attempts / 5 ELSE correct / attempts * 100 END * 10 + 0.5) / 10 AS mastery_score"


@query("sta3_chapter_mastery", _MASTERY.format(k="subject, chapter", m=_DAMPED))
def chapter_mastery(s: Source) -> DataFrame:
    """All users' at once; who shows one user's sorts them by subject and chapter."""
    return mastery(s.attempts(), s.questions(), ["subject", "chapter"])


@query("sta4_subject_mastery", _MASTERY.format(k="subject", m=""))
def subject_mastery(s: Source) -> DataFrame:
    return mastery(s.attempts(), s.questions(), ["subject"]).drop("mastery_score")


@query("sta4_unclassified_attempts", "SELECT user_id, count(*) AS unclassified FROM attempts ANTI JOIN (SELECT question_id FROM questions WHERE status = 'published') USING (question_id) GROUP BY user_id")
def unclassified(s: Source) -> DataFrame:
    """Attempts that no mastery report of published questions counts: those at drafts, and at questions that are gone."""
    return s.attempts().join(s.questions().where("status = 'published'"), "question_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("unclassified"))


def streak(days: DataFrame, now: DataFrame) -> DataFrame:
    """days: (user_id, stat_date), one row each; now: (as_of), one row."""
    d = days.select("user_id", F.col("stat_date").alias("day")).join(F.broadcast(now)).withColumn("today", F.to_date("as_of")).drop("as_of")  # one row
    return windows.streaks(d, ["user_id", "today"], "day", F.col("today")).drop("today")


_STREAK = """days AS (SELECT DISTINCT user_id, CAST(created_at AS DATE) AS d FROM attempts),
runs AS (SELECT user_id, g, max(d) AS last, count(*) AS n FROM (SELECT user_id, d, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INTEGER) AS g FROM days) GROUP BY user_id, g),
streaks AS (SELECT user_id, arg_max(n, last) AS streak_days FROM runs, now WHERE last >= CAST(as_of AS DATE) - 1 GROUP BY user_id)"""


@query("sta7_streak", f", {_STREAK} SELECT user_id, streak_days FROM streaks")
def streaks(s: Source) -> DataFrame:
    return streak(daily(s.attempts()), s.as_of())


@query("win10_islands", f", {_STREAK} SELECT user_id, CAST(last AS VARCHAR) AS run_end, n AS size FROM runs")
def day_islands(s: Source) -> DataFrame:
    d = s.attempts().select("user_id", F.datediff(F.to_date("created_at"), F.lit("1970-01-01")).alias("n")).distinct()
    return windows.islands(d, ["user_id"], "n").select("user_id", F.date_add(F.lit("1970-01-01").cast("date"), F.col("island_end")).cast("string").alias("run_end"), "size")


@query(
    "sta1_overview",
    f""", {_DAILY}, {_STREAK},
    totals AS (SELECT user_id, sum(question_count) AS q, sum(correct_count) AS c,
      coalesce(sum(question_count) FILTER (WHERE stat_date = CAST(as_of AS DATE)), 0) AS tq, coalesce(sum(correct_count) FILTER (WHERE stat_date = CAST(as_of AS DATE)), 0) AS tc
      FROM daily, now GROUP BY user_id),
    book AS (SELECT user_id, count(*) AS w, count(*) FILTER (WHERE next_review_at <= as_of) AS due FROM wrong, now GROUP BY user_id)
    SELECT user_id, CAST(tq AS BIGINT) AS today_count, CAST(tc AS BIGINT) AS today_correct, CASE WHEN tq > 0 THEN floor(tc / tq * 1000 + 0.5) / 10 ELSE 0 END AS today_accuracy,
      CAST(q AS BIGINT) AS total_count, floor(c / q * 1000 + 0.5) / 10 AS accuracy, coalesce(w, 0) AS wrong_count, coalesce(due, 0) AS due_count, coalesce(streak_days, 0) AS streak_days
    FROM totals LEFT JOIN book USING (user_id) LEFT JOIN streaks USING (user_id)""",
)
def overview(s: Source) -> DataFrame:
    """Totals and streaks come from one daily table, whose shuffle Spark runs once; the as-of time is asked for once, for all three."""
    moment = s.spark.createDataFrame([tuple(s.as_of().first())], "as_of timestamp")
    days, now = daily(s.attempts()), F.broadcast(moment)  # one row
    today = F.col("stat_date") == F.to_date("as_of")
    total = days.join(now).groupBy("user_id").agg(
        F.coalesce(F.sum(F.when(today, F.col("question_count"))), F.lit(0)).alias("today_count"), F.coalesce(F.sum(F.when(today, F.col("correct_count"))), F.lit(0)).alias("today_correct"),
        F.sum("question_count").alias("total_count"), F.sum("correct_count").alias("c"),
    )
    book = s.wrong().join(now).groupBy("user_id").agg(F.count("*").alias("wrong_count"), F.count_if(F.col("next_review_at") <= F.col("as_of")).alias("due_count"))
    x = total.join(book, "user_id", "left").join(streak(days, moment), "user_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return x.select(
        "user_id", "today_count", "today_correct", percent(F.col("today_correct"), F.col("today_count")).alias("today_accuracy"), "total_count",
        percent(F.col("c"), F.col("total_count")).alias("accuracy"), z("wrong_count"), z("due_count"), z("streak_days"),
    )


_SPINE = "spine AS (SELECT user_id, CAST(unnest(generate_series(CAST(as_of AS DATE) - {n} + 1, CAST(as_of AS DATE), INTERVAL 1 DAY)) AS DATE) AS stat_date FROM (SELECT DISTINCT user_id FROM {t}), now)"


@query(
    "sta2_trend",
    f""", {_DAILY}, {_SPINE.format(n=14, t="attempts")}
    SELECT user_id, CAST(stat_date AS VARCHAR) AS stat_date, coalesce(question_count, 0) AS question_count, CAST(coalesce(correct_count, 0) AS BIGINT) AS correct_count, CAST(coalesce(wrong_count, 0) AS BIGINT) AS wrong_count
    FROM spine LEFT JOIN daily USING (user_id, stat_date)""",
)
def trend(s: Source) -> DataFrame:
    d = daily(s.attempts()).join(F.broadcast(s.as_of().select(F.to_date("as_of").alias("today"))))
    out = windows.spine(d, ["user_id", "today"], "stat_date", ["question_count", "correct_count", "wrong_count"], F.col("today"), 14)
    return out.drop("today").orderBy("user_id", F.desc("stat_date")).withColumn("stat_date", F.col("stat_date").cast("string"))


@query(
    "sta5_wrong_trend",
    f""", bad AS (SELECT user_id, CAST(created_at AS DATE) AS stat_date, count(*) AS wrong_count FROM attempts WHERE is_correct = 0 GROUP BY ALL), {_SPINE.format(n=30, t="bad")}
    SELECT user_id, CAST(stat_date AS VARCHAR) AS stat_date, coalesce(wrong_count, 0) AS wrong_count FROM spine LEFT JOIN bad USING (user_id, stat_date)""",
)
def wrong_trend(s: Source) -> DataFrame:
    bad = s.attempts().where("is_correct = 0").groupBy("user_id", F.to_date("created_at").alias("stat_date")).agg(F.count("*").alias("wrong_count"))
    bad = bad.join(F.broadcast(s.as_of().select(F.to_date("as_of").alias("today"))))
    return windows.spine(bad, ["user_id", "today"], "stat_date", ["wrong_count"], F.col("today"), 0).drop("today").withColumn("stat_date", F.col("stat_date").cast("string"))


@query(
    "sta6_weak_points",
    """, top AS (SELECT user_id, question_id, wrong_count, knowledge_points_json FROM wrong JOIN questions USING (question_id)
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY wrong_count DESC, question_id) <= 10)
    SELECT user_id, question_id, unnest(CAST(knowledge_points_json AS VARCHAR[])) AS knowledge_point, wrong_count FROM top""",
)
def weak_points(s: Source) -> DataFrame:
    """The ten most failed questions of each user first, then their knowledge points."""
    w = s.wrong().join(s.questions().select("question_id", "knowledge_points_json"), "question_id")
    top = w.withColumn("k", F.row_number().over(windows.W.partitionBy("user_id").orderBy(F.desc("wrong_count"), "question_id"))).where("k <= 10")
    return top.select("user_id", "question_id", F.explode(F.from_json("knowledge_points_json", "array<string>")).alias("knowledge_point"), "wrong_count")


@query("sta6_weak_points_aggregated", "SELECT user_id, p AS knowledge_point, CAST(sum(wrong_count) AS BIGINT) AS wrong_count FROM (SELECT user_id, wrong_count, unnest(CAST(knowledge_points_json AS VARCHAR[])) AS p FROM wrong JOIN questions USING (question_id)) GROUP BY ALL")
def weak_points_total(s: Source) -> DataFrame:
    w = s.wrong().join(s.questions().select("question_id", "knowledge_points_json"), "question_id")
    return w.select("user_id", "wrong_count", F.explode(F.from_json("knowledge_points_json", "array<string>")).alias("knowledge_point")).groupBy("user_id", "knowledge_point").agg(F.sum("wrong_count").alias("wrong_count"))


@query("agg18_agg19_latency_quantiles", """SELECT user_id, v[len(v) // 2 + 1] AS upper_median, v[greatest((3 * len(v) + 3) // 4, 1)] AS p75
    FROM (SELECT user_id, list_sort(list(duration_ms)) AS v FROM (SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY attempt_id DESC) <= 20) GROUP BY user_id)""")
def latencies(s: Source) -> DataFrame:
    return sets.upper_median_recent(s.attempts(), ["user_id"], [F.desc("attempt_id")], "duration_ms")


@query("agg4_agg5_conditional_sums", """SELECT user_id, count(*) AS n, CAST(coalesce(sum(CASE WHEN is_correct = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS good, count(CASE WHEN duration_ms > 300 THEN 1 END) AS slow,
    count(DISTINCT question_id) AS distinct_questions, CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS total_ms, CAST(min(created_at) AS VARCHAR) IS NOT NULL AS seen FROM attempts GROUP BY user_id""")
def conditional_sums(s: Source) -> DataFrame:
    return s.attempts().groupBy("user_id").agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("is_correct") == 1, 1).otherwise(0)), F.lit(0)).alias("good"), F.count(F.when(F.col("duration_ms") > 300, 1)).alias("slow"),
        F.count_distinct("question_id").alias("distinct_questions"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("total_ms"), F.min("created_at").isNotNull().alias("seen"),
    )


@query("agg2_agg3_status_pivot", """SELECT bank_id, count(*) FILTER (WHERE type = 'single_choice') AS single_choice, count(*) FILTER (WHERE type = 'multiple_choice') AS multiple_choice, count(*) FILTER (WHERE type = 'true_false') AS true_false,
    count(*) FILTER (WHERE status = 'published') AS published, count(*) FILTER (WHERE status = 'draft') AS draft FROM questions GROUP BY bank_id""")
def status_pivot(s: Source) -> DataFrame:
    one = lambda c, v: F.count_if(F.col(c) == v).alias(v)
    return s.questions().groupBy("bank_id").agg(*(one("type", v) for v in ("single_choice", "multiple_choice", "true_false")), *(one("status", v) for v in ("published", "draft")))


@query("agg12_mode", """SELECT user_id, question_id AS favourite, n FROM (SELECT user_id, question_id, count(*) AS n, max(created_at) AS last FROM attempts GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, last DESC, question_id) = 1""")
def mode(s: Source) -> DataFrame:
    g = s.attempts().groupBy("user_id", "question_id").agg(F.count("*").alias("n"), F.max("created_at").alias("last"))
    return windows.first_row(g, ["user_id"], [F.desc("n"), F.desc("last"), "question_id"]).select("user_id", F.col("question_id").alias("favourite"), "n")


@query("agg1_agg9_having", "SELECT question_id, count(*) AS n FROM attempts GROUP BY question_id HAVING count(*) >= 1")
def having(s: Source) -> DataFrame:
    return s.attempts().groupBy("question_id").agg(F.count("*").alias("n")).where("n >= 1")


@query("agg27_counters", "SELECT bank_id, name, coalesce(n, 0) AS question_count, coalesce(p, 0) AS published_count FROM banks LEFT JOIN (SELECT bank_id, count(*) AS n, count(*) FILTER (WHERE status = 'published') AS p FROM questions GROUP BY bank_id) USING (bank_id)")
def counters(s: Source) -> DataFrame:
    n = s.questions().groupBy("bank_id").agg(F.count("*").alias("question_count"), F.count_if(F.col("status") == "published").alias("published_count"))
    return s.banks().join(n, "bank_id", "left").select("bank_id", "name", F.coalesce("question_count", F.lit(0)).alias("question_count"), F.coalesce("published_count", F.lit(0)).alias("published_count"))


@query("tre1_tree", """, nodes AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent, r_name AS name, CAST(-r_regionkey AS BIGINT) AS sort_order FROM region
      UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, n_nationkey % 3 FROM nation UNION ALL SELECT DISTINCT 'm' || c_nationkey || c_mktsegment, 'n' || c_nationkey, c_mktsegment, 0 FROM customer
      UNION ALL SELECT 'c' || c_custkey, 'm' || c_nationkey || c_mktsegment, c_name, c_custkey % 7 FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || (s_nationkey + 15), s_name, s_suppkey % 4 FROM supplier),
    p AS (SELECT n.id, n.name, n.sort_order, q.id AS parent FROM nodes n LEFT JOIN nodes q ON n.parent = q.id), up AS (SELECT id, id AS anc, parent AS nxt, 0 AS d FROM p UNION ALL SELECT up.id, p.id, p.parent, d + 1 FROM up JOIN p ON up.nxt = p.id),
    l AS (SELECT anc AS id, count(*) AS leaves FROM orders JOIN up ON up.id = 'c' || o_custkey GROUP BY anc), t AS (SELECT up.id, count(*) AS level, string_agg(p.name, '/' ORDER BY d DESC) AS path FROM up JOIN p ON p.id = anc GROUP BY up.id)
    SELECT id, parent, CAST(level AS INTEGER) AS level, path, CAST(row_number() OVER (PARTITION BY parent ORDER BY sort_order, id) AS INTEGER) AS place, coalesce(leaves, 0) AS leaves FROM p JOIN t USING (id) LEFT JOIN l USING (id)""")
def tree(s: Source) -> DataFrame:
    """Regions, nations, their segments and customers as a tree of four levels, with orders as leaves; suppliers hang below nations, some of which don't exist."""
    c, key = s.table("customer"), lambda letter, *cols: F.concat(F.lit(letter), *(F.col(x).cast("string") for x in cols))
    node = lambda df, i, parent, name, order: df.select(i.alias("id"), parent.alias("parent"), F.col(name).alias("name"), order.cast("long").alias("sort_order"))
    parts = [
        node(s.table("region"), key("r", "r_regionkey"), F.lit(None).cast("string"), "r_name", -F.col("r_regionkey")), node(s.table("nation"), key("n", "n_nationkey"), key("r", "n_regionkey"), "n_name", F.col("n_nationkey") % 3),
        node(c.select("c_nationkey", "c_mktsegment").distinct(), key("m", "c_nationkey", "c_mktsegment"), key("n", "c_nationkey"), "c_mktsegment", F.lit(0)), node(c, key("c", "c_custkey"), key("m", "c_nationkey", "c_mktsegment"), "c_name", F.col("c_custkey") % 7),
        node(s.table("supplier"), key("s", "s_suppkey"), F.concat(F.lit("n"), (F.col("s_nationkey") + 15).cast("string")), "s_name", F.col("s_suppkey") % 4),
    ]
    leaves = s.table("orders").groupBy(key("c", "o_custkey").alias("node")).agg(F.count("*").alias("n"))
    found = trees.tree(reduce(DataFrame.unionByName, parts), leaves)
    return found.withColumn("path", F.array_join("path", "/"))
