"""Question lists, practice selection, grading and the wrong book, for all users at one as-of time."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scholia.adapters import Source
from scholia.functions import grading, text
from scholia.functions.numbers import round1
from scholia.operators import joins, keyed, sets, windows
from scholia.registry import query
from scholia.session import scratch

CHOICE = ("single_choice", "multiple_choice", "true_false")
OPTIONS = "array<struct<key:string,content:string>>"


def playable(answer: bool = True, options: bool = True) -> Column:
    """At least one non-blank answer; choices also need an option with key and content. Text that is no JSON array counts as empty."""
    has_answer = F.coalesce(F.exists(F.from_json("answer_json", "array<string>"), lambda x: F.trim(x) != ""), F.lit(False))
    full = F.exists(F.from_json("options_json", OPTIONS), lambda o: (F.trim(F.coalesce(o["key"], F.lit(""))) != "") & (F.trim(F.coalesce(o["content"], F.lit(""))) != ""))
    has_options = ~F.col("type").isin(*CHOICE) | F.coalesce(full, F.lit(False))
    return (has_answer if answer else F.lit(True)) & (has_options if options else F.lit(True))


_PLAYABLE = """(regexp_matches(coalesce(answer_json, ''), '"[^" ]+"') AND (type NOT IN ('single_choice', 'multiple_choice', 'true_false') OR regexp_matches(coalesce(options_json, ''), '"key":"[^" ]+","content":"[^" ]+"')))"""


def question_filter(banks: list[int] | None = None, subject: str | None = None, chapter: str | None = None, kind: str | None = None, status: str | None = None, keyword: str | None = None, only_playable: bool = False) -> Column:
    """One condition of the given ones; those left out don't filter. The keyword folds ASCII case and keeps % and _ as wildcards."""
    parts = [F.col(c) == v for c, v in (("subject", subject), ("chapter", chapter), ("type", kind), ("status", status)) if v]
    if banks:
        parts.append(F.col("bank_id").isin(banks))
    if keyword:
        parts.append(text.contains_folded(F.col("stem"), F.lit(keyword)))
    if only_playable:
        parts.append(playable())
    return reduce(and_, parts, F.lit(True))


@query("flt1_question_filter", f"SELECT question_id, bank_id, type, stem FROM questions WHERE bank_id IN (1, 2, 3, 5, 8) AND status = 'published' AND stem ILIKE '%WIDGET%' AND {_PLAYABLE}")
def filtered(s: Source) -> DataFrame:
    return s.questions().where(question_filter(banks=[1, 2, 3, 5, 8], status="published", keyword="WIDGET", only_playable=True)).select("question_id", "bank_id", "type", "stem")


@query("flt6_playable", f"SELECT question_id, {_PLAYABLE} AS playable FROM questions")
def playable_flags(s: Source) -> DataFrame:
    return s.questions().select("question_id", playable().alias("playable"))


@query("flt13_join6_owner_scope", "SELECT question_id, bank_id FROM questions SEMI JOIN (SELECT bank_id FROM banks WHERE owner_id = 2) USING (bank_id)")
def owned(s: Source) -> DataFrame:
    return s.questions().join(s.banks().where("owner_id = 2"), "bank_id", "left_semi").select("question_id", "bank_id")


@query("flt2_flt8_due_wrong", """SELECT user_id, question_id, wrong_count, status FROM wrong, now WHERE next_review_at IS NOT NULL AND next_review_at <= as_of AND wrong_count >= 2""")
def due(s: Source) -> DataFrame:
    """Due now and failed twice or more. Rows never scheduled are never due."""
    now = F.broadcast(s.as_of())  # one row
    return s.wrong().join(now, F.col("next_review_at") <= F.col("as_of")).where("wrong_count >= 2").select("user_id", "question_id", "wrong_count", "status")


@query("pra11_wrong_summary", "SELECT user_id, count(*) AS total, count(*) FILTER (WHERE next_review_at <= as_of) AS due, count(*) FILTER (WHERE status = 'mastered') AS mastered FROM wrong, now GROUP BY user_id")
def wrong_summary(s: Source) -> DataFrame:
    w = s.wrong().join(F.broadcast(s.as_of()))  # one row
    return w.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.col("next_review_at") <= F.col("as_of"), F.lit(False))).alias("due"), F.count_if(F.col("status") == "mastered").alias("mastered"))


@query("join1_join23_wrong_list", """SELECT user_id, question_id, wrong_count, stem, f.user_id IS NOT NULL AS is_fav FROM wrong JOIN questions USING (question_id) LEFT JOIN favorites f USING (user_id, question_id)""")
def wrong_list(s: Source) -> DataFrame:
    fav = s.favorites().withColumn("f", F.lit(True))
    return s.wrong().join(s.questions().select("question_id", "stem"), "question_id").join(fav, ["user_id", "question_id"], "left").select("user_id", "question_id", "wrong_count", "stem", F.coalesce("f", F.lit(False)).alias("is_fav"))


@query("pra12_user_flags", """SELECT DISTINCT a.user_id, a.question_id, f.user_id IS NOT NULL AS is_fav, w.user_id IS NOT NULL AS is_wrong FROM attempts a
    LEFT JOIN favorites f USING (user_id, question_id) LEFT JOIN wrong w USING (user_id, question_id)""")
def user_flags(s: Source) -> DataFrame:
    flags = s.attempts().select("user_id", "question_id").distinct()
    for name, rows in (("is_fav", s.favorites()), ("is_wrong", s.wrong().select("user_id", "question_id"))):
        flags = flags.join(rows.withColumn(name, F.lit(True)), ["user_id", "question_id"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return flags


@query("join9_set2_unattempted", "SELECT user_id, question_id FROM (SELECT DISTINCT user_id, bank_id FROM attempts JOIN questions USING (question_id)) JOIN questions USING (bank_id) ANTI JOIN attempts USING (user_id, question_id) WHERE status = 'published'")
def unattempted(s: Source) -> DataFrame:
    """Published questions, of the banks that a user has worked in, which the user has not tried.

    Questions stand on shelves of ids. A user meets shelves, and what was tried of each, before they are opened, so of the users' questions, nearly as many
    as there are pairs, none is shuffled."""
    q = s.questions().select("question_id", "bank_id", "status")
    tried = s.attempts().select("user_id", "question_id").distinct().join(q.select("question_id", "bank_id"), "question_id")
    own = tried.groupBy("user_id", "bank_id", _shelf("question_id")).agg(F.collect_list("question_id").alias("tried"))
    open_ = q.where("status = 'published'")
    shelves = open_.groupBy("bank_id", _shelf("question_id")).agg(F.collect_list("question_id").alias("ids"))
    every = own.select("user_id", "bank_id").distinct().join(shelves.select("bank_id", "shelf"), "bank_id").join(own, ["user_id", "bank_id", "shelf"], "left")
    spread = every.repartition(int(s.spark.conf.get("spark.sql.shuffle.partitions")), "bank_id", "shelf", "user_id")  # few bytes, out of which many rows come
    left = F.filter("ids", lambda x: ~F.array_contains("tried", x))
    return spread.join(shelves, ["bank_id", "shelf"]).select("user_id", F.explode(F.when(F.col("tried").isNull(), F.col("ids")).otherwise(left)).alias("question_id"))


#: Ids on a shelf at most, unless questions share an id.
SHELF = 16384


def _shelf(question: str) -> Column:
    return F.floor(F.col(question) / SHELF).alias("shelf")


def select_questions(s: Source, mode: str, user: int, limit: int = 500, seed: int = 7, require_published: bool | None = None) -> DataFrame:
    """(question_id, position) for one practice session of one user.

    Modes: sequential and unattempted by id, random by a seeded hash, wrong by wrong_count, due by due time, favorite
    by id. wrong and due don't ask for published questions unless told to. limit: 0 means 500, which is also the most.
    """
    size = min(limit or 500, 500)
    q = s.questions().where(playable())
    if require_published if require_published is not None else mode not in ("wrong", "due"):
        q = q.where("status = 'published'")
    own = lambda df: df.where(F.col("user_id") == user).drop("user_id")
    if mode == "random":
        q, order = q.withColumn("r", F.md5(F.concat_ws(":", F.lit(seed), "question_id"))), ["r", "question_id"]
    elif mode == "wrong":
        q, order = q.join(own(s.wrong()).where("status <> 'mastered'"), "question_id", "inner"), [F.desc("wrong_count"), "question_id"]
    elif mode == "due":
        q, order = q.join(own(s.wrong()), "question_id").join(F.broadcast(s.as_of()), F.col("next_review_at") <= F.col("as_of")), ["next_review_at", "question_id"]
    elif mode == "favorite":
        q, order = q.join(own(s.favorites()), "question_id", "left_semi"), ["question_id"]
    elif mode == "unattempted":
        q, order = q.join(own(s.attempts()), "question_id", "left_anti"), ["question_id"]
    else:
        order = ["question_id"]
    cut = q.orderBy(*order).limit(size)  # a session's questions: 500 at most
    return cut.select("question_id", F.row_number().over(W.orderBy(*order)).alias("position"))


_SELECT = "SELECT question_id, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS position FROM questions {join} WHERE {play} AND {where} ORDER BY {order} LIMIT {n}"
_PUB = "status = 'published'"
query("pra4_sequential", _SELECT.format(order="question_id", join="", play=_PLAYABLE, where=_PUB, n=20))(lambda s: select_questions(s, "sequential", 8, 20))
query("pra4_srt3_random", _SELECT.format(order="md5('7:' || question_id), question_id", join="", play=_PLAYABLE, where=_PUB, n=20))(lambda s: select_questions(s, "random", 8, 20))
query("pra4_wrong", _SELECT.format(order="wrong_count DESC, question_id", join="JOIN (SELECT * EXCLUDE (status) FROM wrong WHERE user_id = 8 AND status <> 'mastered') USING (question_id)", play=_PLAYABLE, where="TRUE", n=20))(lambda s: select_questions(s, "wrong", 8, 20))
query("pra4_due", _SELECT.format(order="next_review_at, question_id", join="JOIN (SELECT * EXCLUDE (status) FROM wrong, now WHERE user_id = 8 AND next_review_at <= as_of) USING (question_id)", play=_PLAYABLE, where="TRUE", n=20))(lambda s: select_questions(s, "due", 8, 20))
query("pra4_favorite", _SELECT.format(order="question_id", join="SEMI JOIN (SELECT * FROM favorites WHERE user_id = 8) USING (question_id)", play=_PLAYABLE, where=_PUB, n=20))(lambda s: select_questions(s, "favorite", 8, 20))
query("pra4_unattempted", _SELECT.format(order="question_id", join="ANTI JOIN (SELECT * FROM attempts WHERE user_id = 8) USING (question_id)", play=_PLAYABLE, where=_PUB, n=20))(lambda s: select_questions(s, "unattempted", 8, 20))


@query("pra5_srt10_preview", f"SELECT bank_id, count(*) AS available, CAST(least(count(*), 10) AS BIGINT) AS selected FROM questions WHERE {_PUB} AND {_PLAYABLE} GROUP BY bank_id")
def preview(s: Source) -> DataFrame:
    return s.questions().where(playable() & (F.col("status") == "published")).groupBy("bank_id").agg(F.count("*").alias("available")).withColumn("selected", F.least("available", F.lit(10).cast("long")))


@query("srt1_snk5_page", "SELECT question_id, stem, (SELECT count(*) FROM questions) AS total FROM questions ORDER BY stem, question_id LIMIT 20 OFFSET 40")
def third_page(s: Source) -> DataFrame:
    rows = sets.page(s.questions().select("question_id", "stem"), ["stem", "question_id"], 3, 20)
    return rows.join(F.broadcast(s.questions().agg(F.count("*").alias("total"))))  # one row


@query("srt11_keyset", "SELECT attempt_id, user_id FROM attempts WHERE attempt_id > 1000 ORDER BY attempt_id LIMIT 500")
def keyset(s: Source) -> DataFrame:
    return sets.after(s.attempts().select("attempt_id", "user_id"), "attempt_id", 1000, 500)


@query("srt2_nulls_last", "SELECT id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_start, nullif(marker_top, 0) NULLS LAST, question_no, id) AS INTEGER) AS place FROM directory")
def nulls_last(s: Source) -> DataFrame:
    w = W.partitionBy("document_id").orderBy("page_start", F.asc_nulls_last(F.nullif("marker_top", F.lit(0))), "question_no", "id")
    return s.directory().select("id", F.row_number().over(w).alias("place"))


@query("srt4_priority_sort", "SELECT user_id, question_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY wrong_count DESC, last_wrong_at DESC, question_id) AS INTEGER) AS place FROM wrong")
def priority(s: Source) -> DataFrame:
    return windows.renumber(s.wrong(), ["user_id"], [F.desc("wrong_count"), F.desc("last_wrong_at"), "question_id"], "place").select("user_id", "question_id", "place")


@query("srt8_srt9_recent", "SELECT conv_id, turn, role FROM conv QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3".replace("FROM conv", "FROM conversations"))
def recent_turns(s: Source) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    return s.table("conversations").withColumn("k", F.row_number().over(w)).where("k <= 3").select("conv_id", "turn", "role")


@query("join10_correlated_counts", "SELECT bank_id, name, (SELECT count(*) FROM questions q WHERE q.bank_id = b.bank_id) AS question_count FROM banks b")
def bank_counts(s: Source) -> DataFrame:
    return joins.scalar_counts(s.banks(), s.questions(), "bank_id", "bank_id", "question_count").select("bank_id", "name", "question_count")


@query("win17_first_attempt", "SELECT user_id, question_id, attempt_id, is_correct FROM attempts QUALIFY row_number() OVER (PARTITION BY user_id, question_id ORDER BY attempt_id) = 1")
def first_attempt(s: Source) -> DataFrame:
    """Answers count once: the first of a user and question."""
    a = s.attempts().groupBy("user_id", "question_id").agg(F.min(F.struct("attempt_id", "is_correct")).alias("a"))
    return a.select("user_id", "question_id", "a.*")


@query("mut2_win18_latest", "SELECT user_id, question_id, arg_max(duration_ms, attempt_id) AS duration_ms, count(*) AS version FROM attempts GROUP BY ALL")
def latest(s: Source) -> DataFrame:
    return sets.latest(s.attempts(), ["user_id", "question_id"], ["attempt_id"], ["duration_ms"])


@query("mut5_keep_prior", "SELECT user_id, arg_max(d, attempt_id) FILTER (WHERE d IS NOT NULL) AS d, count(*) AS n FROM (SELECT user_id, attempt_id, CASE WHEN is_correct = 1 THEN duration_ms END AS d FROM attempts) GROUP BY user_id")
def keep_prior(s: Source) -> DataFrame:
    a = s.attempts().withColumn("d", F.when(F.col("is_correct") == 1, F.col("duration_ms")))
    return sets.keep_prior(a, ["user_id"], ["attempt_id"], ["d"]).join(a.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")


@query("mut4_insert_or_ignore", "SELECT question_id, user_id, attempt_id FROM attempts QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY created_at, attempt_id) = 1")
def insert_or_ignore(s: Source) -> DataFrame:
    return sets.first_wins(s.attempts(), ["question_id"], ["created_at", "attempt_id"]).select("question_id", "user_id", "attempt_id")


@query("mut9_cascade_delete", """SELECT 'nation' AS t, count(*) AS n FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
    UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))""")
def cascade(s: Source) -> DataFrame:
    t = {n: s.table(n) for n in ("region", "nation", "customer", "orders")}
    edges = [("region", "r_regionkey", "nation", "n_regionkey"), ("nation", "n_nationkey", "customer", "c_nationkey"), ("customer", "c_custkey", "orders", "o_custkey")]
    left = sets.cascade_delete(t, t["region"].where("r_regionkey = 1").select("r_regionkey"), edges)
    return reduce(DataFrame.unionByName, (left[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("t"), "n") for n in ("nation", "customer", "orders")))


@query("pra1_pra2_pra3_grading", """SELECT attempt_id, CASE WHEN k = 0 THEN g = 'b' WHEN k = 1 THEN g IN ('ac', 'ca') WHEN k = 2 THEN g IN ('monitor', '监视器锁') ELSE FALSE END AS is_correct
    FROM (SELECT attempt_id, question_id % 4 AS k, ['b', 'ca', 'monitor', 'x'][user_id % 4 + 1] AS g FROM attempts)""")
def graded(s: Source) -> DataFrame:
    """Four question types against four answers written in odd width, case and order."""
    k = (F.col("question_id") % 4).cast("int")
    kind = F.get(F.array(*map(F.lit, ("single_choice", "multiple_choice", "fill_blank", "short_answer"))), k)
    correct = F.get(F.array(F.array(F.lit("B")), F.array(F.lit("A"), F.lit("C")), F.array(F.lit("Monitor"), F.lit("监视器锁")), F.array(F.lit("x"))), k)
    given = F.get(F.array(F.array(F.lit(" ｂ。")), F.array(F.lit("c"), F.lit("Ａ")), F.array(F.lit("mon itor")), F.array(F.lit("x"))), (F.col("user_id") % 4).cast("int"))
    return s.attempts().select("attempt_id", grading.is_correct(kind, correct, given).alias("is_correct"))


@query("pra8_dat4_review_schedule", """SELECT user_id, question_id, interval_days, floor(abs(moved) * 10 + 0.5) / 10 AS mastery, CASE result WHEN 'again' THEN 'learning' ELSE CASE WHEN moved >= 80 AND reviews >= 2 THEN 'mastered' WHEN reviews > 0 THEN 'reviewing' ELSE 'learning' END END AS status
    FROM (SELECT *, CASE WHEN wrong_count > 1 THEN greatest(0, stepped - (wrong_count - 1) * 3) ELSE stepped END AS moved,
      CASE result WHEN 'again' THEN 0.007 WHEN 'hard' THEN greatest(0.5, step * 0.5) WHEN 'easy' THEN step * 2 ELSE step END AS interval_days
      FROM (SELECT *, greatest(0, least(100, mastery0 + CASE result WHEN 'again' THEN -20 WHEN 'hard' THEN -5 WHEN 'good' THEN 10 ELSE 15 END)) AS stepped,
        CAST([1, 3, 7, 15, 30][least(reviews, 4) + 1] AS DOUBLE) AS step
        FROM (SELECT user_id, question_id, wrong_count, question_id % 6 AS reviews, CAST(question_id % 100 AS DOUBLE) AS mastery0, ['again', 'hard', 'good', 'easy'][user_id % 4 + 1] AS result FROM wrong)))""")
def scheduled(s: Source) -> DataFrame:
    now = F.broadcast(s.as_of())  # one row
    result = F.get(F.array(*map(F.lit, ("again", "hard", "good", "easy"))), (F.col("user_id") % 4).cast("int"))
    r = grading.review(F.col("wrong_count"), F.lit(0), F.col("question_id") % 6, (F.col("question_id") % 100).cast("double"), F.lit(3.0), F.col("last_wrong_at"), result, F.col("as_of"))
    return s.wrong().join(now).withColumn("r", r).select("user_id", "question_id", "r.interval_days", "r.mastery", "r.status")


def wrong_book(attempts: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """The wrong book after all attempts of each user and question, in order of attempt_id: a failed one opens the row or
    adds to it, resets interval and mastery and makes it learning; a right one on an open row reviews it as good.

    One fold over the sorted attempts of a user and question: one person's tries at one question. State is a struct,
    so all of it runs in the JVM. With prior, a wrong book before these attempts, the fold goes on from its rows."""
    state = "struct<wrong_count:bigint,correct_count:bigint,review_count:bigint,mastery:double,interval_days:double,priority:double,last_wrong_at:timestamp,last_review_at:timestamp,next_review_at:timestamp,status:string>"
    z = lambda v, t: F.lit(v).cast(t)
    empty = F.struct(z(0, "long").alias("wrong_count"), z(0, "long").alias("correct_count"), z(0, "long").alias("review_count"), z(0, "double").alias("mastery"), z(0, "double").alias("interval_days"), z(0, "double").alias("priority"),
                     z(None, "timestamp").alias("last_wrong_at"), z(None, "timestamp").alias("last_review_at"), z(None, "timestamp").alias("next_review_at"), F.lit("learning").alias("status"))

    def step(b: Column, a: Column) -> Column:
        t = a["created_at"]
        r = grading.review(b["wrong_count"], b["correct_count"] + 1, b["review_count"], b["mastery"], F.lit(3.0), b["last_review_at"], F.lit("good"), t)
        failed = F.struct(b["wrong_count"] + 1, b["correct_count"], b["review_count"], F.lit(0.0), F.lit(0.0), F.when(b["wrong_count"] > 0, b["priority"] + 1).otherwise(b["priority"]), t, b["last_review_at"], b["next_review_at"], F.lit("learning"))
        passed = F.struct(b["wrong_count"], b["correct_count"] + 1, b["review_count"] + 1, r["mastery"], r["interval_days"], r["priority"], b["last_wrong_at"], t, r["next_review_at"], r["status"])
        return F.when(a["is_correct"] == 0, failed.cast(state)).when(b["wrong_count"] > 0, passed.cast(state)).otherwise(b)

    rows = F.sort_array(F.collect_list(F.struct("attempt_id", "is_correct", "created_at")))
    tries = attempts.groupBy("user_id", "question_id").agg(rows.alias("a"))
    start = empty.cast(state)
    if prior is not None:
        names = [f.split(":")[0] for f in state.removeprefix("struct<").removesuffix(">").split(",")]
        tries = tries.join(prior.select("user_id", "question_id", F.struct(*names).alias("s")), ["user_id", "question_id"], "full").withColumn("a", F.coalesce("a", F.array().cast("array<struct<attempt_id:bigint,is_correct:int,created_at:timestamp>>")))
        start = F.coalesce(F.col("s").cast(state), start)
    folded = tries.withColumn("b", F.aggregate("a", start, step))
    return folded.select("user_id", "question_id", "b.*").where("wrong_count > 0")


_WRONG_COUNTS = """, t AS (SELECT *, row_number() OVER (PARTITION BY user_id, question_id ORDER BY attempt_id) AS i, sum(1 - is_correct) OVER (PARTITION BY user_id, question_id ORDER BY attempt_id) AS w FROM attempts)
    SELECT user_id, question_id, CAST(sum(1 - is_correct) AS BIGINT) AS wrong_count, count(*) FILTER (WHERE is_correct = 1 AND w > 0) AS correct_count, count(*) FILTER (WHERE is_correct = 1 AND w > 0) AS review_count
    FROM t GROUP BY ALL HAVING sum(1 - is_correct) > 0"""


@query("mut3_pra6_pra9_wrong_book", _WRONG_COUNTS)
def wrong_book_counts(s: Source) -> DataFrame:
    return wrong_book(s.attempts()).select("user_id", "question_id", "wrong_count", "correct_count", "review_count")


WRONG_BOOK = "user_id long, question_id long, wrong_count long, correct_count long, review_count long, mastery double, interval_days double, priority double, last_wrong_at timestamp, last_review_at timestamp, next_review_at timestamp, status string"


@query("mut3_snk3_wrong_book_updates", _WRONG_COUNTS)
def wrong_book_updates(s: Source) -> DataFrame:
    """The same wrong book kept up to date by a stream of attempts that comes in two batches: each reads and rewrites the buckets of its own keys."""
    at = scratch(s.spark, "wrong-book")
    half = s.table("events").agg(F.percentile("event_id", 0.5).alias("m")).first()["m"]
    a = s.attempts()
    for part in (F.col("attempt_id") <= half, F.col("attempt_id") > half):
        a.where(part).coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = s.spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    keyed.follow(stream, f"{at}/table", f"{at}/state", WRONG_BOOK, ["user_id", "question_id"], lambda old, new: wrong_book(new, old), 16)
    return keyed.read(s.spark, f"{at}/table", WRONG_BOOK).select("user_id", "question_id", "wrong_count", "correct_count", "review_count")


_STATE = """, t AS (SELECT *, row_number() OVER (PARTITION BY user_id, question_id ORDER BY attempt_id) AS i FROM attempts),
    f AS (SELECT user_id, question_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS wc, CAST(0 AS BIGINT) AS cc, CAST(0 AS BIGINT) AS rc, CAST(0 AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS iv, CAST(0 AS DOUBLE) AS pr, CAST(NULL AS TIMESTAMP) AS lw, CAST(NULL AS TIMESTAMP) AS lr, CAST(NULL AS TIMESTAMP) AS nr, 'learning' AS st FROM t WHERE i = 1
      UNION ALL SELECT user_id, question_id, i, wc + bad, cc + good, rc + good, CASE WHEN bad = 1 THEN 0 WHEN good = 1 THEN floor(moved * 10 + 0.5) / 10 ELSE m END, CASE WHEN bad = 1 THEN 0 WHEN good = 1 THEN step ELSE iv END,
        CASE WHEN bad = 1 THEN CASE WHEN wc > 0 THEN pr + 1 ELSE pr END WHEN good = 1 THEN floor(greatest(0, rank) * 100 + 0.5) / 100 ELSE pr END, CASE WHEN bad = 1 THEN tm ELSE lw END, CASE WHEN good = 1 THEN tm ELSE lr END, CASE WHEN good = 1 THEN tm + to_days(CAST(step AS INTEGER)) ELSE nr END,
        CASE WHEN bad = 1 THEN 'learning' WHEN good = 1 THEN CASE WHEN moved >= 80 AND rc >= 2 THEN 'mastered' WHEN rc > 0 THEN 'reviewing' ELSE 'learning' END ELSE st END
      FROM (SELECT f.*, t.i AS i_, t.created_at AS tm, 1 - is_correct AS bad, CASE WHEN is_correct = 1 AND wc > 0 THEN 1 ELSE 0 END AS good, CAST([1, 3, 7, 15, 30][least(rc, 4) + 1] AS DOUBLE) AS step,
          CASE WHEN wc > 1 THEN greatest(0, least(100, m + 10) - (wc - 1) * 3) ELSE least(100, m + 10) END AS moved,
          2.0::DOUBLE * least(1.0::DOUBLE, wc / 10.0::DOUBLE) + 1.5::DOUBLE * least(1.0::DOUBLE, coalesce((epoch_us(t.created_at) - epoch_us(lr)) / 86400000000.0::DOUBLE, 0) / 7) + 0.5::DOUBLE * 2 / 4 + 1.0::DOUBLE * (1 - least(1.0::DOUBLE, (cc + 1) / 3.0::DOUBLE)) - 0.4::DOUBLE * m / 100 AS rank
        FROM f JOIN t ON t.user_id = f.user_id AND t.question_id = f.question_id AND t.i = f.i + 1) AS x(user_id, question_id, i0, wc, cc, rc, m, iv, pr, lw, lr, nr, st, i, tm, bad, good, step, moved, rank))
    SELECT user_id, question_id, wc AS wrong_count, cc AS correct_count, rc AS review_count, m AS mastery, iv AS interval_days, floor(pr * 10 + 0.5) / 10 AS priority, lw AS last_wrong_at, lr AS last_review_at, nr AS next_review_at, st AS status
    FROM f WHERE wc > 0 QUALIFY row_number() OVER (PARTITION BY user_id, question_id ORDER BY i DESC) = 1"""
query("mut3_pra8_wrong_book_state", _STATE)(lambda s: wrong_book(s.attempts()).withColumn("priority", round1(F.col("priority"))))


@query("pra7_mut6_stm9_session_state", """, n AS (SELECT l_orderkey, count(*) AS total, count(*) FILTER (WHERE l_linestatus = 'F') AS answered, count(*) FILTER (WHERE l_linestatus <> 'F' AND l_discount = 0) AS unusable FROM lineitem GROUP BY l_orderkey), t AS (SELECT max(o_orderdate) AS moment FROM orders)
    SELECT o_orderkey AS session_id, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'P' THEN 'abandoned' ELSE CASE WHEN answered + unusable >= total THEN 'finished' WHEN o_orderdate + INTERVAL 90 DAY <= moment THEN 'expired' ELSE 'active' END END AS status, least(answered + unusable, total) AS current_index, o_orderstatus = 'O' AS moved FROM orders JOIN n ON l_orderkey = o_orderkey, t""")
def session_state(s: Source) -> DataFrame:
    """Sessions (orders) of questions (lines): answered ones and open ones that can't be used move the index on. Only a session still stored as
    active changes: to finished when its index reaches the end, else to expired once its deadline has passed."""
    n = s.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("total"), F.count_if(F.col("l_linestatus") == "F").alias("answered"), F.count_if((F.col("l_linestatus") != "F") & (F.col("l_discount") == 0)).alias("unusable"))
    o = s.table("orders").join(n, "o_orderkey").join(F.broadcast(s.table("orders").agg(F.max("o_orderdate").alias("at"))))  # one row
    index = F.least(F.col("answered") + F.col("unusable"), "total")
    now = F.when(index >= F.col("total"), "finished").when(F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS") <= F.col("at"), "expired").otherwise("active")
    status = F.when(F.col("o_orderstatus") == "F", "finished").when(F.col("o_orderstatus") == "P", "abandoned").otherwise(now)
    return o.select(F.col("o_orderkey").alias("session_id"), status.alias("status"), index.alias("current_index"), (F.col("o_orderstatus") == "O").alias("moved"))
