"""Wrong-question import: extraction, draft dedup, answer matching, boundaries between images, merging, replies and readiness.

Sample drafts come from documents: a session is fifty documents (one person's upload), an image a document, a draft each of its lines,
some of them written as cut-off, continued or numbered ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scholia.adapters import Source
from scholia.functions import text
from scholia.functions.numbers import add_days, clamp01
from scholia.functions.tables import ANSWER_PREFIX, BOUNDARY, END_WARNINGS, MATERIAL_WORDS, MERGE_AUTO, MERGE_REVIEW, NEW_QUESTION, START_WARNINGS, SUB_QUESTION, USER_ANSWER
from scholia.operators import joins, shared_grams, windows
from scholia.registry import query
from scholia.session import stored

C = F.col
_KINDS = ("single_choice", "multiple_choice", "short_answer", "essay")


def drafts(s: Source) -> DataFrame:
    """(session, image, seq, draft, stem, kind, warnings, answer, by_user)"""
    x = s.lines().where("line <> ''").withColumn("x", F.translate("line", ".", "。"))
    h = (C("doc_id") + C("line_no")) % 8
    stem = (
        F.when(h == 0, F.concat(F.lit("（1）"), "x")).when(h == 1, F.concat(F.lit("第3题 "), "x")).when(h == 2, F.concat(F.lit("，"), "x")).when(h == 3, F.concat("x", F.lit(" 本案 （1）a (2) b。")))
        .when(h == 4, F.regexp_replace("x", "。+$", "")).when(h == 5, F.concat(F.lit("一、"), "x")).otherwise(C("x"))
    )
    w = (C("doc_id") * 3 + C("line_no")) % 11
    return x.select(
        F.floor(C("doc_id") / 50).alias("session"), C("doc_id").alias("image"), C("line_no").alias("seq"), (C("doc_id") * 1_000_000 + C("line_no")).alias("draft"), stem.alias("stem"),
        F.get(F.array(*map(F.lit, _KINDS)), (F.char_length("line") % 4).cast("int")).alias("kind"), F.when(w == 0, F.array(F.lit("图片截断"))).when(w == 1, F.array(F.lit("缺少题干"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
        F.when((C("doc_id") + C("line_no")) % 3 == 0, text.capital(F.left("line", F.lit(1)))).alias("answer"), ((C("doc_id") + C("line_no")) % 7 == 0).alias("by_user"),
    )


_DRAFTS = r"""x AS (SELECT *, (doc_id + line_no) % 8 AS h, (doc_id * 3 + line_no) % 11 AS w, replace(line, '.', '。') AS x FROM lines WHERE line <> ''),
dr AS (SELECT doc_id // 50 AS session, doc_id AS image, line_no AS seq, doc_id * 1000000 + line_no AS draft,
  CASE h WHEN 0 THEN '（1）' || x WHEN 1 THEN '第3题 ' || x WHEN 2 THEN '，' || x WHEN 3 THEN x || ' 本案 （1）a (2) b。' WHEN 4 THEN regexp_replace(x, '。+$', '') WHEN 5 THEN '一、' || x ELSE x END AS stem,
  ['single_choice', 'multiple_choice', 'short_answer', 'essay'][length(line) % 4 + 1] AS kind, CASE w WHEN 0 THEN ['图片截断'] WHEN 1 THEN ['缺少题干'] ELSE CAST([] AS VARCHAR[]) END AS warnings,
  CASE WHEN (doc_id + line_no) % 3 = 0 THEN upper(left(line, 1)) END AS answer, (doc_id + line_no) % 7 = 0 AS by_user FROM x)"""


def _frag(x: str) -> str:
    return f"regexp_replace(lower({x}), '[ \\t\\r\\n，。；：！？,.!?]', '', 'g')"


def _starts(x: str, w: str) -> str:
    return f"(list_has_any({w}, ['缺少题干']) OR regexp_matches(trim({x}), '^([，。；：、]|[（(][0-9０-９]+[）)])'))"


def _ends(x: str, w: str) -> str:
    return f"(list_has_any({w}, ['图片截断']) OR trim({x}) <> '' AND NOT regexp_matches(trim({x}), '[。！？!?】）)\\]》」』]$'))"


@query("wqi2_wqi11_draft_dedup", f""", {_DRAFTS} SELECT session, sha256(kind || chr(10) || stem) AS k, min(draft) AS draft, count(*) AS copies, CASE WHEN arg_min(by_user, draft) THEN arg_min_null(answer, draft) ELSE arg_min(answer, draft) END AS answer FROM dr GROUP BY session, kind, stem""")
def draft_dedup(s: Source) -> DataFrame:
    """The first of equal drafts in a session stays; unless its user set the answer, it takes the first one that any of them has."""
    first = F.min(F.struct("draft", "by_user", "answer"))
    known = F.min_by("answer", F.when(C("answer").isNotNull(), C("draft")))
    g = drafts(s).groupBy("session", F.sha2(F.concat_ws("\n", "kind", "stem"), 256).alias("k")).agg(first.alias("f"), F.count("*").alias("copies"), known.alias("known"))
    return g.select("session", "k", C("f.draft").alias("draft"), "copies", F.when(C("f.by_user"), C("f.answer")).otherwise(C("known")).alias("answer"))


def boundary_score(same_batch: Column) -> Column:
    """How likely the last draft of an image goes on in the first of the next, 0 to 1, of columns left and right (stem, kind, warnings); without a
    cut on the left or a start midway on the right under the review limit; a mark of a new question decides against it."""
    a, b, w = C("left.stem"), C("right.stem"), BOUNDARY
    add = lambda test, name: F.when(test, w[name]).otherwise(0.0)
    cut, goes_on = text.ends_mid(a, C("left.warnings")), text.starts_mid(b, C("right.warnings"))
    warned = text.warns(C("left.warnings"), END_WARNINGS[:2]) | text.warns(C("right.warnings"), START_WARNINGS)
    total = (
        F.lit(w["base"]) + add(same_batch, "same_batch") + add(cut, "left_cut") + add(goes_on, "right_goes_on") + add(F.trim(b).rlike("^[（(]"), "sub_question") + add(warned, "warning")
        + F.when(C("left.kind") == C("right.kind"), w["same_type"]).otherwise(w["other_type"]) + add(text.overlap(a, b) > 0, "overlap")
    )
    return F.when(text.opens_question(b), NEW_QUESTION).otherwise(clamp01(F.when(cut | goes_on, total).otherwise(F.least(total, F.lit(MERGE_REVIEW - 0.01)))))


def decided(score: Column, hard: Column, conflict: Column) -> Column:
    """merge, review or separate: a conflict asks for review at most, and review below its limit is separate."""
    first = F.when(hard, "separate").when(score >= MERGE_AUTO, "merge").when(score >= MERGE_REVIEW, "review").otherwise("separate")
    capped = F.when(conflict, F.least(score, F.lit(MERGE_REVIEW))).otherwise(score)
    asked = F.when(conflict | ((first == "separate") & (capped >= MERGE_REVIEW) & ~hard), "review").otherwise(first)
    return F.when((asked == "review") & (capped < MERGE_REVIEW), "separate").otherwise(asked)


def pairs(s: Source) -> DataFrame:
    """(session, image, left, right): the last draft of each image with the first of the next one of its session."""
    row = F.struct("draft", "stem", "kind", "warnings", "answer")
    g = drafts(s).groupBy("session", "image").agg(F.min_by(row, "seq").alias("first"), F.max_by(row, "seq").alias("left"))
    after = F.lead("first").over(W.partitionBy("session").orderBy("image"))  # fifty images at most
    return g.withColumn("right", after).where("right is not null").select("session", "image", "left", "right")


_PAIRS = f"""{_DRAFTS}, im AS (SELECT session, image, min(seq) AS f, max(seq) AS l FROM dr GROUP BY ALL), nx AS (SELECT session, image, l, lead(image) OVER w AS nimage, lead(f) OVER w AS nf FROM im WINDOW w AS (PARTITION BY session ORDER BY image)),
pairs AS (SELECT n.session, n.image, a.draft AS left_id, b.draft AS right_id, a.stem AS lt, b.stem AS rt, a.kind AS lk, b.kind AS rk, a.warnings AS lw, b.warnings AS rw, a.answer AS la, b.answer AS ra FROM nx n JOIN dr a ON a.image = n.image AND a.seq = l JOIN dr b ON b.image = nimage AND b.seq = nf),
ov AS (SELECT *, coalesce(list_max(list_filter(range(2, least(80, length(trim(lt)), length(trim(rt))) + 1), lambda n: {_frag('right(trim(lt), n)')} = {_frag('left(trim(rt), n)')})), 0) AS overlap, {_starts('rt', 'rw')} AS goes_on, {_ends('lt', 'lw')} AS cut,
  regexp_matches(trim(rt), '^(第\\s*[0-9０-９]+\\s*题|[0-9０-９]+\\s*[.、．）)]|[一二三四五六七八九十]+[、.．])') AS hard, lk <> rk OR la <> ra AS conflict FROM pairs),
sc AS (SELECT *, 0.22 + CASE WHEN image % 2 = 0 THEN 0.1 ELSE 0 END + CASE WHEN cut THEN 0.32 ELSE 0 END + CASE WHEN goes_on THEN 0.32 ELSE 0 END + CASE WHEN left(trim(rt), 1) IN ('（', '(') THEN 0.08 ELSE 0 END
  + CASE WHEN list_contains(lw, '图片截断') OR list_contains(rw, '缺少题干') THEN 0.08 ELSE 0 END + CASE WHEN lk = rk THEN 0.05 ELSE -0.16 END + CASE WHEN overlap > 0 THEN 0.1 ELSE 0 END AS total FROM ov),
fin AS (SELECT *, round(CAST(CASE WHEN hard THEN 0.05 WHEN cut OR goes_on THEN greatest(0, least(1, total)) ELSE greatest(0, least(total, 0.69)) END AS DOUBLE), 6) AS score FROM sc)"""


def _decided(conflict: str) -> str:
    first = "CASE WHEN hard THEN 'separate' WHEN score >= 0.92 THEN 'merge' WHEN score >= 0.7 THEN 'review' ELSE 'separate' END"
    return f"CASE WHEN NOT coalesce({conflict}, FALSE) THEN {first} WHEN score >= 0.7 THEN 'review' ELSE 'separate' END"


@query("join21_adjacent_pairs", f", {_PAIRS} SELECT session, image, left_id, right_id FROM pairs")
def adjacent(s: Source) -> DataFrame:
    return pairs(s).select("session", "image", C("left.draft").alias("left_id"), C("right.draft").alias("right_id"))


def scored(s: Source) -> DataFrame:
    p = pairs(s).withColumn("score", F.round(boundary_score(C("image") % 2 == 0), 6)).withColumn("hard", text.opens_question(C("right.stem")))
    return p.withColumn("conflict", F.coalesce((C("left.kind") != C("right.kind")) | (C("left.answer") != C("right.answer")), F.lit(False)))


@query("wqi4_wqi5_boundary", f", {_PAIRS} SELECT left_id, right_id, score, {_decided('conflict')} AS decision FROM fin")
def boundaries(s: Source) -> DataFrame:
    return scored(s).select(C("left.draft").alias("left_id"), C("right.draft").alias("right_id"), "score", decided(C("score"), C("hard"), C("conflict")).alias("decision"))


@query("str19_truncation", f""", {_DRAFTS} SELECT draft, {_starts('stem', 'warnings')} AS starts_mid, {_ends('stem', 'warnings')} AS ends_mid FROM dr""")
def truncation(s: Source) -> DataFrame:
    return drafts(s).select("draft", text.starts_mid(C("stem"), C("warnings")).alias("starts_mid"), text.ends_mid(C("stem"), C("warnings")).alias("ends_mid"))


_MERGED = f"""CASE WHEN trim(lt) = '' THEN trim(rt) WHEN trim(rt) = '' THEN trim(lt) WHEN length({_frag('trim(rt)')}) >= 8 AND suffix({_frag('trim(lt)')}, {_frag('trim(rt)')}) THEN trim(lt)
    WHEN length({_frag('trim(lt)')}) >= 8 AND starts_with({_frag('trim(rt)')}, {_frag('trim(lt)')}) THEN trim(rt) WHEN overlap > 0 THEN trim(lt) || substr(trim(rt), overlap + 1) ELSE trim(lt) || trim(rt) END"""


@query("str20_str21_wqi6_merge", f", {_PAIRS} SELECT left_id, right_id, CAST(overlap AS INTEGER) AS overlap, sha256({_MERGED}) AS merged, CASE WHEN lk <> rk THEN 'question_type_conflict' WHEN la <> ra THEN 'answer_conflict' ELSE '' END AS reason, coalesce(la, ra) AS answer FROM ov")
def merge_texts(s: Source) -> DataFrame:
    a, b = C("left.stem"), C("right.stem")
    reason = F.when(C("left.kind") != C("right.kind"), "question_type_conflict").when(C("left.answer") != C("right.answer"), "answer_conflict").otherwise("")
    return pairs(s).select(
        C("left.draft").alias("left_id"), C("right.draft").alias("right_id"), text.overlap(a, b).alias("overlap"), F.sha2(text.merge_fragments(a, b), 256).alias("merged"), reason.alias("reason"), F.coalesce("left.answer", "right.answer").alias("answer")
    )


@query("win15_wqi7_chains", f""", {_DRAFTS}, f AS (SELECT *, {_starts('stem', 'warnings')} AS sm, {_ends('stem', 'warnings')} AS em, answer IS NULL AS anon FROM dr),
    j AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND (sm OR anon AND coalesce(lag(em) OVER w, FALSE)) THEN 0 ELSE 1 END AS fresh FROM f WINDOW w AS (PARTITION BY session ORDER BY image, seq))
    SELECT draft, CAST(sum(fresh) OVER (PARTITION BY session ORDER BY image, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chain FROM j""")
def chained(s: Source) -> DataFrame:
    """Fragments of one upload in order: each joins the chain before it if it starts midway, or has no mark of its own after one that ends midway."""
    d = drafts(s).withColumn("em", text.ends_mid(C("stem"), C("warnings")))
    return windows.chains(d, ["session"], ["image", "seq"], text.starts_mid(C("stem"), C("warnings")), C("answer").isNull(), "em").select("draft", "chain")


@query("wqi21_fragments", f""", {_DRAFTS} SELECT draft, image, CAST(row_number() OVER (PARTITION BY session ORDER BY image, seq) AS INTEGER) AS position FROM dr""")
def fragments(s: Source) -> DataFrame:
    """The order in which an upload's fragments are kept."""
    return windows.renumber(drafts(s), ["session"], ["image", "seq"], "position").select("draft", "image", "position")


def answer_scores(drafts: DataFrame, entries: DataFrame) -> DataFrame:
    """(upload, entry, draft, score, exact) of every draft that an answer entry may belong to, within one upload.

    drafts: upload, draft, seq, stem, kind; entries: upload, entry, seq, hint, answer (array), analysis, section. The same normalised question .99, the same number .95, a
    hint of four characters or more that holds the stem or is held by it .94; else by evidence: n-grams that the stem shares with the answer's text, .86 and
    .008 for each from four on, .10 at most, .03 more for material questions and again under a heading that says so, .98 at most. Each tier is a
    join on an equality: keys, marks of contained texts, and an inverted index of grams for each block of an upload's drafts."""
    d = drafts.select("upload", "draft", C("seq").cast("long").alias("seq"), text.answer_question(C("stem")).alias("key"), ((C("kind") == "material_analysis") | is_material(C("stem"))).alias("material"))
    hint = text.answer_question(C("hint"))
    body = F.trim(F.concat(F.array_join("answer", "\n"), F.lit("\n"), F.coalesce("analysis", F.lit(""))))
    e = entries.select("upload", "entry", C("seq").cast("long").alias("seq"), F.when(F.char_length(hint) >= 4, hint).otherwise("").alias("key"), text.loose(body).alias("body"), C("section").rlike("案例|材料").alias("heading"))
    d, e = stored(d, "drafts"), stored(e, "entries")  # read by every tier
    own, other = e.select("upload", "entry", "key").where("key <> ''"), d.select("upload", "draft", "key")
    number = e.where("seq > 0").join(d, ["upload", "seq"]).select("upload", "entry", "draft", F.lit(0.95).alias("score"), F.lit(False).alias("exact"))
    same = own.join(other, ["upload", "key"]).select("upload", "entry", "draft", F.lit(0.99).alias("score"), F.lit(True).alias("exact"))
    inside = joins.contained_join(own, other, ["upload"], "key").where("key <> r_key").select("upload", "entry", C("r_draft").alias("draft"), F.lit(0.94).alias("score"), F.lit(False).alias("exact"))
    around = joins.contained_join(other, own, ["upload"], "key").where("key <> r_key").select("upload", C("r_entry").alias("entry"), "draft", F.lit(0.94).alias("score"), F.lit(False).alias("exact"))
    blank = own.join(other.where("key = ''").drop("key"), "upload").select("upload", "entry", "draft", F.lit(0.94).alias("score"), F.lit(False).alias("exact"))
    sure = reduce(DataFrame.unionByName, (number, same, inside, around, blank)).groupBy("upload", "entry", "draft").agg(F.max("score").alias("score"), F.max("exact").alias("exact"))

    shared = shared_grams.counted(d.select("upload", "draft", "key", "material"), e.select("upload", "entry", "body", "heading"), 4)
    score = F.lit(0.86) + F.least(F.lit(0.1), C("common") * F.lit(0.008))
    score = F.when(C("material"), score + F.lit(0.03)).otherwise(score)
    score = F.when(C("material") & C("heading"), score + F.lit(0.03)).otherwise(score)
    weak = shared.select("upload", "entry", "draft", F.least(score, F.lit(0.98)).alias("weak"))
    return sure.join(weak, ["upload", "entry", "draft"], "full").select("upload", "entry", "draft", F.coalesce("score", "weak").alias("score"), F.coalesce("exact", F.lit(False)).alias("exact"))


def _that_count(scores: DataFrame, margin: float) -> DataFrame:
    """The scores that can decide a pick. Before an upload's n-th entry at most n - 1 drafts are taken, so of its own only the best n + 1 can become best or second, besides
    those of the very same question; and if n + 1 are within the margin of the best, two of them always stay free and nothing is picked but the very same."""
    keys = ["upload", "entry"]
    place = scores.groupBy(*keys).agg(F.max("exact").alias("any")).withColumn("n", F.row_number().over(W.partitionBy("upload").orderBy("entry")))  # a row an entry
    ranked = scores.join(place, keys).withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "draft")))
    kept = ranked.where("rank <= n + 1 or exact")
    edge = F.max(F.when(C("rank") == 1, C("score"))).over(W.partitionBy(*keys)) - F.max(F.when(C("rank") == C("n") + 1, C("score"))).over(W.partitionBy(*keys))
    return kept.withColumn("edge", edge).where(C("any") | C("edge").isNull() | (C("edge") > margin * 0.999)).drop("any", "n", "rank", "edge")


def match_entries(scores: DataFrame, least: float = 0.86, margin: float = 0.015) -> DataFrame:
    """(upload, entry, draft, score): entries take drafts in their order, each the only free draft of the very same question, else the
    best free one, if its score reaches `least` and leads the next free one by more than `margin`. What one entry takes, later ones can't.

    scores: upload, entry, draft, score, exact, and ok, whether the draft may be answered; an entry whose pick may not takes nothing. Rounds instead of a fold: all entries pick at once,
    given what earlier entries picked in the round before. The first n picks of an upload are right after n rounds at the latest, and once a
    round changes nothing all are; the number of rounds is the longest chain of entries that wait for one another."""
    spark, keys = scores.sparkSession, ["upload", "entry"]
    scores = stored(_that_count(scores.select(*keys, "draft", "score", "exact", "ok"), margin), "scores")
    picks = spark.createDataFrame([], "upload long, entry long, draft long, score double")
    while True:
        taken = picks.groupBy("upload", "draft").agg(F.min("entry").alias("by"))
        free = scores.join(taken, ["upload", "draft"], "left").where("by is null or by >= entry")
        g = free.groupBy(*keys).agg(F.count_if("exact").alias("same"), F.max(F.when(C("exact"), F.struct("score", (-C("draft")).alias("m"), "ok"))).alias("sole"), F.max(F.struct("score", (-C("draft")).alias("m"), "ok")).alias("best"), F.sort_array(F.collect_list("score"), asc=False).alias("order"))  # no more than its place in the upload, and its very same ones
        second = F.coalesce(F.get("order", F.lit(1)), F.lit(0.0))
        pick = F.when(C("same") == 1, C("sole")).when(second < C("best.score") - margin, C("best"))
        now = g.withColumn("p", pick).where((C("p.score") >= least) & C("p.ok")).select(*keys, (-C("p.m")).alias("draft"), C("p.score").alias("score"))
        now = stored(now, "picks")
        if now.exceptAll(picks).isEmpty() and picks.exceptAll(now).isEmpty():
            return now
        picks = now


_ANSWERS = rf"""{_DRAFTS},
du AS (SELECT image // 10 AS upload, draft, (image % 10) * 1000 + seq AS no, stem, kind, by_user, list_contains(warnings, '缺少题干') AS excluded, answer, image FROM dr),
ky AS (SELECT *, lower(regexp_replace(regexp_replace(trim(stem), '{ANSWER_PREFIX}', ''), '[\p{{P}}\p{{S}}\s]', '', 'g')) AS k, len(regexp_extract_all(stem, '[（(][0-9０-９]+[）)]')) >= 2 AND regexp_matches(stem, '{"|".join(MATERIAL_WORDS)}') AS material FROM du WHERE NOT excluded),
en AS (SELECT upload, draft AS entry, CASE no % 4 WHEN 0 THEN 0 WHEN 1 THEN no ELSE no + 1 END AS no, CASE draft % 3 WHEN 0 THEN stem WHEN 1 THEN left(stem, 12) ELSE '' END AS hint, answer || chr(10) || regexp_extract(stem, '[^。]{{4,}}') AS body, image % 2 = 0 AS heading FROM du WHERE answer IS NOT NULL),
ek AS (SELECT upload, entry, no, heading, CASE WHEN length(h) >= 4 THEN h ELSE '' END AS h, b FROM (SELECT *, lower(regexp_replace(regexp_replace(trim(hint), '{ANSWER_PREFIX}', ''), '[\p{{P}}\p{{S}}\s]', '', 'g')) AS h, lower(regexp_replace(body, '[\p{{P}}\p{{S}}\s]', '', 'g')) AS b FROM en)),
eg AS (SELECT upload, entry, substr(b, i, n) AS g, count(*) AS m FROM (SELECT upload, entry, b, n, unnest(range(1, length(b) - n + 2)) AS i FROM ek, (SELECT unnest([2, 3, 4]) AS n)) GROUP BY ALL),
dg AS (SELECT DISTINCT upload, draft, substr(k, i, n) AS g FROM (SELECT upload, draft, k, n, unnest(range(1, length(k) - n + 2)) AS i FROM ky, (SELECT unnest([2, 3, 4]) AS n))),
cm AS (SELECT upload, entry, draft, sum(m) AS common FROM eg JOIN dg USING (upload, g) GROUP BY ALL HAVING sum(m) >= 4),
pr AS (SELECT upload, e.entry, d.draft, NOT by_user AS ok, h <> '' AND h = k AS exact, CASE WHEN h <> '' AND h = k THEN 0.99::DOUBLE WHEN e.no > 0 AND e.no = d.no THEN 0.95::DOUBLE WHEN h <> '' AND (contains(k, h) OR contains(h, k)) THEN 0.94::DOUBLE END AS sure, common, material, heading
  FROM ek e JOIN ky d USING (upload) LEFT JOIN cm USING (upload, entry, draft)),
sc AS (SELECT upload, entry, draft, ok, exact, coalesce(sure, least(0.86::DOUBLE + least(0.1::DOUBLE, CAST(common AS DOUBLE) * 0.008::DOUBLE) + CASE WHEN material THEN 0.03::DOUBLE ELSE 0::DOUBLE END + CASE WHEN material AND heading THEN 0.03::DOUBLE ELSE 0::DOUBLE END, 0.98::DOUBLE)) AS s FROM pr WHERE sure IS NOT NULL OR common IS NOT NULL)"""


@query("wqi3_answer_matching", f""", {_ANSWERS},
    cl AS (SELECT upload, entry, row_number() OVER (PARTITION BY upload ORDER BY entry) AS k, list({{'s': s, 'd': draft, 'x': exact, 'ok': ok}} ORDER BY s DESC, draft) AS c FROM sc GROUP BY upload, entry),
    f AS (SELECT DISTINCT upload, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS entry, CAST(NULL AS BIGINT) AS draft, CAST(NULL AS DOUBLE) AS score FROM cl UNION ALL
      SELECT upload, k, CASE WHEN p IS NULL THEN used ELSE list_append(used, p.d) END, entry, p.d, p.s FROM (SELECT upload, k, used, entry, CASE WHEN q.s >= 0.86 AND q.ok THEN q END AS p
        FROM (SELECT upload, k, used, entry, CASE WHEN len(list_filter(fr, lambda z: z.x)) = 1 THEN list_filter(fr, lambda z: z.x)[1] WHEN len(fr) = 1 OR len(fr) > 1 AND fr[2].s < fr[1].s - 0.015::DOUBLE THEN fr[1] END AS q
          FROM (SELECT f.upload, cl.k, f.used, cl.entry, list_filter(c, lambda z: NOT list_contains(f.used, z.d)) AS fr FROM f JOIN cl ON cl.upload = f.upload AND cl.k = f.k + 1))))
    SELECT upload, entry, draft, floor(score * 1000000 + 0.5) / 1000000 AS score FROM f WHERE draft IS NOT NULL""")
def matched(s: Source) -> DataFrame:
    """Answers of an upload's page of answers (those of drafts that have one, some with a wrong number, some with a cut or no hint) against its drafts."""
    d = drafts(s).withColumn("upload", F.floor(C("image") / 10)).withColumn("no", C("image") % 10 * 1000 + C("seq"))
    open_ = d.where(~F.array_contains("warnings", "缺少题干"))
    shown = F.when(C("draft") % 3 == 0, C("stem")).when(C("draft") % 3 == 1, F.left("stem", F.lit(12))).otherwise("")
    e = d.where("answer is not null").select(
        "upload", C("draft").alias("entry"), F.when(C("no") % 4 == 0, 0).when(C("no") % 4 == 1, C("no")).otherwise(C("no") + 1).alias("seq"), shown.alias("hint"), F.array("answer").alias("answer"),
        F.regexp_extract("stem", "[^。]{4,}", 0).alias("analysis"), F.when(C("image") % 2 == 0, "案例").otherwise("").alias("section"),
    )
    scores = answer_scores(open_.select("upload", "draft", C("no").alias("seq"), "stem", "kind"), e)
    ok = scores.join(d.select("upload", "draft", (~C("by_user")).alias("ok")), ["upload", "draft"])
    return match_entries(ok).withColumn("score", F.floor(C("score") * 1_000_000 + 0.5) / 1_000_000)


@query("wqi8_commit", f""", {_DRAFTS} SELECT draft, sha256(kind || chr(10) || stem) AS question_hash, epoch_us(as_of) + 600000000 AS next_review_us FROM dr, now WHERE answer IS NOT NULL AND len(warnings) = 0""")
def commit(s: Source) -> DataFrame:
    """Drafts that are ready and answered become questions, without a look at other banks, and are due for review ten minutes on."""
    d = drafts(s).where((F.size("warnings") == 0) & C("answer").isNotNull()).join(F.broadcast(s.as_of()))  # one row
    return d.select("draft", F.sha2(F.concat_ws("\n", "kind", "stem"), 256).alias("question_hash"), F.unix_micros(add_days(C("as_of"), F.lit(10 / 1440))).alias("next_review_us"))


@query("wqi9_wqi10_wqi13_batch_readiness", f""", {_DRAFTS}, im AS (SELECT session, image, CASE image % 9 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'done' END AS status, count(*) AS n, count(*) FILTER (WHERE answer IS NULL) AS open FROM dr GROUP BY ALL)
    SELECT session, count(*) AS images, CAST(sum(n) AS BIGINT) AS n_drafts, count(*) FILTER (WHERE status <> 'pending') AS finished, CAST(sum(open) AS BIGINT) AS missing, count(*) = 50 AND count(*) FILTER (WHERE status = 'pending') = 0 AS ready FROM im GROUP BY session""")
def readiness(s: Source) -> DataFrame:
    """Images finished (done or failed) of all, drafts, those without an answer; ready when as many images as announced are there and none is pending."""
    status = F.when(C("image") % 9 == 0, "failed").when(C("image") % 9 == 1, "pending").otherwise("done")
    im = drafts(s).groupBy("session", "image", status.alias("status")).agg(F.count("*").alias("n"), F.count_if(C("answer").isNull()).alias("open"))
    waiting = F.count_if(C("status") == "pending")
    return im.groupBy("session").agg(F.count("*").alias("images"), F.sum("n").alias("n_drafts"), F.count_if(C("status") != "pending").alias("finished"), F.sum("open").alias("missing"), ((F.count("*") == 50) & (waiting == 0)).alias("ready"))


@query("wqi14_retry_selection", """SELECT DISTINCT doc_id // 50 AS session, doc_id AS image, doc_id // 5 AS batch FROM documents WHERE lang = 'en' AND doc_id % 4 NOT IN (1, 2)""")
def retry(s: Source) -> DataFrame:
    """Answer-key images (here the English ones) that are neither pending nor being processed, with their batches."""
    status = F.get(F.array(*map(F.lit, ("done", "pending", "processing", "failed"))), (C("doc_id") % 4).cast("int"))
    d = s.table("documents").withColumn("status", status).where((C("lang") == "en") & ~C("status").isin("pending", "processing"))
    return d.select(F.floor(C("doc_id") / 50).alias("session"), C("doc_id").alias("image"), F.floor(C("doc_id") / 5).alias("batch")).distinct()


_LOOSE = r"lower(regexp_replace(stem, '[\p{P}\p{S}\s]', '', 'g'))"


@query("wqi15_stale_answers", f""", {_DRAFTS}, l AS (SELECT session, draft, image, seq, {_LOOSE} AS t, (image + seq) % 5 AS version, by_user FROM dr),
    t AS (SELECT session, draft, by_user, version, t FROM l WHERE length(t) >= 40 UNION ALL SELECT session, draft + 500000, false, 2, substr(t, 11, length(t) - 15) FROM l WHERE length(t) >= 60 AND version = 4)
    SELECT DISTINCT o.draft FROM t o JOIN t n ON o.session = n.session AND n.version = 4 AND o.draft <> n.draft WHERE NOT o.by_user AND (contains(n.t, o.t) OR contains(o.t, n.t)) AND (o.version <= 2 OR o.t = n.t)""")
def stale(s: Source) -> DataFrame:
    """Sample answers: drafts' texts, and of some the inner part that an older reading kept."""
    t = drafts(s).select("session", "draft", "by_user", text.loose(C("stem")).alias("t"), ((C("image") + C("seq")) % 5).alias("version"))
    inner = t.where("version = 4 and char_length(t) >= 60").select("session", (C("draft") + 500_000).alias("draft"), F.lit(False).alias("by_user"), F.substr("t", F.lit(11), F.char_length("t") - 15).alias("t"), F.lit(2).cast("long").alias("version"))
    every = stored(t.where(F.char_length("t") >= 40).unionByName(inner), "answers")  # read several times
    return stale_answers(every, every.where("version = 4"))


def stale_answers(answers: DataFrame, newer: DataFrame) -> DataFrame:
    """(draft): machine answers (session, draft, by_user, t, version) of 40 characters or more that hold a newer answer of the upload, or are held by it, anywhere: cleared
    unless a user set them, or their version is beyond 2 and the texts differ. Texts are compared once for all their copies: of the newer answers with a text
    the first and the last say whether there is another one."""
    dealt = lambda d: d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), "session", "t")  # noqa: E731  few bytes, but much work on each
    old = answers.where((F.char_length("t") >= 40) & ~C("by_user")).select("session", "draft", "version", "t")
    new = dealt(newer.where(F.char_length("t") >= 40).select("session", "draft", "t")).groupBy("session", "t").agg(F.min("draft").alias("lo"), F.max("draft").alias("hi"))
    another = ~((C("lo") == C("draft")) & (C("hi") == C("draft")))  # than itself
    same = old.join(new, ["session", "t"]).where(another).select("draft")
    early = dealt(old.where("version <= 2").select("session", "t")).distinct()
    known = new.select("session", "t")
    inside = joins.contained_texts(early, known, ["session"], "t").select("session", C("needle").alias("h"), C("stack").alias("newer"))
    around = joins.contained_texts(known, early, ["session"], "t").select("session", C("stack").alias("h"), C("needle").alias("newer"))
    ends = inside.unionByName(around).join(new.select("session", F.xxhash64("t").alias("newer"), "lo", "hi"), ["session", "newer"]).groupBy("session", "h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    part = old.where("version <= 2").select("session", "draft", F.xxhash64("t").alias("h")).join(ends, ["session", "h"]).where(another).select("draft")
    return same.unionByName(part).distinct()


@query("wqi16_all_match", f""", {_DRAFTS}, k AS (SELECT session, image, answer, sha256(stem) AS k FROM dr), f AS (SELECT session, k, min(image) AS first FROM k GROUP BY ALL)
    SELECT image, bool_and(first < image) AS all_known, count(*) FILTER (WHERE answer IS NOT NULL) AS with_answer, bool_and(first < image) AND count(*) FILTER (WHERE answer IS NOT NULL) > 0 AS answer_page FROM k JOIN f USING (session, k) GROUP BY image""")
def all_match(s: Source) -> DataFrame:
    """An image all of whose questions an earlier image of the upload holds, and at least one of which carries an answer, is a page of answers."""
    k = drafts(s).select("session", "image", "answer", F.sha2("stem", 256).alias("k"))
    first = k.groupBy("session", "k").agg(F.min("image").alias("first"))
    known, n = F.bool_and(C("first") < C("image")), F.count_if(C("answer").isNotNull())
    return k.join(first, ["session", "k"]).groupBy("image").agg(known.alias("all_known"), n.alias("with_answer"), (known & (n > 0)).alias("answer_page"))


def is_material(stem: Column) -> Column:
    """Two sub-questions or more, and a word that material questions have."""
    return (F.size(F.regexp_extract_all(stem, F.lit(SUB_QUESTION), F.lit(0))) >= 2) & stem.rlike("|".join(MATERIAL_WORDS))


@query("wqi17_material_retyping", f""", {_DRAFTS} SELECT draft, CASE WHEN kind IN ('short_answer', 'essay') AND len(regexp_extract_all(stem, '[（(][0-9０-９]+[）)]')) >= 2 AND regexp_matches(stem, '{"|".join(MATERIAL_WORDS)}') THEN 'material_analysis' ELSE kind END AS kind FROM dr""")
def material(s: Source) -> DataFrame:
    return drafts(s).select("draft", F.when(C("kind").isin("short_answer", "essay") & is_material(C("stem")), "material_analysis").otherwise(C("kind")).alias("kind"))


@query("wqi18_wqi19_mut11_undo", f", {_PAIRS} SELECT left_id, right_id, CASE left_id % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'undone' WHEN 2 THEN 'rejected' ELSE 'accepted' END AS state, sha256(CASE WHEN left_id % 4 = 0 OR left_id % 4 = 3 AND image % 3 > 0 THEN {_MERGED} ELSE lt END) AS stem FROM ov")
def undo(s: Source) -> DataFrame:
    """Merges with the text before them, and what was done about them since, in order: the last action decides. An accepted merge is replayed from the
    text before, unless the draft was edited after it; an undone or rejected one leaves that text."""
    p = pairs(s).withColumn("id", C("left.draft"))
    log = {0: ("accept",), 1: ("accept", "undo"), 2: ("reject",), 3: ("reject", "undo", "accept")}
    acts = F.create_map(*(x for k, v in log.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    p = p.withColumn("last", F.element_at(F.element_at(acts, (C("id") % 4).cast("int")), -1))
    edited = (C("id") % 4 == 3) & (C("image") % 3 == 0)
    state = F.when(C("last") == "accept", "accepted").when(C("last") == "undo", "undone").otherwise("rejected")
    after = F.when((C("last") == "accept") & ~edited, text.merge_fragments(C("left.stem"), C("right.stem"))).otherwise(C("left.stem"))
    return p.select(C("id").alias("left_id"), C("right.draft").alias("right_id"), state.alias("state"), F.sha2(after, 256).alias("stem"))


@query("wqi20_pair_decision", f""", {_PAIRS}, d AS (SELECT *, {_decided('conflict')} AS decision, least(score, CASE image % 3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.5 ELSE 1 END) AS lower_ FROM fin),
    prior AS (SELECT left_id, right_id, CASE image % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'rejected' END AS status, 'separate' AS old FROM pairs WHERE image % 4 < 2)
    SELECT left_id, right_id, CAST(lower_ AS DOUBLE) AS score FROM d LEFT JOIN prior USING (left_id, right_id) WHERE NOT (coalesce(status, '') IN ('accepted', 'pending', 'undone') OR coalesce(status, '') = 'rejected' AND old = decision)""")
def pair_decision(s: Source) -> DataFrame:
    """Pairs to be decided anew: those that an accepted, pending or undone merge covers don't come again, nor do rejected ones whose decision is
    the same. Where a model has scored too, the lower of both counts."""
    d = scored(s).withColumn("decision", decided(C("score"), C("hard"), C("conflict")))
    prior = pairs(s).where("image % 4 < 2").select(C("left.draft").alias("left_id"), C("right.draft").alias("right_id"), F.when(C("image") % 4 == 0, "pending").otherwise("rejected").alias("status"), F.lit("separate").alias("old"))
    model = F.when(C("image") % 3 == 0, 0.95).when(C("image") % 3 == 1, 0.5)
    d = d.select(C("left.draft").alias("left_id"), C("right.draft").alias("right_id"), "decision", F.least("score", F.coalesce(model, F.lit(1.0))).alias("score"))
    settled = prior.where(C("status").isin("accepted", "pending", "undone")).select("left_id", "right_id")
    rejected = prior.where("status = 'rejected'").select("left_id", "right_id", C("old").alias("decision"))
    return d.join(settled, ["left_id", "right_id"], "left_anti").join(rejected, ["left_id", "right_id", "decision"], "left_anti").select("left_id", "right_id", "score")


def balanced(raw: str | None, opening: str = "{", closing: str = "}") -> str | None:
    """The first balanced block of a text, brackets inside JSON strings not counted; from the first bracket on if it never closes."""
    at = -1 if raw is None else raw.find(opening)
    if at < 0:
        return raw
    depth = 0
    for m in re.finditer(rf'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[{re.escape(opening + closing)}]', raw[at:], re.S):  # whole strings, and brackets outside them
        depth += (m[0] == opening) - (m[0] == closing)
        if not depth:
            return raw[at : at + m.end()]
    return raw[at:]


def extracted(outputs: DataFrame) -> DataFrame:
    """(image, position, stem, kind, options, answer): questions of raw model outputs (image, raw), an object with questions or a bare array, with other
    text around. An output without questions, or with one that has no stem, gives none. Choices keep options with contents; other types have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("image", pa.int64()), ("json", pa.string()), ("list", pa.string())])
        for b in batches:
            raw = b.column(1).to_pylist()
            yield pa.RecordBatch.from_pydict({"image": b.column(0), "json": [balanced(x) for x in raw], "list": [balanced(x, "[", "]") for x in raw]}, schema=kind)

    item = "array<struct<stem:string,type:string,options:array<struct<key:string,content:string>>,answer:array<string>>>"
    q = outputs.select(C("image").cast("long"), "raw").mapInArrow(run, "image long, json string, list string")
    q = q.select("image", F.coalesce(F.from_json("json", f"struct<questions:{item}>")["questions"], F.from_json("list", item)).alias("q"))
    q = q.where(~F.exists("q", lambda x: F.trim(F.coalesce(x["stem"], F.lit(""))) == "")).select("image", F.posexplode("q").alias("position", "x"))
    kind = F.coalesce(F.nullif(text.canonical_type(F.coalesce("x.type", F.lit(""))), F.lit("")), F.lit("short_answer"))
    kind = F.when(F.replace("x.type", F.lit("-"), F.lit("_")).isin("short_answer", "essay"), F.when(is_material(C("x.stem")), "material_analysis").otherwise(C("x.type"))).otherwise(kind)
    options = F.when(kind.isin("single_choice", "multiple_choice"), F.filter("x.options", lambda o: F.trim(o["content"]) != ""))
    return q.select("image", "position", F.trim("x.stem").alias("stem"), kind.alias("kind"), options.alias("options"), F.transform("x.answer", lambda a: F.trim(a)).alias("answer"))


@query("wqi1_str24_extraction", f""", {_DRAFTS}, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY image ORDER BY seq) - 1 AS INTEGER) AS position FROM dr)
    SELECT image, position, sha256(trim('q "}}{{" \\ ' || stem)) AS stem, CASE WHEN kind IN ('short_answer', 'essay') AND len(regexp_extract_all(stem, '[（(][0-9０-９]+[）)]')) >= 2 AND regexp_matches(stem, '{"|".join(MATERIAL_WORDS)}') THEN 'material_analysis' ELSE kind END AS kind,
      CASE WHEN kind LIKE '%choice' THEN 1 END AS n_options, answer FROM n WHERE image % 7 <> 3""")
def extraction(s: Source) -> DataFrame:
    """Outputs written from the drafts, in noise, with brackets and quotes inside; every seventh has a question without a stem."""
    option = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("content"))
    q = F.struct(
        F.concat(F.lit('q "}{" \\ '), "stem").alias("stem"), F.when(C("kind") == "single_choice", "single").otherwise(C("kind")).alias("type"), F.array(option("A", F.lit("x")), option("B", F.lit(" "))).alias("options"),
        F.array(F.concat(F.lit(" "), F.coalesce("answer", F.lit("")))).alias("answer"),
    )
    g = drafts(s).groupBy("image").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", q.alias("q")))), lambda r: r["q"]).alias("q"))  # one image's
    blank = F.array(F.struct(F.lit(" ").alias("stem"), F.lit("single").alias("type"), F.get("q", F.lit(0))["options"].alias("options"), F.get("q", F.lit(0))["answer"].alias("answer")))
    q = F.when(C("image") % 7 == 3, F.concat("q", blank)).otherwise(C("q"))
    raw = F.when(C("image") % 2 == 0, F.concat(F.lit("Here is: "), F.to_json(F.struct(q.alias("questions"))), F.lit(" done } ]"))).otherwise(F.concat(F.lit("list "), F.to_json(q), F.lit(" ] end")))
    x = extracted(g.select("image", raw.alias("raw")))
    return x.select("image", "position", F.sha2("stem", 256).alias("stem"), "kind", F.size("options").alias("n_options"), F.nullif(F.get("answer", F.lit(0)), F.lit("")).alias("answer"))


def user_answers(replies: DataFrame, open_drafts: DataFrame) -> DataFrame:
    """(draft, answer, none_needed): answers of free-text replies (session, reply) for drafts (session, seq, draft, kind) that miss one: a number, then letters,
    a sign or word for true or false, or that none is needed; for other types a line's rest. The first that fits a draft counts."""
    digits = lambda x: F.translate(x, "０１２３４５６７８９", "0123456789").try_cast("int")
    part = lambda i: F.regexp_extract_all("reply", F.lit(USER_ANSWER), F.lit(i))
    found = F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), part(4).alias("token"))
    r = replies.select("session", F.posexplode(found).alias("at", "m")).select("session", "at", digits(F.concat("m.a", "m.b", "m.c")).alias("seq"), F.trim("m.token").alias("token"))
    j = r.join(open_drafts, ["session", "seq"])
    t, up = C("token"), F.upper("token")
    none = F.contains("token", F.lit("无")) & (F.contains("token", F.lit("需")) | F.contains("token", F.lit("法")))
    truth = F.when(t.isin("对", "正确", "√", "✓", "○", "T", "t", "true"), F.array(F.lit("对"))).when(t.isin("错", "错误", "×", "✗", "●", "F", "f", "false"), F.array(F.lit("错")))
    letters = F.filter(F.split(up, ""), lambda x: x.rlike("^[A-D]$"))
    value = (
        F.when(C("kind") == "true_false", truth).when(C("kind") == "single_choice", F.when(up.rlike("^[A-D]$"), F.array(up)))
        .when(C("kind") == "multiple_choice", F.when(F.size(letters) > 0, letters)).otherwise(F.array(t))
    )
    j = j.withColumn("none", none).withColumn("value", F.when(~none, value)).where("none or value is not null")
    best = j.groupBy("draft").agg(F.min(F.struct("at", "none", "value")).alias("r"))
    return best.select("draft", F.array_join("r.value", "").alias("answer"), C("r.none").alias("none_needed"))


@query("wqi12_str18_user_replies", f""", {_DRAFTS}, o AS (SELECT session, draft, row_number() OVER (PARTITION BY session ORDER BY draft) AS seq, CASE kind WHEN 'essay' THEN 'true_false' ELSE kind END AS kind FROM dr WHERE answer IS NULL)
    SELECT draft, CASE seq % 5 WHEN 3 THEN NULL ELSE CASE kind WHEN 'true_false' THEN '对' WHEN 'single_choice' THEN 'B' WHEN 'multiple_choice' THEN 'AC' ELSE 'Tx' END END AS answer, seq % 5 = 3 AS none_needed FROM o WHERE seq % 5 <> 4""")
def replies(s: Source) -> DataFrame:
    """One reply an upload, in four spellings of a number; a fifth of the open drafts gets an answer that doesn't fit its type."""
    o = windows.renumber(drafts(s).where("answer is null"), ["session"], ["draft"], "seq").select("session", "draft", "seq", F.when(C("kind") == "essay", "true_false").otherwise(C("kind")).alias("kind"))
    n = C("seq").cast("string")
    number = F.get(F.array(F.concat(n, F.lit(".")), F.concat(F.lit("第 "), n, F.lit(" 题选")), F.concat(F.lit("Q"), n, F.lit(":")), F.concat(F.translate(n, "0123456789", "０１２３４５６７８９"), F.lit("、答案是"))), (C("seq") % 4).cast("int"))
    fits = F.when(C("kind") == "true_false", "√").when(C("kind") == "single_choice", "b").when(C("kind") == "multiple_choice", "AxC").otherwise("Tx")
    said = F.when(C("seq") % 5 == 3, "无需").when(C("seq") % 5 == 4, F.when(C("kind") == "short_answer", "").otherwise("zz")).otherwise(fits)
    rows = F.sort_array(F.collect_list(F.struct("seq", F.concat(number, F.lit(" "), said).alias("x"))))  # one upload's
    r = o.groupBy("session").agg(F.array_join(F.transform(rows, lambda x: x["x"]), "；\n").alias("reply"))
    got = user_answers(r, o)
    return got.select("draft", F.when(~C("none_needed"), C("answer")).alias("answer"), "none_needed")
