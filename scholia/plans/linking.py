"""Linking answers to questions: joins that refuse to guess, directories, gaps, and what to read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scholia.adapters import Source
from scholia.functions.numbers import ratio, round_away
from scholia.functions.tables import RUN_STAGES
from scholia.functions.text import compact
from scholia.operators import joins, sets, windows
from scholia.registry import query

C = F.col
KEY = ["section_scope", "set_no", "question_type", "question_no"]


def _equal(*cols: str) -> Column:
    out = F.lit(True)
    for c in cols:
        out &= C(c) == C(f"r_{c}")
    return out


@query("join2_star", """SELECT n_name, r_name, count(*) AS n_orders, CAST(sum(o_totalprice) * 100 AS BIGINT) AS cents FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL""".replace("CAST(sum(o_totalprice) * 100 AS BIGINT)", "CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT)"))
def star(s: Source) -> DataFrame:
    """Facts with three dimensions; Catalyst broadcasts those it measures to be small."""
    o = s.table("orders").join(s.table("customer"), C("c_custkey") == C("o_custkey")).join(s.table("nation"), C("n_nationkey") == C("c_nationkey")).join(s.table("region"), C("r_regionkey") == C("n_regionkey"))
    return o.groupBy("n_name", "r_name").agg(F.count("*").alias("n_orders"), F.sum(F.round(C("o_totalprice") * 100).cast("long")).alias("cents"))


@query("join3_composite", "SELECT c.id AS candidate_id, a.id AS answer_id FROM candidates c JOIN answers a USING (section_scope, set_no, question_type, question_no)")
def composite(s: Source) -> DataFrame:
    return s.candidates().withColumnRenamed("id", "candidate_id").join(s.answers().select(C("id").alias("answer_id"), *KEY), KEY).select("candidate_id", "answer_id")


@query("join5_join7_missing_answers", "SELECT id FROM candidates ANTI JOIN answers USING (section_scope, set_no, question_type, question_no)")
def missing_answers(s: Source) -> DataFrame:
    return s.candidates().join(s.answers(), KEY, "left_anti").select("id")


@query("join11_first_answer", "SELECT c.id, a.id AS answer_id, a.value FROM candidates c LEFT JOIN (SELECT * FROM answers QUALIFY row_number() OVER (PARTITION BY section_scope, question_no ORDER BY confidence DESC, id) = 1) a USING (section_scope, question_no)")
def first_answer(s: Source) -> DataFrame:
    best = windows.first_row(s.answers(), ["section_scope", "question_no"], [F.desc("confidence"), "id"]).select(C("id").alias("answer_id"), "section_scope", "question_no", "value")
    return s.candidates().join(best, ["section_scope", "question_no"], "left").select("id", "answer_id", "value")


@query("join12_either_key", """SELECT c.id, a.id AS answer_id FROM candidates c JOIN answers a ON c.section_path = a.section_path AND c.question_no = a.question_no OR (c.section_scope = a.section_scope AND c.question_type = a.question_type AND c.question_no = a.question_no)""")
def either(s: Source) -> DataFrame:
    pairs = joins.either_join(s.candidates(), s.answers(), _equal("section_path", "question_no"), _equal("section_scope", "question_type", "question_no"))
    return pairs.select("id", C("r_id").alias("answer_id"))


@query("join13_array_membership", "SELECT c.id, d.doc AS directory_document FROM candidates c JOIN (SELECT DISTINCT document_id AS doc, section_scope, unnest(range(question_no, question_no + 3)) AS n FROM directory) d ON d.n = c.question_no AND d.section_scope = c.section_scope")
def membership(s: Source) -> DataFrame:
    """Candidates whose number stands in an array of missing numbers: the array is exploded into an equality."""
    d = s.directory().select(C("document_id").alias("directory_document"), "section_scope", F.explode(F.sequence(C("question_no"), C("question_no") + 2)).alias("question_no")).distinct()
    return s.candidates().join(d, ["section_scope", "question_no"]).select("id", "directory_document")


@query("join14_tolerant_set", "SELECT c.id, a.id AS answer_id FROM candidates c JOIN answers a USING (section_scope, question_type, question_no) WHERE c.set_no = a.set_no OR c.set_no = 0 OR a.set_no = 0")
def tolerant_set(s: Source) -> DataFrame:
    a, b = joins._aliased(s.candidates(), s.answers())
    return a.join(b, _equal("section_scope", "question_type", "question_no") & joins.tolerant(C("set_no"), C("r_set_no"))).select("id", C("r_id").alias("answer_id"))


@query("join15_overlap", "SELECT c.id, a.id AS answer_id FROM candidates c JOIN answers a USING (document_id) WHERE c.page_end >= a.page_start AND c.page_start <= a.page_end")
def overlap(s: Source) -> DataFrame:
    return joins.overlap_join(s.candidates(), s.answers(), "document_id", "page_start", "page_end").select("id", C("r_id").alias("answer_id"))


@query("join16_lnk20_containment", "SELECT c.id, a.id AS answer_id FROM candidates c JOIN answers a USING (document_id) WHERE a.page_start >= c.page_start AND a.page_end <= c.page_end")
def containment(s: Source) -> DataFrame:
    both = joins.overlap_join(s.candidates(), s.answers(), "document_id", "page_start", "page_end")
    return both.where("r_page_start >= page_start and r_page_end <= page_end").select("id", C("r_id").alias("answer_id"))


@query("join17_lnk1_unique", "SELECT c.id, min(a.id) AS answer_id FROM candidates c JOIN answers a USING (section_scope, question_type, question_no) GROUP BY c.id HAVING count(*) = 1")
def unique(s: Source) -> DataFrame:
    place = [C("section_scope"), C("question_type"), C("question_no")]
    return _only(joins.cascade_totals(s.candidates(), s.answers(), [joins.Rung(1, place, place)], _counted)).select("id", C("r_id").alias("answer_id"))


def _counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("r_id"))


def _only(met: DataFrame) -> DataFrame:
    """(id, r_id) of those whose strongest tier holds exactly one row."""
    tiers = met.groupBy("id", "tier").agg(F.sum("n").alias("n"), F.min("r_id").alias("r_id"))
    return tiers.groupBy("id").agg(F.min(F.struct("tier", "n", "r_id")).alias("t")).where("t.n = 1").select("id", "t.r_id")


def rungs() -> list[joins.Rung]:
    """From the strongest key on: canonical, section path, terminal with set, terminal, scope with a tolerant set, scope, number in an order of its own.

    The tolerant set (equal, or either is 0) is three equalities that exclude one another."""
    last, zero = F.element_at(F.split("section_path", "/"), -1), C("set_no").eqNullSafe(F.lit(0))
    same = lambda tier, *keys, **where: joins.Rung(tier, list(keys), list(keys), **where)
    kind, number, scope, numbered = C("question_type"), C("question_no"), C("section_scope"), C("set_no")
    return [
        same(1, scope, numbered, kind, number), same(2, C("section_path"), kind, number), same(3, last, numbered, kind, number), same(4, last, kind, number),
        same(5, scope, numbered, kind, number), same(5, scope, kind, number, left_where=zero, right_where=~zero), same(5, scope, kind, number, left_where=~zero, right_where=zero), same(6, scope, number),
    ]


METHODS = ("canonical", "section_path", "terminal_set", "terminal", "scope_tolerant", "scope")


_CASCADE = """pairs AS (
  SELECT c.id, a.id AS answer_id, a.value, a.run_id, CASE
    WHEN c.section_scope = a.section_scope AND c.set_no = a.set_no AND c.question_type = a.question_type THEN 1
    WHEN c.section_path = a.section_path AND c.question_type = a.question_type THEN 2
    WHEN split_part(c.section_path, '/', -1) = split_part(a.section_path, '/', -1) AND c.set_no = a.set_no AND c.question_type = a.question_type THEN 3
    WHEN split_part(c.section_path, '/', -1) = split_part(a.section_path, '/', -1) AND c.question_type = a.question_type THEN 4
    WHEN c.section_scope = a.section_scope AND c.question_type = a.question_type AND (c.set_no = a.set_no OR c.set_no = 0 OR a.set_no = 0) THEN 5
    WHEN c.section_scope = a.section_scope THEN 6 END AS tier
  FROM candidates c JOIN answers a USING (question_no)),
links AS (SELECT * FROM pairs WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY id))"""
_NAMES = "['canonical', 'section_path', 'terminal_set', 'terminal', 'scope_tolerant', 'scope'][tier]"


def _values(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A key's answers: the latest run with the least and the greatest value in it, and those of all runs. Values are one if the two are equal."""
    runs = rows.groupBy(*keys, "run_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return runs.groupBy(*keys).agg(F.max(F.when(C("run_id").isNotNull(), F.struct("run_id", "lo", "hi"))).alias("last"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def linked(s: Source) -> DataFrame:
    """(id, tier, found): what the answers of the strongest key that has any say, a row for each candidate with answers; found holds a struct (last, lo, hi) for each key of that tier."""
    met = joins.cascade_totals(s.candidates(), s.answers(), rungs(), _values)
    g = met.groupBy("id").agg(F.min("tier").alias("tier"), F.collect_list(F.struct("tier", "last", "lo", "hi")).alias("found"))  # as many as there are rungs
    return g.select("id", "tier", F.filter("found", lambda x: x["tier"] == C("tier")).alias("found"))


@query("join18_lnk5_cascade", f", {_CASCADE} SELECT id, answer_id, {_NAMES} AS method FROM links")
def cascade(s: Source) -> DataFrame:
    candidates = s.candidates().select("id", "section_scope", "section_path", "set_no", "question_type", "question_no")
    method = F.element_at(F.array(*map(F.lit, METHODS)), C("tier"))
    return joins.cascade_join(candidates, s.answers().drop("value", "run_id", "confidence", "page_start", "page_end", "document_id"), rungs()).select("id", C("r_id").alias("answer_id"), method.alias("method"))


@query("lnk8_lnk9_lnk10_decide", f""", {_CASCADE}, latest AS (SELECT * FROM links QUALIFY run_id = max(run_id) OVER (PARTITION BY id))
    SELECT c.id, CASE WHEN n IS NULL THEN 'ANSWER_MISSING' WHEN n = 1 THEN 'confirmed' ELSE 'ANSWER_CONFLICT' END AS decision, CASE WHEN n = 1 THEN value END AS value, CASE WHEN n = 1 THEN CASE WHEN tier = 1 THEN 0.98 WHEN tier = 6 THEN 0.88 ELSE 1.0 END END AS confidence
    FROM candidates c LEFT JOIN (SELECT id, count(DISTINCT value) AS n, min(value) AS value, min(tier) AS tier FROM latest GROUP BY id) l USING (id)""".replace("0.98", "CAST(0.98 AS DOUBLE)").replace("0.88", "CAST(0.88 AS DOUBLE)").replace("ELSE 1.0", "ELSE CAST(1 AS DOUBLE)"))
def decide(s: Source) -> DataFrame:
    """Answers of the latest run count; one distinct value confirms, several conflict."""
    last = F.filter(F.transform("found", lambda x: x["last"]), lambda x: x["run_id"].isNotNull())
    run = F.array_max(F.transform(last, lambda x: x["run_id"]))
    l = linked(s).withColumn("last", F.filter(last, lambda x: x["run_id"] == run)).where("size(last) > 0")  # noqa: E741
    lo, hi = F.array_min(F.transform("last", lambda x: x["lo"])), F.array_max(F.transform("last", lambda x: x["hi"]))
    g = l.select("id", "tier", lo.alias("value"), F.when(lo == hi, 1).otherwise(F.when(lo.isNull(), 0).otherwise(2)).alias("n"))
    x = s.candidates().select("id").join(g, "id", "left")
    decision = F.when(C("n").isNull(), "ANSWER_MISSING").when(C("n") == 1, "confirmed").otherwise("ANSWER_CONFLICT")
    confidence = F.when(C("tier") == 1, 0.98).when(C("tier") == 6, 0.88).otherwise(F.lit(1.0))
    return x.select("id", decision.alias("decision"), F.when(C("n") == 1, C("value")).alias("value"), F.when(C("n") == 1, confidence).alias("confidence"))


@query("lnk18_exact_linking", """SELECT c.id, CASE WHEN n = 1 THEN 'linked' WHEN n > 1 THEN 'ANSWER_CONFLICT' WHEN c.question_type = 'single_choice' THEN 'ANSWER_REQUIRED' ELSE 'open' END AS outcome
    FROM candidates c LEFT JOIN (SELECT section_path, set_no, question_type, question_no, count(DISTINCT value) AS n FROM answers GROUP BY ALL) USING (section_path, set_no, question_type, question_no)""")
def exact(s: Source) -> DataFrame:
    k = ["section_path", "set_no", "question_type", "question_no"]
    n = s.answers().groupBy(*k).agg(F.count_distinct("value").alias("n"))
    outcome = F.when(C("n") == 1, "linked").when(C("n") > 1, "ANSWER_CONFLICT").when(C("question_type") == "single_choice", "ANSWER_REQUIRED").otherwise("open")
    return s.candidates().join(n, k, "left").select("id", outcome.alias("outcome"))


@query("agg20_lnk4_canonical_answer", "SELECT section_scope, set_no, question_type, question_no, arg_max(id, (CAST(confidence > 0 AS INTEGER), run_id, id)) AS answer_id, count(DISTINCT value) > 1 AS conflict FROM answers GROUP BY ALL".replace("arg_max(id, (CAST(confidence > 0 AS INTEGER), run_id, id))", "(list(id ORDER BY confidence > 0 DESC, run_id DESC, id DESC))[1]"))
def canonical(s: Source) -> DataFrame:
    """The winner of each key: trusted first, then the latest run, then the highest id."""
    best = F.max_by("id", F.struct((C("confidence") > 0).alias("t"), "run_id", "id"))
    return s.answers().groupBy(*KEY).agg(best.alias("answer_id"), (F.count_distinct("value") > 1).alias("conflict"))


@query("lnk6_subtype_filter", """, p AS (SELECT c.id, a.id AS answer_id, CASE WHEN c.question_type = a.question_type THEN 1 WHEN a.question_type = 'subjective' THEN 2 ELSE 3 END AS tier FROM candidates c JOIN answers a USING (section_scope, question_no)) SELECT id, answer_id FROM p QUALIFY tier = min(tier) OVER (PARTITION BY id)""")
def subtype(s: Source) -> DataFrame:
    """Answers of the same type if there are any, else those without a special one, else all."""
    place, plain = [C("section_scope"), C("question_no")], C("question_type").eqNullSafe(F.lit("subjective"))
    rungs = [joins.Rung(1, [*place, C("question_type")], [*place, C("question_type")]), joins.Rung(2, place, place, right_where=plain), joins.Rung(3, place, place, right_where=~plain)]
    keep = ("id", "section_scope", "question_no", "question_type")
    return joins.cascade_join(s.candidates().select(*keep), s.answers().select(*keep), rungs).select("id", C("r_id").alias("answer_id"))


@query("join19_terminal", """, t AS (SELECT split_part(section_path, '/', -1) AS terminal, count(DISTINCT section_scope) AS n, min(section_scope) AS scope FROM candidates GROUP BY 1)
    SELECT a.id, scope AS resolved FROM answers a JOIN t ON a.section_scope = t.terminal WHERE n = 1""")
def terminal(s: Source) -> DataFrame:
    t = s.candidates().groupBy(F.element_at(F.split("section_path", "/"), -1).alias("terminal")).agg(F.count_distinct("section_scope").alias("n"), F.min("section_scope").alias("resolved")).where("n = 1")
    return s.answers().join(t, C("section_scope") == C("terminal")).select("id", "resolved")


_MARK = "translate(lpad(CAST(({}) AS VARCHAR), 6, '0'), '0123456789', 'qjxzkvbwyp')"
_PREFIX = f""", st AS (SELECT id, section_scope, set_no, stem || ' ' || {_MARK.format('id')} AS t FROM candidates),
    en AS (SELECT id, section_scope, set_no, CASE id % 3 WHEN 0 THEN anchor || ' ' || {_MARK.format('id')} WHEN 1 THEN left(anchor || ' ' || {_MARK.format('id')}, 15) ELSE 'see ' || anchor || ' ' || {_MARK.format('id + 7')} END AS t FROM directory),
    p AS (SELECT c.id, d.id AS directory_id, CASE WHEN contains(c.t, d.t) OR contains(d.t, c.t) THEN 1.0 ELSE CAST(len(list_filter(range(1, least(len(c.t), len(d.t)) + 1), lambda i: left(c.t, i) = left(d.t, i))) AS DOUBLE) / least(len(c.t), len(d.t)) END AS score
      FROM st c JOIN en d ON c.section_scope = d.section_scope AND c.set_no = d.set_no),
    r AS (SELECT *, row_number() OVER w AS k, coalesce(lead(score) OVER w, 0) AS second FROM p WINDOW w AS (PARTITION BY id ORDER BY score DESC, directory_id))
    SELECT id, directory_id FROM r WHERE k = 1 AND score >= 0.75 AND score > second + 0.1"""


@query("join20_win16_prefix_pick", _PREFIX)
def prefix_pick(s: Source) -> DataFrame:
    """The directory entry whose anchor a stem holds, or shares most of its beginning with: at least 0.75, and 0.1 ahead of the next."""
    mark = lambda k: F.translate(F.lpad(k.cast("string"), 6, "0"), "0123456789", "qjxzkvbwyp")
    said = F.concat_ws(" ", "anchor", mark(C("id")))
    anchor = F.when(C("id") % 3 == 0, said).when(C("id") % 3 == 1, F.left(said, F.lit(15))).otherwise(F.concat_ws(" ", F.lit("see"), "anchor", mark(C("id") + 7)))
    stems = s.candidates().withColumn("t", F.concat_ws(" ", "stem", mark(C("id"))))
    return joins.clear_beginning(stems, s.directory().withColumn("t", anchor), ["section_scope", "set_no"], "t").select("id", C("r_id").alias("directory_id"))


@query("win3_fill_scope", """SELECT id, coalesce(last_value(nullif(section_scope, '') IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page_start, marker_top, id), '') AS scope FROM directory""")
def fill_scope(s: Source) -> DataFrame:
    d = s.directory().withColumn("stored", F.lit(""))
    return windows.fill_with_seed(d, ["document_id"], ["page_start", "marker_top", "id"], "section_scope", "stored", "scope").select("id", "scope")


@query("win4_fill_stored", """SELECT id, coalesce(last_value(coalesce(CASE WHEN content_role = 'answer' THEN anchor END, nullif(section_scope, '')) IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page_start, marker_top, id), '') AS scope FROM directory""")
def fill_stored(s: Source) -> DataFrame:
    d = s.directory().withColumn("stored", F.when(C("content_role") == "answer", C("anchor")).otherwise(""))
    return windows.fill_stored_first(d, ["document_id"], ["page_start", "marker_top", "id"], "section_scope", "stored", "scope").select("id", "scope")


@query("win5_normalise_scopes", """SELECT id, coalesce(last_value(CASE WHEN section_scope NOT IN ('', 'Brand#1') THEN section_scope END IGNORE NULLS) OVER (PARTITION BY document_id, content_role = 'question' ORDER BY page_start, marker_top, id), section_scope, '') AS section_scope FROM directory""")
def normalise(s: Source) -> DataFrame:
    return windows.normalise_scopes(s.directory(), ["Brand#1"]).select("id", "section_scope")


@query("win6_repair_types", """, o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_start, marker_top, id) AS k FROM directory),
    f AS (SELECT document_id, k, id, section_scope, question_no, page_end, question_type, set_no FROM o WHERE k = 1 UNION ALL
      SELECT o.document_id, o.k, o.id, o.section_scope, o.question_no, o.page_end, CASE WHEN o.section_scope = f.section_scope AND o.question_no = f.question_no + 1 AND o.page_start <= f.page_end + 1 THEN f.question_type ELSE o.question_type END,
        CASE WHEN o.section_scope = f.section_scope AND o.question_no = f.question_no + 1 AND o.page_start <= f.page_end + 1 THEN f.set_no ELSE o.set_no END FROM f JOIN o ON o.document_id = f.document_id AND o.k = f.k + 1)
    SELECT id, question_type, CAST(set_no AS INTEGER) AS set_no FROM f""")
def repaired(s: Source) -> DataFrame:
    return windows.repair_types(s.directory()).select("id", "question_type", "set_no")


@query("win7_gaps", """, d AS (SELECT id // 30 AS document_id, id % 30 AS question_no FROM directory WHERE content_role = 'question'), g AS (SELECT document_id, list(DISTINCT question_no) AS v, min(question_no) AS lo, max(question_no) AS hi FROM d GROUP BY document_id)
    SELECT document_id, missing FROM (SELECT document_id, unnest(list_filter(range(lo, hi + 1), lambda x: NOT list_contains(v, x))) AS missing FROM g WHERE len(v) >= 3 AND hi - lo + 1 <= len(v) + 10)""")
def gaps(s: Source) -> DataFrame:
    """Documents of thirty entries each, whose answers leave holes between the numbers of the questions."""
    d = s.directory().where("content_role = 'question'").withColumn("document_id", F.floor(C("id") / 30)).withColumn("question_no", C("id") % 30)
    return windows.interior_gaps(d, ["document_id"], "question_no", "page_start").select("document_id", "missing")


@query("win9_tail_extension", """, top AS (SELECT document_id, max(question_no) AS t FROM directory WHERE content_role = 'question' GROUP BY document_id),
    m AS (SELECT id, question_no, t, dense_rank() OVER (PARTITION BY document_id ORDER BY question_no) AS k FROM directory JOIN top USING (document_id) WHERE content_role = 'answer' AND question_no > t)
    SELECT id FROM m WHERE question_no = t + k""")
def tail(s: Source) -> DataFrame:
    d = s.directory()
    return windows.tail_extension(d.where("content_role = 'question'"), d.where("content_role = 'answer'"), ["document_id"], "question_no").select("id")


@query("win14_lnk14_merged_ranges", """, r AS (SELECT document_id, page_start, page_end FROM candidates ANTI JOIN answers USING (section_scope, set_no, question_type, question_no)),
    m AS (SELECT *, CASE WHEN page_start <= max(page_end) OVER (PARTITION BY document_id ORDER BY page_start, page_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM r),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY document_id ORDER BY page_start, page_end ROWS UNBOUNDED PRECEDING) AS g FROM m)
    SELECT document_id, min(page_start) AS page_start, max(page_end) AS page_end FROM g GROUP BY document_id, g""")
def retry_ranges(s: Source) -> DataFrame:
    """Pages to read again for candidates without an answer, neighbouring ranges as one."""
    r = s.candidates().join(s.answers(), KEY, "left_anti").select("document_id", "page_start", "page_end")
    return windows.merge_intervals(r, ["document_id"], "page_start", "page_end").select("document_id", F.col("page_start").cast("long").alias("page_start"), F.col("page_end").cast("long").alias("page_end"))


@query("win19_lnk3_dedup_priority", """SELECT id, document_id, question_no FROM directory QUALIFY row_number() OVER (PARTITION BY document_id, section_scope, question_no ORDER BY (CASE WHEN content_role = 'question' THEN 4 ELSE 0 END + CASE WHEN set_no > 0 THEN 2 ELSE 0 END) DESC, id) = 1""")
def dedup(s: Source) -> DataFrame:
    weight = F.when(C("content_role") == "question", 4).otherwise(0) + F.when(C("set_no") > 0, 2).otherwise(0)
    return windows.first_row(s.directory(), ["document_id", "section_scope", "question_no"], [F.desc(weight), "id"]).select("id", "document_id", "question_no")


@query("lnk2_lnk21_rekey", """, p AS (SELECT c.id, d.id AS directory_id, CASE WHEN c.question_type = 'single_choice' AND d.question_type = 'single' OR c.question_type = 'true_false' AND d.question_type = 'judge' OR c.question_type = 'subjective' AND d.question_type = 'essay' THEN 1 ELSE 2 END AS tier
      FROM candidates c JOIN directory d USING (section_scope, set_no, question_no)), t AS (SELECT * FROM p QUALIFY tier = min(tier) OVER (PARTITION BY id))
    SELECT id, min(directory_id) AS directory_id FROM t GROUP BY id HAVING count(*) = 1""")
def rekey(s: Source) -> DataFrame:
    """The directory entry of a candidate: one of its type if any, else any; kept only where that tier has exactly one."""
    from scholia.functions.text import canonical_type

    place = [C("section_scope"), C("set_no"), C("question_no")]
    d = s.directory().withColumn("question_type", canonical_type(C("question_type")))
    typed = [*place, C("question_type")]
    return _only(joins.cascade_totals(s.candidates(), d, [joins.Rung(1, typed, typed), joins.Rung(2, place, place)], _counted)).select("id", C("r_id").alias("directory_id"))


@query("lnk12_session_reconcile", """SELECT id, CASE WHEN k = 1 THEN 'kept' WHEN stem = first_stem THEN 'duplicate' ELSE 'conflict' END AS outcome
    FROM (SELECT id, stem, row_number() OVER w AS k, first_value(stem) OVER w AS first_stem FROM candidates WINDOW w AS (PARTITION BY section_scope, set_no, question_type, question_no ORDER BY id))""")
def reconcile(s: Source) -> DataFrame:
    w = W.partitionBy(*KEY).orderBy("id")
    x = s.candidates().withColumn("k", F.row_number().over(w)).withColumn("f", F.first("stem").over(w))
    return x.select("id", F.when(C("k") == 1, "kept").when(C("stem") == C("f"), "duplicate").otherwise("conflict").alias("outcome"))


@query("lnk13_cor7_commit_gate", f""", {_CASCADE}, d AS (SELECT c.document_id, c.id, count(DISTINCT value) AS n, any_value(c.question_type) AS t FROM candidates c LEFT JOIN links l ON l.id = c.id GROUP BY c.document_id, c.id), e AS (SELECT document_id // 5 AS document_id, count(*) AS expected FROM directory WHERE content_role = 'question' GROUP BY 1)
    SELECT document_id, coalesce(total, 0) AS total, expected, coalesce(blocking, 0) AS blocking, CASE WHEN total > 0 AND total = expected AND blocking = 0 THEN 'draft_ready' ELSE 'needs_attention' END AS status
    FROM e LEFT JOIN (SELECT document_id, count(*) AS total, count(*) FILTER (WHERE n > 1 OR n = 0 AND t <> 'subjective') AS blocking FROM d GROUP BY document_id) USING (document_id)""")
def gate(s: Source) -> DataFrame:
    """A document may be committed when it has candidates, as many as its directory lists, and none blocks: by a conflict, or by a missing answer that its type needs."""
    n = linked(s).select("id", F.array_min(F.transform("found", lambda x: x["lo"])).alias("lo"), F.array_max(F.transform("found", lambda x: x["hi"])).alias("hi"))
    blocks = F.coalesce(C("lo") < C("hi"), F.lit(False)) | (C("lo").isNull() & (C("question_type") != "subjective"))
    g = s.candidates().join(n, "id", "left").groupBy("document_id").agg(F.count("*").alias("total"), F.count_if(blocks).alias("blocking"))
    e = s.directory().where("content_role = 'question'").groupBy(F.floor(C("document_id") / 5).alias("document_id")).agg(F.count("*").alias("expected"))
    j = e.join(g, "document_id", "left").select("document_id", F.coalesce("total", F.lit(0)).alias("total"), "expected", F.coalesce("blocking", F.lit(0)).alias("blocking"))
    return j.withColumn("status", F.when((C("total") > 0) & (C("total") == C("expected")) & (C("blocking") == 0), "draft_ready").otherwise("needs_attention"))


@query("lnk15_agg22_agg26_review_plan", """SELECT document_id, count(*) FILTER (WHERE content_role = 'question') AS questions, count(*) FILTER (WHERE content_role = 'answer') AS answers, CASE WHEN count(*) FILTER (WHERE content_role = 'question') >= count(*) FILTER (WHERE content_role = 'answer') THEN 'question' ELSE 'answer' END AS role,
    CAST(greatest(count(*) FILTER (WHERE content_role = 'question'), count(*) FILTER (WHERE content_role = 'answer')) AS DOUBLE) / count(*) AS role_confidence, CAST(min(page_start) AS BIGINT) AS page_start, CAST(max(page_end) AS BIGINT) AS page_end FROM directory GROUP BY document_id""")
def review_plan(s: Source) -> DataFrame:
    q, a = F.count_if(C("content_role") == "question"), F.count_if(C("content_role") == "answer")
    return s.directory().groupBy("document_id").agg(
        q.alias("questions"), a.alias("answers"), F.when(q >= a, "question").otherwise("answer").alias("role"), (F.greatest(q, a) / F.count("*")).alias("role_confidence"),
        F.min("page_start").cast("long").alias("page_start"), F.max("page_end").cast("long").alias("page_end"),
    )


@query("lnk16_orphan_pages", """, o AS (SELECT a.document_id, a.section_scope, a.question_no, a.page_start, a.page_end FROM answers a ANTI JOIN candidates USING (section_scope, set_no, question_type, question_no))
    SELECT document_id, section_scope, question_no, min(page_start) AS page_start, max(page_end) AS page_end FROM o GROUP BY ALL HAVING max(page_end) - min(page_start) + 1 <= 16""")
def orphans(s: Source) -> DataFrame:
    o = s.answers().join(s.candidates(), KEY, "left_anti")
    g = o.groupBy("document_id", "section_scope", "question_no").agg(F.min("page_start").cast("long").alias("page_start"), F.max("page_end").cast("long").alias("page_end"))
    return g.where("page_end - page_start + 1 <= 16")


@query("lnk17_agg16_agg17_listing", """SELECT section_scope, question_no, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids, to_json(list({'id': id, 'value': value} ORDER BY id)) AS nested FROM answers GROUP BY ALL""")
def listing(s: Source) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("id", "value")))
    return s.answers().groupBy("section_scope", "question_no").agg(F.array_join(F.transform(rows, lambda r: r["id"].cast("string")), ",").alias("ids"), F.to_json(rows).alias("nested"))


@query("lnk25_retyping", """, q AS (SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN '以下为 单项选择 ' WHEN 1 THEN '多项 选择：' ELSE '' END || p_name AS stem, CASE p_size % 3 WHEN 0 THEN 0 ELSE p_size % 5 END AS n FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 2 = 1)
    SELECT id, CASE WHEN n >= 2 AND contains(replace(stem, ' ', ''), '单项选择') THEN 'single_choice' WHEN n >= 2 AND contains(replace(stem, ' ', ''), '多项选择') THEN 'multiple_choice' WHEN n = 0 THEN 'subjective' ELSE 'case_study' END AS kind FROM q""".replace(" WHERE p_partkey % 2 = 0 OR p_partkey % 2 = 1", ""))
def retype(s: Source) -> DataFrame:
    """Questions of case-study blocks: with two options or more by the kind of choice that their stem names, without any subjective; else as they are."""
    head = F.when(C("p_size") % 4 == 0, "以下为 单项选择 ").when(C("p_size") % 4 == 1, "多项 选择：").otherwise("")
    n = F.when(C("p_size") % 3 == 0, 0).otherwise(C("p_size") % 5)
    return s.table("part").select(C("p_partkey").alias("id"), case_kind(F.concat(head, "p_name"), n).alias("kind"))


def case_kind(stem: Column, n_options: Column) -> Column:
    x = compact(stem)
    return F.when((n_options >= 2) & F.contains(x, F.lit("单项选择")), "single_choice").when((n_options >= 2) & F.contains(x, F.lit("多项选择")), "multiple_choice").when(n_options == 0, "subjective").otherwise("case_study")


_SAID = ("请重新读取整份题目", "删除第3题", "先预检", "答案呢 第 12 页", "漏了48题", "重读 5 到 7 页", "你好", "全部解析一遍", "补第 9 页", "解析 2 3")


@query("lnk29_intent", f""", c AS (SELECT conv_id, turn, [{", ".join(f"'{x}'" for x in _SAID)}][(conv_id + turn) % {len(_SAID)} + 1] || ' ' || coalesce(role, '') AS x FROM conversations)
    SELECT conv_id, turn, CASE WHEN regexp_matches(x, '整份|全部|重新开始|读取.*题目|题目.*读取') AND regexp_matches(x, '识别|解析|读取') THEN 'start_full_extraction' WHEN contains(x, '删除') THEN 'propose_delete_candidates' WHEN contains(x, '预检') THEN 'preview_draft'
      WHEN regexp_matches(x, '答案|解析') THEN 'relink_answers' WHEN regexp_matches(x, '少|漏|补') THEN 'recover_missing_questions' WHEN regexp_matches(x, '重|页') THEN 'retry_pages' ELSE 'explain_status' END AS intent,
      CASE WHEN contains(x, '页') THEN CASE WHEN len(regexp_extract_all(x, '[0-9]+')) = 1 THEN regexp_extract_all(x, '[0-9]+')[1] || '-' || regexp_extract_all(x, '[0-9]+')[1] WHEN len(regexp_extract_all(x, '[0-9]+')) > 1 THEN regexp_extract_all(x, '[0-9]+')[1] || '-' || regexp_extract_all(x, '[0-9]+')[2] END END AS pages FROM c""")
def intents(s: Source) -> DataFrame:
    said = F.concat_ws(" ", F.get(F.array(*map(F.lit, _SAID)), ((C("conv_id") + C("turn")) % len(_SAID)).cast("int")), F.coalesce("role", F.lit("")))
    i = intent(said)
    return s.table("conversations").select("conv_id", "turn", i["intent"].alias("intent"), i["pages"].alias("pages"))


def intent(said: Column) -> Column:
    """struct(intent, pages): ordered keyword rules; numbers are a page range only where pages are spoken of, so "48 questions" names none."""
    has = lambda *words: said.rlike("|".join(words))
    whole = (has("整份", "全部", "重新开始") | (has("读取") & has("题目"))) & has("识别", "解析", "读取")
    kind = (
        F.when(whole, "start_full_extraction").when(has("删除"), "propose_delete_candidates").when(has("预检"), "preview_draft").when(has("答案", "解析"), "relink_answers")
        .when(has("少", "漏", "补"), "recover_missing_questions").when(has("重", "页"), "retry_pages").otherwise("explain_status")
    )
    n = F.filter(F.regexp_extract_all(said, F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("int") > 0)
    pages = F.when(has("页") & (F.size(n) > 0), F.concat(F.get(n, F.lit(0)), F.lit("-"), F.coalesce(F.get(n, F.lit(1)), F.get(n, F.lit(0)))))
    return F.struct(kind.alias("intent"), pages.alias("pages"))


@query("flt10_interval_validity", "SELECT id, CASE WHEN page_start <= 0 OR page_end < page_start THEN 'bad_range' WHEN page_end > 15 THEN 'outside_window' WHEN content_role NOT IN ('question', 'answer') THEN 'bad_role' ELSE 'ok' END AS reason FROM directory")
def validity(s: Source) -> DataFrame:
    reason = F.when((C("page_start") <= 0) | (C("page_end") < C("page_start")), "bad_range").when(C("page_end") > 15, "outside_window").when(~C("content_role").isin("question", "answer"), "bad_role").otherwise("ok")
    return s.directory().select("id", reason.alias("reason"))


@query("agg25_mth2_progress", """, u AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') AS qt, count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F') AS qd, count(*) FILTER (WHERE l_returnflag <> 'A') AS at_, count(*) FILTER (WHERE l_returnflag <> 'A' AND l_linestatus = 'F') AS ad, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'F') AS d FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey, floor(least(1, CASE o_orderkey % 6 WHEN 0 THEN 0.05 * d / n WHEN 1 THEN 0.05 + 0.3 * d / n WHEN 2 THEN 0.35 + 0.3 * CASE WHEN qt > 0 THEN qd / qt ELSE 0 END + 0.25 * CASE WHEN at_ > 0 THEN ad / at_ ELSE 0 END WHEN 3 THEN 0.9 + 0.05 * d / n WHEN 4 THEN 0.95 + 0.05 * d / n ELSE CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END END) * 100 + 0.5) / 100 AS progress
    FROM orders JOIN u ON l_orderkey = o_orderkey""".replace("0.05 *", "0.05::DOUBLE *").replace("0.3 *", "0.3::DOUBLE *").replace("0.25 *", "0.25::DOUBLE *").replace("qd / qt", "CAST(qd AS DOUBLE) / qt").replace("ad / at_", "CAST(ad AS DOUBLE) / at_"))
def progress(s: Source) -> DataFrame:
    """A run's progress: each stage has a base and a weight for its own part done; extraction counts questions and answers by weights of their own."""
    done, role = C("l_linestatus") == "F", C("l_returnflag") == "A"
    u = s.table("lineitem").groupBy(C("l_orderkey").alias("o_orderkey")).agg(
        F.count_if(role).alias("qt"), F.count_if(role & done).alias("qd"), F.count_if(~role).alias("at"), F.count_if(~role & done).alias("ad"), F.count("*").alias("n"), F.count_if(done).alias("d")
    )
    stage = F.get(F.array(*map(F.lit, ("rendering", "catalog", "parallel_extraction", "linking", "validating", "none"))), (C("o_orderkey") % 6).cast("int"))
    o = s.table("orders").join(u, "o_orderkey")
    return o.select("o_orderkey", round_away(run_progress(stage, C("d"), C("n"), ratio(C("qd"), C("qt")), ratio(C("ad"), C("at")), C("o_orderstatus") == "F"), 2).alias("progress"))


def run_progress(stage: Column, done: Column, whole: Column, questions: Column, answers: Column, completed: Column) -> Column:
    """Multiplied before it is divided: weight * (done / whole) may end just under a half that weight * done / whole reaches."""
    p = F.when(completed, 1.0).otherwise(0.0)
    for name, (base, weight) in RUN_STAGES.items():
        p = F.when(stage == name, base + weight * done / whole).otherwise(p)
    p = F.when(stage.isin("parallel_extraction", "extract_question", "extract_answer"), 0.35 + 0.3 * questions + 0.25 * answers).otherwise(p)
    return F.least(F.lit(1.0), p)


@query("agg23_content_hash", """SELECT document_id, sha256(string_agg(id || '|' || anchor, chr(10) ORDER BY id)) AS content_hash FROM directory GROUP BY document_id""")
def hashes(s: Source) -> DataFrame:
    return sets.content_hash(s.directory(), ["document_id"], ["id"], ["id", "anchor"])
