"""Recovery: explicit answers from directory anchors, lookup ladders, cross-scope evidence, directory replacement, versioned updates, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scholia.adapters import Source
from scholia.functions import grading, text
from scholia.functions.tables import ANALYSIS_MARKERS, EXPLICIT_ANSWER, FREE_ANSWER
from scholia.operators import joins, ranges, sets
from scholia.plans.linking import KEY
from scholia.registry import query

C = F.col
_TYPES = ("single_choice", "true_false", "fill_in_blank", "subjective", "multiple_choice")
#: How sample anchors are written, {n} standing for the number of their entry, {s} for a word.
_ANCHORS = ("{n}.AB", "{n}、a, c 【解析】{s} so", " {n}．√ 解析：{s}", "{n} 正确", "9{n}.B", "{n}. {s} text（解析） why", "{s}", "{n}.G", "{n}：× ", "", "{n}.b/D+e rest", "{n}.对 x")


def anchors(s: Source) -> DataFrame:
    """Answer entries of a directory, from customer: anchors in many spellings."""
    k = C("c_custkey")
    number = (F.floor(k / 25) % 40 + 1).cast("long")
    written = F.get(F.array(*map(F.lit, _ANCHORS)), (k % len(_ANCHORS)).cast("int"))
    return s.table("customer").select(
        k.alias("id"), (k % 10).alias("document_id"), F.when(k % 4 == 0, "explanation").otherwise("answer").alias("content_role"), F.when(C("c_nationkey") % 2 == 0, "Part/参考答案").otherwise("Part").alias("section"),
        F.get(F.array(*map(F.lit, _TYPES)), (C("c_nationkey") % 5).cast("int")).alias("question_type"), number.alias("question_no"), F.floor(k / 15).cast("long").alias("page_start"),
        F.replace(F.replace(written, F.lit("{n}"), number.cast("string")), F.lit("{s}"), F.lower("c_mktsegment")).alias("anchor"),
    )


def _names(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + "]"


_SQL_ANCHORS = f"""anchors AS (
  SELECT c_custkey AS id, c_custkey % 10 AS document_id, CASE WHEN c_custkey % 4 = 0 THEN 'explanation' ELSE 'answer' END AS content_role, CASE WHEN c_nationkey % 2 = 0 THEN 'Part/参考答案' ELSE 'Part' END AS section,
    {_names(_TYPES)}[c_nationkey % 5 + 1] AS question_type, (c_custkey // 25) % 40 + 1 AS question_no, c_custkey // 15 AS page_start,
    replace(replace({_names(_ANCHORS)}[c_custkey % {len(_ANCHORS)} + 1], '{{n}}', CAST((c_custkey // 25) % 40 + 1 AS VARCHAR)), '{{s}}', lower(c_mktsegment)) AS anchor FROM customer)"""


def _after_marker(rest: Column) -> tuple[Column, Column]:
    """What stands before the first kind of explanation mark that occurs, and what stands after it."""
    kinds = F.filter(F.array(*map(F.lit, ANALYSIS_MARKERS)), lambda m: F.contains(rest, m))
    mark = F.get(kinds, F.lit(0))
    at = F.call_function("instr", rest, mark)
    before = F.when(mark.isNull(), rest).otherwise(F.substr(rest, F.lit(1), at - 1))
    return F.trim(before), F.when(mark.isNull(), "").otherwise(F.trim(F.substr(rest, at + F.char_length(mark))))


def explicit_answer(anchor: Column, number: Column, kind: Column) -> Column:
    """struct(values, analysis), null where the anchor doesn't open with its own number and an answer of its kind: letters A to F,
    a sign or word for true or false, or for blanks any text. Nothing further on in the anchor is taken for an answer."""
    none = F.lit(None).cast("struct<values:array<string>,analysis:string>")
    free, token = F.regexp_extract(anchor, FREE_ANSWER, 2), F.regexp_extract(anchor, EXPLICIT_ANSWER, 2)
    own = lambda pattern: F.regexp_extract(anchor, pattern, 1).try_cast("long").eqNullSafe(number)
    value, why = _after_marker(F.trim(free))
    letters = F.upper(F.translate(F.trim(token), " \t、,，/\\+&", ""))
    glyph = text.answer_glyph(F.trim(token), F.lit("true_false"))
    values = F.when(kind == "true_false", F.array(glyph)).when(letters.rlike("^[A-F]+$"), F.filter(F.split(letters, ""), lambda x: x != ""))
    _, note = _after_marker(F.trim(F.substr(anchor, F.char_length(F.regexp_extract(anchor, EXPLICIT_ANSWER, 0)) + 1)))
    blank = F.when(own(FREE_ANSWER) & (value != ""), F.struct(F.array(value).alias("values"), why.alias("analysis")))
    other = F.when(own(EXPLICIT_ANSWER) & (token != "") & values.isNotNull(), F.struct(values.alias("values"), note.alias("analysis")))
    return F.coalesce(F.when((number > 0) & (F.trim(anchor) != ""), F.when(kind == "fill_in_blank", blank).otherwise(other)), none)


def recover_answers(entries: DataFrame, records: DataFrame) -> DataFrame:
    """New answer rows (values, analysis) for directory entries that open with their answer and have no record of their
    document, kind, number and page that holds one. A subjective entry without a token counts as its own explanation under a reference heading."""
    found = explicit_answer(C("anchor"), C("question_no"), C("question_type"))
    note = F.when((C("question_type") == "subjective") & C("section").rlike("参考答案|解析") & (F.trim("anchor") != ""), F.struct(F.array().cast("array<string>").alias("values"), F.trim("anchor").alias("analysis")))
    taken = entries.withColumn("found", F.coalesce(found, note)).where("found is not null")
    have = records.where("n_values > 0 or (question_type = 'subjective' and analysis <> '')").select("document_id", "content_role", "question_type", "question_no", "page_start")
    return taken.join(have, ["document_id", "content_role", "question_type", "question_no", "page_start"], "left_anti").select("id", "question_type", F.array_join("found.values", ",").alias("answer"), F.col("found.analysis").alias("analysis"))


_MARKS = _names(tuple(ANALYSIS_MARKERS))
_RECOVERED = rf"""{_SQL_ANCHORS},
  cut AS (SELECT *, regexp_extract(anchor, '{EXPLICIT_ANSWER}', 1) AS n1, trim(regexp_extract(anchor, '{EXPLICIT_ANSWER}', 2)) AS token, trim(substr(anchor, length(regexp_extract(anchor, '{EXPLICIT_ANSWER}')) + 1)) AS rest,
    regexp_extract(anchor, '{FREE_ANSWER}', 1) AS n2, trim(regexp_extract(anchor, '{FREE_ANSWER}', 2)) AS free FROM anchors),
  marked AS (SELECT *, upper(regexp_replace(token, '[ \t、,，/\\+&]', '', 'g')) AS letters, list_filter({_MARKS}, lambda m: contains(rest, m))[1] AS m1, list_filter({_MARKS}, lambda m: contains(free, m))[1] AS m2 FROM cut),
  read AS (SELECT *,
    CASE WHEN question_type = 'fill_in_blank' THEN CASE WHEN n2 = CAST(question_no AS VARCHAR) THEN nullif(trim(CASE WHEN m2 IS NULL THEN free ELSE left(free, instr(free, m2) - 1) END), '') END
      WHEN n1 <> CAST(question_no AS VARCHAR) OR token = '' THEN NULL
      WHEN question_type = 'true_false' THEN CASE WHEN lower(token) IN ('√', '✓', '✔', '正确') THEN '正确' WHEN lower(token) IN ('×', '✕', '✗', 'x', '错误', 'f') THEN '错误' ELSE token END
      WHEN regexp_full_match(letters, '[A-F]+') THEN array_to_string(string_split(letters, ''), ',') END AS answer,
    CASE WHEN question_type = 'fill_in_blank' THEN CASE WHEN m2 IS NULL THEN '' ELSE trim(substr(free, instr(free, m2) + length(m2))) END ELSE CASE WHEN m1 IS NULL THEN '' ELSE trim(substr(rest, instr(rest, m1) + length(m1))) END END AS analysis FROM marked),
  taken AS (SELECT id, document_id, content_role, question_type, question_no, page_start,
    CASE WHEN answer IS NOT NULL THEN answer WHEN question_type = 'subjective' AND regexp_matches(section, '参考答案|解析') AND trim(anchor) <> '' THEN '' END AS answer,
    CASE WHEN answer IS NOT NULL THEN analysis ELSE trim(anchor) END AS analysis FROM read)"""


@query("str17_explicit_answer", f", {_RECOVERED} SELECT id, answer, CASE WHEN answer IS NOT NULL THEN analysis END AS analysis FROM read")
def explicit(s: Source) -> DataFrame:
    r = explicit_answer(C("anchor"), C("question_no"), C("question_type"))
    return anchors(s).withColumn("r", r).select("id", F.when(C("r").isNotNull(), F.array_join("r.values", ",")).alias("answer"), C("r.analysis").alias("analysis"))


@query("lnk23_recovered_answers", f""", {_RECOVERED}, records AS (SELECT id % 10 AS document_id, question_no, page_start FROM candidates)
    SELECT id, question_type, answer, analysis FROM taken t WHERE answer IS NOT NULL AND NOT EXISTS (SELECT 1 FROM anchors r WHERE r.id % 3 = 0 AND (r.id % 6 = 0 OR r.question_type = 'subjective') AND (r.document_id, r.content_role, r.question_type, r.question_no, r.page_start) = (t.document_id, t.content_role, t.question_type, t.question_no, t.page_start))""")
def recovered(s: Source) -> DataFrame:
    """A third of the entries have records already; half of those hold no value, only an explanation."""
    records = anchors(s).where("id % 3 = 0").select("document_id", "content_role", "question_type", "question_no", "page_start", F.when(C("id") % 6 == 0, 1).otherwise(0).alias("n_values"), F.lit("why").alias("analysis"))
    return recover_answers(anchors(s), records)


def ladder(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, entry, rung): the directory entry of each question. Entries of its document and number whose pages overlap its own are
    tried: the same identity; else the only one of the same path and type; the one of those whose anchor the stem
    clearly begins with; the only one of the type; the clear one of all; the only one at all. Otherwise none.

    Both: id, document_id, identity, path, kind, number, first, last; questions: stem; entries: anchor. Entries meet a question by equal
    identity, or by cells of pages, so those of other pages are never paired with it; one aggregate then decides all rungs."""
    key = F.struct("document_id", "number")
    q, e = questions.withColumn("key", key), entries.withColumn("key", key)
    a, b = joins._aliased(q, e)
    near = joins.overlap_join(q, e, "key", "first", "last").withColumn("near", F.lit(True))
    named = a.join(b, (C("key") == C("r_key")) & (C("identity") == C("r_identity"))).where(~joins.overlaps(C("first"), C("last"), C("r_first"), C("r_last"))).withColumn("near", F.lit(False))
    met = near.unionByName(named)
    x, y = text.compact(C("stem")), text.compact(C("r_anchor"))
    score = F.when((x == "") | (y == ""), None).when(F.contains(x, y) | F.contains(y, x), 1.0).otherwise(text.common_beginning(x, y) / F.least(F.char_length(x), F.char_length(y)))
    typed = C("near") & (C("kind") == C("r_kind"))
    met = met.select("id", "r_id", score.alias("score"), (C("identity") == C("r_identity")).alias("own"), (typed & (C("path") == C("r_path"))).alias("on_path"), typed.alias("typed"), "near")

    def only(flag: str) -> Column:
        return F.when(F.count_if(flag) == 1, F.min(F.when(C(flag), C("r_id"))))

    def clear(flag: str) -> Column:
        ranked = F.sort_array(F.collect_list(F.when(C(flag) & C("score").isNotNull(), F.struct("score", (-C("r_id")).alias("m")))), asc=False)
        best, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
        return F.when((F.count_if(flag) > 1) & (best["score"] >= 0.75) & (second["score"].isNull() | (best["score"] > second["score"] + 0.1)), -best["m"])

    rungs = {"identity": F.min(F.when(C("own"), C("r_id"))), "path": only("on_path"), "path_anchor": clear("on_path"), "typed": only("typed"), "anchor": clear("near"), "physical": only("near")}
    g = met.groupBy("id").agg(*(v.alias(k) for k, v in rungs.items()))
    rung = F.coalesce(*(F.when(C(k).isNotNull(), k) for k in rungs))
    return g.select("id", F.coalesce(*rungs).alias("entry"), rung.alias("rung")).where("entry is not null")


def _ladder_sides(s: Source) -> tuple[DataFrame, DataFrame]:
    p = s.table("part").withColumn("k", C("p_partkey"))
    identity = lambda path, kind, no: F.concat_ws("|", path, kind, no.cast("string"))
    kind = F.get(F.array(*map(F.lit, ("single_choice", "true_false", "subjective"))), (C("p_size") % 3).cast("int"))
    number = C("k") % 20
    base = p.select(C("k").alias("id"), (C("k") % 8).alias("document_id"), C("p_type").alias("path"), kind.alias("kind"), number.alias("number"), F.floor(C("k") / 30).alias("first"), (F.floor(C("k") / 30) + C("p_size") % 3).alias("last"), "p_name", "p_brand")
    questions = base.withColumn("identity", F.when(C("id") % 9 == 0, identity("p_brand", "kind", C("number"))).otherwise("")).withColumn("stem", C("p_name"))
    entries = base.withColumn("identity", identity("p_brand", "kind", C("number"))).withColumn("anchor", F.when(C("id") % 4 == 0, F.left("p_name", F.lit(5))).otherwise(C("p_name")))
    entries = entries.withColumn("id", C("id") + 1_000_000).withColumn("document_id", C("document_id")).withColumn("kind", F.when(C("number") % 5 == 0, "fill_in_blank").otherwise(C("kind")))
    return questions, entries


@query("lnk24_recovery_ladder", """, base AS (SELECT p_partkey AS id, p_partkey % 8 AS document_id, p_type AS path, ['single_choice', 'true_false', 'subjective'][p_size % 3 + 1] AS kind, p_partkey % 20 AS number, p_partkey // 30 AS first, p_partkey // 30 + p_size % 3 AS last, p_name, p_brand FROM part),
    q AS (SELECT *, CASE WHEN id % 9 = 0 THEN p_brand || '|' || kind || '|' || number ELSE '' END AS identity, lower(replace(p_name, ' ', '')) AS x FROM base),
    e AS (SELECT id + 1000000 AS id, document_id, path, CASE WHEN number % 5 = 0 THEN 'fill_in_blank' ELSE kind END AS kind, number, first, last, p_brand || '|' || kind || '|' || number AS identity, lower(replace(CASE WHEN id % 4 = 0 THEN left(p_name, 5) ELSE p_name END, ' ', '')) AS y FROM base),
    met AS (SELECT q.id, e.id AS r, q.identity = e.identity AS own, q.last >= e.first AND q.first <= e.last AS near, q.kind = e.kind AS same, q.path = e.path AS along,
      CASE WHEN contains(x, y) OR contains(y, x) THEN 1.0 ELSE list_max(list_filter(range(0, least(length(x), length(y)) + 1), lambda n: left(x, n) = left(y, n))) / CAST(least(length(x), length(y)) AS DOUBLE) END AS score
      FROM q JOIN e ON q.document_id = e.document_id AND q.number = e.number),
    f AS (SELECT *, near AND same AND along AS on_path, near AND same AS typed FROM met),
    g AS (SELECT id, min(r) FILTER (WHERE own) AS identity, CASE WHEN count(*) FILTER (WHERE on_path) = 1 THEN min(r) FILTER (WHERE on_path) END AS path, list((score, -r) ORDER BY score DESC, r) FILTER (WHERE on_path) AS lp,
      CASE WHEN count(*) FILTER (WHERE typed) = 1 THEN min(r) FILTER (WHERE typed) END AS typed, list((score, -r) ORDER BY score DESC, r) FILTER (WHERE near) AS la, CASE WHEN count(*) FILTER (WHERE near) = 1 THEN min(r) FILTER (WHERE near) END AS physical FROM f GROUP BY id),
    h AS (SELECT *, CASE WHEN len(lp) > 1 AND lp[1][1] >= 0.75 AND lp[1][1] > lp[2][1] + 0.1 THEN -lp[1][2] END AS path_anchor, CASE WHEN len(la) > 1 AND la[1][1] >= 0.75 AND la[1][1] > la[2][1] + 0.1 THEN -la[1][2] END AS anchor FROM g)
    SELECT id, coalesce(identity, path, path_anchor, typed, anchor, physical) AS entry, CASE WHEN identity IS NOT NULL THEN 'identity' WHEN path IS NOT NULL THEN 'path' WHEN path_anchor IS NOT NULL THEN 'path_anchor' WHEN typed IS NOT NULL THEN 'typed' WHEN anchor IS NOT NULL THEN 'anchor' ELSE 'physical' END AS rung
    FROM h WHERE coalesce(identity, path, path_anchor, typed, anchor, physical) IS NOT NULL""")
def recovery_ladder(s: Source) -> DataFrame:
    return ladder(*_ladder_sides(s))


def evidence_links(open_questions: DataFrame, references: DataFrame, least: int = 36) -> DataFrame:
    """(id, answer_id, score): for subjective questions without any match, the reference of the same session, number and a compatible set
    whose text holds most of the stem's grams: at least `least`, and more than the next.

    References are found by an inverted index of their grams (3 to 6 characters). A question's grams are ordered by how many references of its number hold
    them. The rarest one gives first pairs, whose best score is a bound that the winner must reach; then only grams go on that, with all commoner ones after
    them, could still add up to that bound. A reference that shares none of these can't win nor tie, so it is never scored."""
    place = ["session", "question_no"]
    q = open_questions.select("id", *place, "set_no", text.evidence(C("stem")).alias("s"), "stem")
    r = references.select(C("id").alias("r_id"), *place, C("set_no").alias("r_set_no"), text.evidence(C("text")).alias("t"), C("text").alias("r_text"))
    sizes = (3, 4, 5, 6)

    def weighed(n: int) -> Column:
        return F.transform(F.filter(text.grams(C("s"), n), lambda g: text.telling_gram(g, n)), lambda g: F.struct(g.alias("gram"), F.lit(n * n).alias("w")))

    own = F.array_distinct(F.concat(*(weighed(n) for n in sizes)))
    asked = q.select("id", *place, "set_no", F.inline(own))
    index = r.select("r_id", *place, "r_set_no", F.explode(F.array_distinct(F.concat(*(text.grams(C("t"), n) for n in sizes)))).alias("gram"))
    held = index.groupBy(*place, "gram").agg(F.count("*").alias("held"))
    later = W.partitionBy("id").orderBy(F.desc("held"), F.desc("gram"))
    ranked = asked.join(held, [*place, "gram"]).withColumn("rest", F.sum("w").over(later.rowsBetween(W.unboundedPreceding, 0))).withColumn("rarest", F.max(F.struct("rest", "gram")).over(W.partitionBy("id"))["gram"] == C("gram"))

    def scored(grams: DataFrame) -> DataFrame:
        met = grams.join(index, [*place, "gram"]).where(joins.tolerant(C("set_no"), C("r_set_no"))).select("id", "r_id").distinct()
        return met.join(q.select("id", "stem"), "id").join(r.select("r_id", "r_text"), "r_id").select("id", "r_id", text.evidence_score(C("stem"), C("r_text")).alias("score"))

    bound = scored(ranked.where("rarest")).groupBy("id").agg(F.greatest(F.max("score"), F.lit(least)).alias("bound"))
    able = ranked.join(bound, "id", "left").where(C("rest") >= F.coalesce("bound", F.lit(least)))
    tied = scored(able).groupBy("id", "score").agg(F.count("*").alias("n"), F.min("r_id").alias("answer_id"))
    g = tied.groupBy("id").agg(F.max(F.struct("score", "n", "answer_id")).alias("best"))
    return g.where((C("best.score") >= least) & (C("best.n") == 1)).select("id", C("best.answer_id").alias("answer_id"), C("best.score").cast("long").alias("score"))


def _word(k: Column) -> Column:
    """A word of six letters for a number."""
    return F.translate(F.lpad(k.cast("string"), 6, "0"), "0123456789", "qjxzkvbwyp")


def _references(s: Source) -> DataFrame:
    k = C("p_partkey")
    return s.table("part").select((k + 5_000_000).alias("id"), F.floor(k / 500).alias("session"), (k % 40).alias("question_no"), (C("p_size") % 3).cast("int").alias("set_no"), F.concat_ws(" ", "p_type", "p_name", _word(k)).alias("text"))


def _gram_sql(n: int) -> str:
    return f"{n * n} * len(list_filter(list_distinct(list_transform(range(1, greatest(length(x) - {n - 2}, 1)), lambda i: substr(x, i, {n}))), lambda g: NOT regexp_matches(g, '[0-9.、:：()（）]') AND contains(y, g)))"


@query("lnk7_cross_scope_evidence", f""", q AS (SELECT id, id // 500 AS session, question_no, set_no, replace(stem, ' ', '') || CASE WHEN id % 2 = 0 THEN translate(lpad(CAST(id AS VARCHAR), 6, '0'), '0123456789', 'qjxzkvbwyp') ELSE '' END AS x FROM candidates ANTI JOIN answers USING (section_scope, set_no, question_type, question_no) WHERE question_type = 'subjective'),
    r AS (SELECT p_partkey + 5000000 AS rid, p_partkey // 500 AS session, p_partkey % 40 AS question_no, p_size % 3 AS set_no, lower(p_type || replace(p_name, ' ', '')) || translate(lpad(CAST(p_partkey AS VARCHAR), 6, '0'), '0123456789', 'qjxzkvbwyp') AS y FROM part),
    m AS (SELECT q.id, rid, {' + '.join(_gram_sql(n) for n in (3, 4, 5, 6))} AS score FROM q JOIN r ON q.session = r.session AND q.question_no = r.question_no AND (q.set_no = r.set_no OR q.set_no = 0 OR r.set_no = 0)),
    k AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS second FROM m WINDOW w AS (PARTITION BY id ORDER BY score DESC, rid))
    SELECT id, rid AS answer_id, CAST(score AS BIGINT) AS score FROM k WHERE k = 1 AND score >= 36 AND coalesce(second, -1) < score""")
def cross_scope(s: Source) -> DataFrame:
    stem = F.concat("stem", F.when(C("id") % 2 == 0, F.concat(F.lit(" "), _word(C("id")))).otherwise(""))
    return evidence_links(s.candidates().where("question_type = 'subjective'").withColumn("stem", stem).withColumn("session", F.floor(C("id") / 500)).join(s.answers(), KEY, "left_anti"), _references(s))


def topic_hints(questions: DataFrame, scopes: DataFrame, titles: list[str]) -> DataFrame:
    """(id, scope): the scope that a title cited in a stem names: of the titles in their order the first that the stem holds and exactly one scope does."""
    t = questions.sparkSession.createDataFrame(list(enumerate(titles)), "rank int, title string")  # a fixed list
    named = scopes.select("section_scope").distinct().join(F.broadcast(t), F.contains(text.compact(C("section_scope")), text.compact(C("title"))))
    sole = named.groupBy("rank", "title").agg(F.count("*").alias("n"), F.min("section_scope").alias("scope")).where("n = 1")
    cited = questions.join(F.broadcast(sole), F.contains(text.compact(C("stem")), text.compact(C("title"))))  # a row for each title at most
    return cited.groupBy("id").agg(F.min_by("scope", "rank").alias("scope"))


_TITLES = ("automobile of nation_1", "machinery of nation_24", "building of nation_2", "household of nation_3", "furniture")


@query("lnk11_topic_hint", f""", c AS (SELECT c_custkey, c_mktsegment || ' of ' || n_name AS scope FROM customer JOIN nation ON n_nationkey = c_nationkey), scopes AS (SELECT DISTINCT scope FROM c),
    t AS (SELECT unnest(range(len(x))) AS rank, replace(unnest(x), ' ', '') AS title FROM (SELECT {_names(_TITLES)} AS x)),
    sole AS (SELECT rank, title, min(scope) AS scope FROM t JOIN scopes ON contains(lower(replace(scope, ' ', '')), title) GROUP BY ALL HAVING count(*) = 1)
    SELECT c_custkey AS id, arg_min(sole.scope, rank) AS scope FROM c JOIN sole ON contains(lower(replace('on ' || c.scope || ' 1', ' ', '')), title) GROUP BY c_custkey""")
def hints(s: Source) -> DataFrame:
    """Customers' segments and nations as scopes; some titles name several scopes and so none."""
    c = s.table("customer").join(s.table("nation"), C("n_nationkey") == C("c_nationkey"))
    scope = F.concat("c_mktsegment", F.lit(" of "), "n_name")
    return topic_hints(c.select(C("c_custkey").alias("id"), F.concat(F.lit("on "), scope, F.lit(" 1")).alias("stem")), c.select(scope.alias("section_scope")), list(_TITLES))


def accepted_patches(patches: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, outcome): a re-read is taken only if it returned exactly one patch, for the very question asked about, on its pages."""
    g = patches.groupBy("id").agg(F.count("*").alias("n"), F.min("target").alias("target"), F.min("first").alias("first"), F.max("last").alias("last"))
    j = asked.join(g, "id", "left")
    outcome = F.when(C("n").isNull(), "none").when(C("n") > 1, "several").when(C("target") != C("wanted"), "other_question").when((C("first") < C("low")) | (C("last") > C("high")) | (C("last") < C("first")), "outside").otherwise("accepted")
    return j.select("id", outcome.alias("outcome"))


@query("lnk26_patch_acceptance", """, g AS (SELECT l_orderkey AS id, count(*) AS n, min(l_partkey) AS target, min(l_linenumber) AS first, max(l_linenumber + CAST(l_quantity AS INTEGER) % 3) AS last FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
    SELECT o_orderkey AS id, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'several' WHEN target % 2 <> o_custkey % 2 THEN 'other_question' WHEN first < 2 OR last > 6 OR last < first THEN 'outside' ELSE 'accepted' END AS outcome FROM orders LEFT JOIN g ON id = o_orderkey""")
def patches(s: Source) -> DataFrame:
    p = s.table("lineitem").where("l_returnflag = 'R'").select(C("l_orderkey").alias("id"), (C("l_partkey") % 2).alias("target"), C("l_linenumber").alias("first"), (C("l_linenumber") + C("l_quantity").cast("int") % 3).alias("last"))
    return accepted_patches(p, s.table("orders").select(C("o_orderkey").alias("id"), (C("o_custkey") % 2).alias("wanted"), F.lit(2).alias("low"), F.lit(6).alias("high")))


def reread_windows(windows: DataFrame, ranges: DataFrame, answers: DataFrame) -> DataFrame:
    """(document_id, page_start, page_end, n_ranges, n_answers): the windows that any asked range overlaps, once each, with the answers inside them."""
    hit = joins.overlap_join(windows, ranges, "document_id", "page_start", "page_end").groupBy("document_id", "page_start", "page_end").agg(F.count("*").alias("n_ranges"))
    a = answers.select("document_id", "page_start", "page_end")
    inside = joins.overlap_join(hit.select("document_id", "page_start", "page_end"), a, "document_id", "page_start", "page_end").where("r_page_start >= page_start and r_page_end <= page_end")
    n = inside.groupBy("document_id", "page_start", "page_end").agg(F.count("*").alias("n_answers"))
    return hit.join(n, ["document_id", "page_start", "page_end"], "left").withColumn("n_answers", F.coalesce("n_answers", F.lit(0)))


@query("lnk27_reread_windows", """, top AS (SELECT document_id, max(page_end) AS n FROM candidates GROUP BY document_id), w AS (SELECT document_id, f AS page_start, least(f + 4, n) AS page_end FROM (SELECT document_id, n, unnest(range(1, n + 1, 4)) AS f FROM top)),
    r AS (SELECT DISTINCT document_id, page_start, page_end FROM candidates ANTI JOIN answers USING (section_scope, set_no, question_type, question_no)),
    h AS (SELECT w.document_id, w.page_start, w.page_end, count(*) AS n_ranges FROM w JOIN r ON w.document_id = r.document_id AND w.page_end >= r.page_start AND w.page_start <= r.page_end GROUP BY ALL)
    SELECT h.*, (SELECT count(*) FROM answers a WHERE a.document_id = h.document_id AND a.page_start >= h.page_start AND a.page_end <= h.page_end) AS n_answers FROM h""")
def reread(s: Source) -> DataFrame:
    n = s.candidates().groupBy("document_id").agg(F.max("page_end").alias("n")).where("n >= 1")
    w = n.withColumn("page_start", F.explode(F.sequence(F.lit(1).cast("long"), "n", F.lit(4).cast("long")))).select("document_id", "page_start", F.least(C("page_start") + 4, "n").alias("page_end"))
    r = s.candidates().join(s.answers(), KEY, "left_anti").select("document_id", "page_start", "page_end").distinct()
    return reread_windows(w, r, s.answers())


@query("lnk28_relink_plan", """, q AS (SELECT document_id, count(*) AS n_candidates, count(*) FILTER (WHERE a.k IS NULL) AS n_open FROM candidates c LEFT JOIN (SELECT DISTINCT section_scope, question_no, 1 AS k FROM answers) a USING (section_scope, question_no) GROUP BY document_id),
    d AS (SELECT document_id // 5 AS document_id, count(*) AS n_entries FROM directory WHERE content_role = 'question' GROUP BY 1)
    SELECT document_id, CASE WHEN document_id % 4 = 1 THEN 'stale_version' WHEN coalesce(n_candidates, 0) < coalesce(n_entries, 0) THEN 'questions' WHEN n_open > 0 THEN 'answers' ELSE 'reconcile' END AS next_step FROM d FULL JOIN q USING (document_id)""")
def relink(s: Source) -> DataFrame:
    """What a relink run plans for each document: nothing on a stale version; missing questions first, then missing answers, else reconcile."""
    a = s.answers().select("section_scope", "question_no").distinct().withColumn("k", F.lit(1))
    q = s.candidates().join(a, ["section_scope", "question_no"], "left").groupBy("document_id").agg(F.count("*").alias("n_candidates"), F.count_if(C("k").isNull()).alias("n_open"))
    d = s.directory().where("content_role = 'question'").groupBy(F.floor(C("document_id") / 5).alias("document_id")).agg(F.count("*").alias("n_entries"))
    seen, now = C("document_id") % 4, F.when(C("document_id") % 4 == 1, 2).otherwise(C("document_id") % 4)  # the version a run saw, and the present one
    step = F.when(seen != now, "stale_version").when(F.coalesce("n_candidates", F.lit(0)) < F.coalesce("n_entries", F.lit(0)), "questions").when(C("n_open") > 0, "answers").otherwise("reconcile")
    return d.join(q, "document_id", "full").select("document_id", step.alias("next_step"))


@query("agg21_richest_analysis", """SELECT c_nationkey, c_mktsegment, (list(c_custkey ORDER BY length(CAST(c_acctbal AS VARCHAR)) DESC, c_custkey))[1] AS id FROM customer GROUP BY ALL""".replace("length(CAST(c_acctbal AS VARCHAR))", "length(rtrim(c_name || repeat('x', c_custkey % 7), '0'))"))
def richest(s: Source) -> DataFrame:
    """Of equal answers the one with the longest analysis; of equally long ones the first."""
    analysis = F.rtrim(F.concat("c_name", F.repeat(F.lit("x"), (C("c_custkey") % 7).cast("int"))), F.lit("0"))
    return s.table("customer").groupBy("c_nationkey", "c_mktsegment").agg(F.max_by("c_custkey", F.struct(F.char_length(analysis), -C("c_custkey"))).alias("id"))


def interior(entries: DataFrame, known: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Entries whose number lies between two known ones of their group and is not known itself."""
    bounds = known.groupBy(*keys).agg(F.min(number).alias("lo"), F.max(number).alias("hi"))
    return entries.join(bounds, keys).where((C(number) > C("lo")) & (C(number) < C("hi"))).drop("lo", "hi").join(known.select(*keys, number).distinct(), [*keys, number], "left_anti")


@query("win8_interior_holes", """, b AS (SELECT section_scope, question_type, min(question_no) AS lo, max(question_no) AS hi FROM candidates GROUP BY ALL)
    SELECT id FROM answers a JOIN b USING (section_scope, question_type) WHERE question_no > lo AND question_no < hi AND NOT EXISTS (SELECT 1 FROM candidates c WHERE c.section_scope = a.section_scope AND c.question_type = a.question_type AND c.question_no = a.question_no)""")
def holes(s: Source) -> DataFrame:
    return interior(s.answers(), s.candidates(), ["section_scope", "question_type"], "question_no").select("id")


def replace_directories(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """A projection in which incoming rows stand for all stored ones of their documents. A blank identity becomes scope|role|set|type|number."""
    identity = F.concat_ws("|", text.scope_key(C("section_scope")), "content_role", C("set_no").cast("string"), "question_type", C("question_no").cast("string"))
    kept = stored.join(incoming.select("document_id").distinct(), "document_id", "left_anti")
    filled = F.coalesce(F.nullif("identity", F.lit("")), identity)
    return kept.unionByName(incoming).withColumn("identity", filled)


@query("mut8_cor21_replace_directory", """, stored AS (SELECT id, document_id, content_role, section_scope, set_no, question_type, question_no, '' AS identity FROM directory),
    incoming AS (SELECT id + 1000000 AS id, document_id, 'question' AS content_role, section_scope, set_no, question_type, question_no, CASE WHEN id % 5 = 0 THEN 'own' || id ELSE '' END AS identity FROM candidates),
    x AS (SELECT * FROM stored ANTI JOIN incoming USING (document_id) UNION ALL BY NAME SELECT * FROM incoming)
    SELECT id, document_id, coalesce(nullif(identity, ''), lower(section_scope) || '|' || content_role || '|' || set_no || '|' || question_type || '|' || question_no) AS identity FROM x""")
def replaced(s: Source) -> DataFrame:
    cols = ["id", "document_id", "content_role", "section_scope", "set_no", "question_type", "question_no"]
    stored = s.directory().select(*cols, F.lit("").alias("identity"))
    incoming = s.candidates().withColumn("content_role", F.lit("question")).withColumn("identity", F.when(C("id") % 5 == 0, F.concat(F.lit("own"), C("id").cast("string"))).otherwise("")).withColumn("id", C("id") + 1_000_000)
    return replace_directories(stored, incoming.select(*cols, "identity")).select("id", "document_id", "identity")


def versioned(updates: DataFrame, stored: DataFrame, batch: str, key: str) -> DataFrame:
    """(batch, n_rows, n_stale, applied): a batch of updates holds only if every row names the version its target has, and an exclusion a reason."""
    j = updates.join(stored, key, "left")
    bad = C("expected").isNull() | C("version").isNull() | (C("expected") != C("version")) | ((C("decision") == "exclude") & (F.trim(F.coalesce("reason", F.lit(""))) == ""))
    return j.groupBy(batch).agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_stale")).withColumn("applied", C("n_stale") == 0)


@query("mut7_lnk30_versioned_update", """SELECT l_orderkey, count(*) AS n_rows, count(*) FILTER (WHERE p_partkey IS NULL OR l_linenumber % 2 <> p_size % 2 AND l_tax > 0.04 OR l_returnflag = 'R' AND l_discount < 0.02) AS n_stale,
    count(*) FILTER (WHERE p_partkey IS NULL OR l_linenumber % 2 <> p_size % 2 AND l_tax > 0.04 OR l_returnflag = 'R' AND l_discount < 0.02) = 0 AS applied FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey""")
def bulk_update(s: Source) -> DataFrame:
    """Orders as batches of decisions on parts: old readers (tax over 4 %) may hold another version; exclusions come with or without a reason."""
    stored = s.table("part").select(C("p_partkey").alias("l_partkey"), "p_size", (C("p_size") % 2).alias("version"))
    u = s.table("lineitem").join(stored.drop("version"), "l_partkey", "left")
    u = u.select("l_orderkey", "l_partkey", F.when(C("l_tax") > 0.04, C("l_linenumber") % 2).otherwise(C("p_size") % 2).alias("expected"), F.when(C("l_returnflag") == "R", "exclude").otherwise("keep").alias("decision"), F.when(C("l_discount") < 0.02, " ").otherwise("why").alias("reason"))
    return versioned(u, stored.select("l_partkey", "version"), "l_orderkey", "l_partkey")


@query("mut10_issue_hints", """, i AS (SELECT id, section_scope, question_no, ['ANSWER_MISSING', 'ANSWER_CONFLICT', 'SOURCE_ID_MISMATCH', 'OTHER'][id % 4 + 1] AS code FROM candidates), o AS (SELECT section_scope, question_no, min(id) AS origin_id FROM answers GROUP BY ALL)
    SELECT id, origin_id, CASE WHEN code = 'ANSWER_MISSING' AND origin_id IS NULL THEN 'read_answer_pages' WHEN code = 'ANSWER_MISSING' THEN 'relink' WHEN code = 'ANSWER_CONFLICT' THEN 'choose_answer' WHEN code = 'SOURCE_ID_MISMATCH' THEN 'check_directory' ELSE 'review' END AS hint FROM i LEFT JOIN o USING (section_scope, question_no)""")
def issue_hints(s: Source) -> DataFrame:
    """Issues as they come in take the origin of their place and a hint how to resolve them."""
    code = F.get(F.array(*map(F.lit, ("ANSWER_MISSING", "ANSWER_CONFLICT", "SOURCE_ID_MISMATCH", "OTHER"))), (C("id") % 4).cast("int"))
    o = s.answers().groupBy("section_scope", "question_no").agg(F.min("id").alias("origin_id"))
    j = s.candidates().withColumn("code", code).join(o, ["section_scope", "question_no"], "left")
    hint = F.when((C("code") == "ANSWER_MISSING") & C("origin_id").isNull(), "read_answer_pages").when(C("code") == "ANSWER_MISSING", "relink").when(C("code") == "ANSWER_CONFLICT", "choose_answer").when(C("code") == "SOURCE_ID_MISMATCH", "check_directory").otherwise("review")
    return j.select("id", "origin_id", hint.alias("hint"))


def backfill(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """target and, of source, the first row of each key that target lacks. Doing it again changes nothing."""
    fresh = sets.first_wins(source.join(target, keys, "left_anti"), keys, ["id"])
    return target.unionByName(fresh.select(*target.columns))


@query("mut12_backfill", """, f AS (SELECT section_scope, set_no, question_no, min(id) AS id FROM answers ANTI JOIN candidates USING (section_scope, set_no, question_no) GROUP BY ALL)
    SELECT section_scope, set_no, question_no, id FROM candidates UNION ALL SELECT section_scope, set_no, question_no, id FROM f""")
def backfilled(s: Source) -> DataFrame:
    keys = ["section_scope", "set_no", "question_no"]
    source = s.answers().select(*keys, "id")
    once = backfill(s.candidates().select(*keys, "id"), source, keys)
    return backfill(once, source, keys)  # the second time adds nothing


@query("pra10_review_submit", """, now_ AS (SELECT as_of FROM now), r AS (SELECT user_id, question_id, wrong_count, ['again', 'hard', 'good', 'easy', 'maybe'][question_id % 5 + 1] AS result, question_id % 6 AS reviews, CAST(question_id % 100 AS DOUBLE) AS m FROM wrong),
    x AS (SELECT *, greatest(0, least(100, m + CASE result WHEN 'again' THEN -20 WHEN 'hard' THEN -5 WHEN 'good' THEN 10 ELSE 15 END)) AS moved, CAST([1, 3, 7, 15, 30][least(reviews, 4) + 1] AS DOUBLE) AS step FROM r WHERE result <> 'maybe')
    SELECT user_id, question_id, wrong_count + CASE WHEN result = 'again' THEN 1 ELSE 0 END AS wrong_count, CASE WHEN result = 'again' THEN 0 ELSE 1 END AS correct_count, reviews + 1 AS review_count,
      CASE result WHEN 'again' THEN 0.007 WHEN 'hard' THEN greatest(0.5, step * 0.5) WHEN 'easy' THEN step * 2 ELSE step END AS interval_days, floor(CASE WHEN wrong_count > 1 THEN greatest(0, moved - (wrong_count - 1) * 3) ELSE moved END * 10 + 0.5) / 10 AS mastery,
      count(*) OVER (PARTITION BY user_id) AS reviews_today FROM x""")
def reviews(s: Source) -> DataFrame:
    """Reviews handed in: results that are none of the four are refused; "again" counts as wrong, the rest as right; each adds to
    the day's reviews of its user, whose count is a partial sum, not a window."""
    result = F.get(F.array(*map(F.lit, ("again", "hard", "good", "easy", "maybe"))), (C("question_id") % 5).cast("int"))
    w = s.wrong().withColumn("result", result).where(C("result").isin("again", "hard", "good", "easy"))
    r = grading.review(C("wrong_count"), F.lit(0), C("question_id") % 6, (C("question_id") % 100).cast("double"), F.lit(3.0), C("last_wrong_at"), C("result"), C("as_of"))
    again = (C("result") == "again").cast("long")
    state = w.join(F.broadcast(s.as_of())).withColumn("r", r).select("user_id", "question_id", (C("wrong_count") + again).alias("wrong_count"), (1 - again).alias("correct_count"), (C("question_id") % 6 + 1).alias("review_count"), "r.interval_days", "r.mastery")  # one row
    return state.join(w.groupBy("user_id").agg(F.count("*").alias("reviews_today")), "user_id")


@query("str6_str29_str32_identity", r"""SELECT id, lower(regexp_replace('《' || section_scope || '》;', '[《》〈〉()\[\]:,.;\s]', '', 'g')) AS scope, CASE question_type WHEN 'single' THEN 'single_choice' WHEN 'judge' THEN 'true_false' WHEN 'essay' THEN 'subjective' END AS kind, content_role, set_no, question_no FROM directory""")
def identities(s: Source) -> DataFrame:
    """An identity written as path|role|set|type|number and read back; the scope key is the one function that both twins of it share."""
    written = F.concat_ws("|", F.to_json(F.array("section_scope")), "content_role", C("set_no").cast("string"), "question_type", C("question_no").cast("string"))
    p = s.directory().withColumn("p", text.read_identity(written))
    return p.select("id", text.scope_key(F.concat(F.lit("《"), F.get("p.path", F.lit(0)), F.lit("》;"))).alias("scope"), text.canonical_type(C("p.kind")).alias("kind"), C("p.role").alias("content_role"), C("p.set_no").alias("set_no"), C("p.number").alias("question_no"))


@query("src6_chunk_reassembly", """, c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS chunk, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, len(string_split(text, chr(10))) AS n, strlen(text) AS size FROM documents WHERE text IS NOT NULL),
    r AS (SELECT doc_id, i, CASE WHEN doc_id % 7 = 3 AND i = n // 2 THEN left(chunk, length(chunk) // 2) ELSE chunk END AS chunk, n, size FROM c WHERE NOT (doc_id % 5 = 1 AND i = n // 3)),
    g AS (SELECT doc_id, any_value(n) AS n, any_value(size) AS size, count(*) AS got, string_agg(chunk, chr(10) ORDER BY i) AS t FROM r GROUP BY doc_id)
    SELECT doc_id, CASE WHEN got < n THEN 'incomplete' WHEN strlen(t) <> size THEN 'wrong_size' ELSE 'whole' END AS state, CASE WHEN got = n AND strlen(t) = size THEN strlen(t) END AS n_bytes, CASE WHEN got = n AND strlen(t) = size THEN sha256(t) END AS file_hash FROM (SELECT doc_id, n, size, got, t FROM g
      UNION ALL SELECT doc_id, n, size, 0, NULL FROM c WHERE n = 1 AND doc_id % 5 = 1)""")
def reassembled(s: Source) -> DataFrame:
    """Uploads of documents in chunks (lines): some miss a chunk, some send chunks twice, some a chunk that is cut short."""
    d = s.table("documents").where("text is not null")
    announced = d.select("doc_id", F.size(F.split("text", "\n", -1)).alias("n"), F.octet_length("text").cast("long").alias("size"))
    sent = d.select("doc_id", F.size(F.split("text", "\n", -1)).alias("n"), F.posexplode(F.split("text", "\n", -1)).alias("i", "chunk"))
    cut = (C("doc_id") % 7 == 3) & (C("i") == F.floor(C("n") / 2))
    sent = sent.where(~((C("doc_id") % 5 == 1) & (C("i") == F.floor(C("n") / 3)))).withColumn("chunk", F.when(cut, F.left("chunk", F.floor(F.char_length("chunk") / 2).cast("int"))).otherwise(C("chunk")))
    twice = sent.where("doc_id % 3 = 0 and i % 2 = 0")
    return reassemble(sent.unionByName(twice).select("doc_id", "i", "chunk"), announced)


def reassemble(chunks: DataFrame, announced: DataFrame, glue: str = "\n") -> DataFrame:
    """(doc_id, state, n_bytes, file_hash): chunks (doc_id, i, chunk) in any order put together by their numbers, of which announced (doc_id, n, size) says how
    many there are and how large the whole is. Of a chunk sent twice the greater text counts; numbers beyond n count for nothing. An upload that lacks a chunk is incomplete, one of
    another size is refused; neither has a hash."""
    once = chunks.join(announced.select("doc_id", "n"), "doc_id").where("i >= 0 and i < n").groupBy("doc_id", "i").agg(F.max("chunk").alias("chunk"))
    rows = F.sort_array(F.collect_list(F.struct("i", "chunk")))  # one upload's
    g = once.groupBy("doc_id").agg(F.count("*").alias("got"), F.array_join(F.transform(rows, lambda r: r["chunk"]), glue).alias("t"))
    j = announced.join(g, "doc_id", "left")
    state = F.when(F.coalesce("got", F.lit(0)) < C("n"), "incomplete").when(F.octet_length("t") != C("size"), "wrong_size").otherwise("whole")
    j = j.withColumn("state", state)
    whole = lambda c: F.when(C("state") == "whole", c)
    return j.select("doc_id", "state", whole(F.octet_length("t").cast("long")).alias("n_bytes"), whole(F.sha2("t", 256)).alias("file_hash"))


def append_ids(rows: DataFrame, stored: DataFrame, key: str, id_name: str) -> DataFrame:
    """rows with ids that follow the highest stored one, in the order of a key that no two rows share."""
    top = stored.agg(F.coalesce(F.max(id_name), F.lit(0)).alias("top")).first()["top"]
    return ranges.numbered(rows, [key], id_name, top)


@query("snk1_append", "SELECT o_orderkey, (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY o_orderkey) AS question_id FROM orders")
def appended(s: Source) -> DataFrame:
    return append_ids(s.table("orders").select("o_orderkey"), s.questions().select("question_id"), "o_orderkey", "question_id")


@query("ret12_flt3_keyword_page", r"""SELECT question_id, stem FROM questions WHERE status = 'published' AND lower(stem) LIKE '%r_d%g%' ORDER BY question_id LIMIT 5 OFFSET 5""")
def keyword_page(s: Source) -> DataFrame:
    """The second page of published questions that hold a keyword, ASCII case folded; % and _ stay wildcards."""
    q = s.questions().where((C("status") == "published") & text.contains_folded(C("stem"), F.lit("R_d%G")))
    return sets.page(q, ["question_id"], 2, 5).select("question_id", "stem")


@query("lnk19_run_audit", """SELECT o_custkey AS session_id, o_orderkey AS run_id, count(l_orderkey) AS units, count(*) FILTER (WHERE l_linestatus = 'F') AS finished, max(l_linenumber) AS last_unit FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def run_audit(s: Source) -> DataFrame:
    """Runs of each session with their units."""
    j = s.table("orders").join(s.table("lineitem"), C("l_orderkey") == C("o_orderkey"))
    return j.groupBy(C("o_custkey").alias("session_id"), C("o_orderkey").alias("run_id")).agg(F.count("l_orderkey").alias("units"), F.count_if(C("l_linestatus") == "F").alias("finished"), F.max("l_linenumber").alias("last_unit"))
