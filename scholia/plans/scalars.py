"""One query for each family of scalar functions, over columns of the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.adapters import Source
from scholia.functions import numbers, text
from scholia.functions.tables import GENERIC_SHORT, GENERIC_WORDS
from scholia.operators import sets
from scholia.registry import query

C = F.col


@query("str3_grading_norm", "SELECT p_partkey, lower(regexp_replace(p_name || p_brand, '[ #]', '', 'g')) AS norm FROM part".replace("[ #]", " "))
def grading_norm(s: Source) -> DataFrame:
    return s.table("part").select("p_partkey", text.grading(F.concat(F.lit(" "), F.upper("p_name"), F.lit("，。"), "p_brand", F.lit(" ！"))).alias("norm"))


@query("str7_section_path", "SELECT p_partkey, lower(p_brand || '/' || replace(p_name, ' ', '')) AS path FROM part")
def section_path(s: Source) -> DataFrame:
    return s.table("part").select("p_partkey", text.section_path(F.concat("p_brand", F.lit("// "), "p_name", F.lit("/"))).alias("path"))


@query("str9_str11_loose", "SELECT p_partkey, lower(replace(replace(p_brand, '#', ''), ' ', '')) AS loose, lower(replace(p_name, ' ', '')) AS fragment FROM part")
def loose(s: Source) -> DataFrame:
    return s.table("part").select("p_partkey", text.loose(F.concat("p_brand", F.lit("。 "))).alias("loose"), text.fragment(F.concat("p_name", F.lit("！"))).alias("fragment"))


@query("str10_str12_stems", "SELECT p_partkey, lower(replace(p_name, ' ', '')) AS question, lower(replace(p_name, ' ', '')) AS stem FROM part")
def stems(s: Source) -> DataFrame:
    n = C("p_size").cast("string")
    return s.table("part").select(
        "p_partkey", text.answer_question(F.concat(F.lit("（"), n, F.lit("）"), n, F.lit("、"), "p_name")).alias("question"), text.stem_key(F.concat(n, F.lit("、"), "p_name")).alias("stem")
    )


@query("str15_question_start", "SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 0 THEN p_size ELSE 0 END AS INTEGER) AS number, p_partkey % 3 < 2 AS is_start FROM part")
def question_start(s: Source) -> DataFrame:
    n = C("p_size").cast("string")
    line = F.when(C("p_partkey") % 3 == 0, F.concat(n, F.lit(". "), "p_name")).when(C("p_partkey") % 3 == 1, F.concat(F.lit("第 "), n, F.lit(" 题 "), "p_name")).otherwise(C("p_name"))
    return s.table("part").select("p_partkey", text.question_number(line).alias("number"), text.is_question_start(line).alias("is_start"))


@query("str25_str26_str27_names", "SELECT p_partkey, left(p_name, 5) AS cut, 'A. ' || p_name || ' | B. ' || p_brand AS options, left(p_name || p_brand, 4) || '****' || right(p_name || p_brand, 4) AS masked, replace(replace(p_name, ' ', '_'), '#', '_') || '.pdf' AS file FROM part")
def names(s: Source) -> DataFrame:
    o = F.array(F.struct(F.lit("A").alias("key"), C("p_name").alias("content")), F.struct(F.lit("B").alias("key"), C("p_brand").alias("content")))
    return s.table("part").select("p_partkey", F.left("p_name", F.lit(5)).alias("cut"), text.join_options(o).alias("options"), text.mask_key(F.concat("p_name", "p_brand")).alias("masked"), text.safe_name(F.concat(F.lit("/a/b/"), "p_name", F.lit(".pdf"))).alias("file"))


@query("str30_str31_glyphs", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '正确' WHEN 1 THEN '错误' WHEN 2 THEN 'B、C' ELSE p_name END AS glyph, CASE WHEN p_size % 4 = 2 THEN 'BC' END AS letters FROM part")
def glyphs(s: Source) -> DataFrame:
    v = F.get(F.array(F.lit("✓"), F.lit(" x "), F.lit("B、C"), C("p_name")), (C("p_size") % 4).cast("int"))
    return s.table("part").select("p_partkey", text.answer_glyph(v, F.lit("true_false")).alias("glyph"), F.array_join(text.rubric_letters(F.when(C("p_size") % 4 == 2, v)), "").alias("letters"))


def _held(n: int) -> str:
    return f"len(list_filter(list_transform(range(1, greatest(length(p_type) - {n - 2}, 1)), lambda i: substr(p_type, i, {n})), lambda g: contains(p_name || '|', g)))"


@query("str22_shared_grams", f"SELECT p_partkey, CAST({' + '.join(map(_held, (2, 3, 4)))} AS INTEGER) AS n FROM (SELECT p_partkey, p_name || lower(p_brand) AS p_name, lower(p_type || p_brand) || p_name AS p_type FROM part)")
def shared(s: Source) -> DataFrame:
    return s.table("part").select("p_partkey", text.shared_grams(F.concat("p_name", F.lower("p_brand")), F.concat(F.lower(F.concat("p_type", "p_brand")), "p_name")).alias("n"))


def _gram(n: int) -> str:
    return f"{n * n} * len(list_filter(list_distinct(list_transform(range(1, greatest(length(x) - {n - 2}, 1)), lambda i: substr(x, i, {n}))), lambda g: NOT regexp_matches(g, '[0-9.、:：()（）]') AND NOT regexp_matches(g, '{'|'.join(GENERIC_WORDS)}') AND NOT ({n} <= 3 AND regexp_matches(g, '{'|'.join(GENERIC_SHORT)}')) AND contains(y, g)))"


@query("str14_str23_evidence", f"""SELECT p_partkey, lower(replace(p_brand, '#', '')) AS kept, CAST({' + '.join(map(_gram, (3, 4, 5, 6)))} AS INTEGER) AS score FROM (SELECT p_partkey, p_brand, replace(p_name, ' ', '') || '简述教师的课堂提问技巧' AS x, lower(replace(p_type || substr(p_name, 3), ' ', '')) || '教师的课堂提问技巧很多' AS y FROM part)""")
def evidence(s: Source) -> DataFrame:
    stem, found = F.concat("p_name", F.lit("，简述 教师的课堂提问技巧")), F.concat("p_type", F.substring("p_name", 3, 99), F.lit("：教师的课堂提问技巧很多。"))
    return s.table("part").select("p_partkey", text.evidence(C("p_brand")).alias("kept"), text.evidence_score(stem, found).alias("score"))


@query("dat1_dat2_dat5_dates", "SELECT attempt_id, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, created_at + INTERVAL 90 SECOND > as_of AS recent, floor((epoch_us(as_of) - epoch_us(created_at)) / 86400000000.0) AS days FROM attempts, now")
def dates(s: Source) -> DataFrame:
    a = s.attempts().join(F.broadcast(s.as_of()))  # one row
    return a.select("attempt_id", F.to_date("created_at").cast("string").alias("day"), (C("created_at") + F.expr("INTERVAL 90 SECOND") > C("as_of")).alias("recent"), F.floor(numbers.days_between(C("created_at"), C("as_of"))).cast("double").alias("days"))


@query("dat6_lenient_parse", "SELECT user_id, event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE epoch(date_trunc('second', CAST(ts AS TIMESTAMP))) END AS seconds FROM events")
def lenient(s: Source) -> DataFrame:
    ts = C("ts").cast("timestamp")
    raw = F.when(C("event_id") % 3 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(C("event_id") % 3 == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")).otherwise("soon")
    return s.table("events").select("user_id", "event_id", F.unix_seconds(numbers.lenient_timestamp(raw)).cast("double").alias("seconds"))


@query("mth1_mth3_mth5_numbers", "SELECT c_custkey, floor(abs(c_acctbal) * 10 + 0.5) / 10 AS one, sign(c_acctbal) * floor(abs(c_acctbal) * 100 + 0.5) / 100 AS two, greatest(0.0::DOUBLE, least(1.0::DOUBLE, c_acctbal / 5000)) AS clamped, CAST((1500 * c_custkey // 3) // 1000 AS BIGINT) AS eta FROM customer")
def arithmetic(s: Source) -> DataFrame:
    b = C("c_acctbal")
    return s.table("customer").select("c_custkey", numbers.round1(F.abs(b)).alias("one"), numbers.round_away(b, 2).alias("two"), numbers.clamp01(b / 5000).alias("clamped"), numbers.eta_seconds(F.lit(1500), C("c_custkey"), F.lit(3)).alias("eta"))


@query("arr1_arr2_arr3_arr4_json", """SELECT question_id, json_valid(coalesce(answer_json, '')) AS valid, CASE WHEN json_valid(coalesce(answer_json, '')) THEN json_array_length(answer_json) END AS n, split_part(stem, ' ', 2) AS second FROM questions""".replace("json_array_length(answer_json)", "CAST(json_array_length(answer_json) AS INTEGER)"))
def json(s: Source) -> DataFrame:
    return s.questions().select("question_id", F.coalesce(F.try_parse_json("answer_json").isNotNull(), F.lit(False)).alias("valid"), F.json_array_length("answer_json").alias("n"), F.get(F.from_json("knowledge_points_json", "array<string>"), F.lit(1)).alias("second"))


@query("map1_variant", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def variant(s: Source) -> DataFrame:
    return s.table("events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("set4_set7_answers", "SELECT question_id, question_id % 2 = 0 AS equal, CAST(CASE WHEN question_id % 3 = 0 THEN 2 ELSE 3 END AS INTEGER) AS n_options, question_id % 3 = 1 AS conflict FROM questions")
def multisets(s: Source) -> DataFrame:
    """Answers as multisets (repeats count), and option lists merged by key with a conflict flag."""
    a, b = F.array(F.lit("A"), F.lit("A"), F.lit("B")), F.when(C("question_id") % 2 == 0, F.array(F.lit("B"), F.lit("A"), F.lit("A"))).otherwise(F.array(F.lit("B"), F.lit("A")))
    option = lambda k, v: F.struct(F.lit(k).alias("key"), F.lit(v).alias("content"))
    left = F.array(option("A", "x"), option("B", "y"))
    right = F.when(C("question_id") % 3 == 0, F.array(option("a", "X "))).when(C("question_id") % 3 == 1, F.array(option("A", "z"), option("C", "w"))).otherwise(F.array(option("C", "w")))
    merged = sets.merge_options(left, right, text.fragment)
    return s.questions().select("question_id", (F.sort_array(a) == F.sort_array(b)).alias("equal"), merged.alias("m")).select("question_id", "equal", F.size("m.options").alias("n_options"), "m.conflict")


@query("prj1_prj2_prj3_projection", "SELECT question_id, coalesce(nullif(CASE WHEN type = 'fill_blank' THEN '' ELSE type END, ''), 'unknown') AS kind, CASE WHEN status = 'draft' THEN 'hidden' WHEN difficulty >= 4 THEN 'hard' ELSE 'open' END AS stage FROM questions")
def projection(s: Source) -> DataFrame:
    kind = F.when(C("type") == "fill_blank", "").otherwise(C("type"))
    return s.questions().select("question_id", F.coalesce(F.nullif(kind, F.lit("")), F.lit("unknown")).alias("kind"), F.when(C("status") == "draft", "hidden").when(C("difficulty") >= 4, "hard").otherwise("open").alias("stage"))
