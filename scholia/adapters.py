"""Views that read the sample tables as the engine's own tables, as DataFrames and as the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions.numbers import add_days

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


class Source:
    """The tables of one folder, and the engine's views over them."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def attempts(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            F.col("event_id").alias("attempt_id"), "user_id", (F.from_json("props", "k long")["k"] + 1).alias("question_id"),
            (F.col("event_type") != "error").cast("int").alias("is_correct"), F.floor(F.col("value") * 10).cast("long").alias("duration_ms"), F.col("ts").cast("timestamp").alias("created_at"),
        )

    def as_of(self) -> DataFrame:
        return self.table("events").agg(F.max(F.col("ts").cast("timestamp")).alias("as_of"))

    def questions(self) -> DataFrame:
        k, size = F.col("p_partkey"), F.col("p_size")
        kinds = F.array(*(F.lit(x) for x in ("single_choice", "multiple_choice", "true_false", "fill_blank", "short_answer")))
        return self.table("part").select(
            k.alias("question_id"), (k % 25).alias("bank_id"), F.col("p_brand").alias("subject"), F.col("p_type").alias("chapter"),
            F.concat_ws(" ", "p_name", (k % 40).cast("string")).alias("stem"), F.get(kinds, (k % 5).cast("int")).alias("type"),
            F.when(k % 7 == 0, "draft").otherwise("published").alias("status"), (size % 5 + 1).cast("double").alias("difficulty"),
            F.when(size % 6 == 0, '["A"]').when(size % 6 == 1, '["A","C"]').when(size % 6 == 2, "[]").when(size % 6 == 3, F.lit(None)).when(size % 6 == 4, '[" "]').otherwise("not json").alias("answer_json"),
            F.when(size % 4 == 1, '[{"key":"A","content":""}]').when(size % 4 == 2, "[]").otherwise('[{"key":"A","content":"x"},{"key":"B","content":"y"}]').alias("options_json"),
            F.to_json(F.array(F.split("p_name", " ")[0], F.split("p_name", " ")[1])).alias("knowledge_points_json"),
        )

    def banks(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").cast("long").alias("bank_id"), F.col("n_regionkey").cast("long").alias("owner_id"), F.col("n_name").alias("name"))

    def wrong(self) -> DataFrame:
        """Wrong book of all users: state that a plain aggregate of the attempts gives."""
        a = self.attempts().where("is_correct = 0").groupBy("user_id", "question_id").agg(F.count("*").alias("wrong_count"), F.max("created_at").alias("last_wrong_at"))
        return a.withColumn("next_review_at", F.when(F.col("question_id") % 3 > 0, add_days(F.col("last_wrong_at"), F.col("wrong_count") % 5))).withColumn(
            "status", F.when(F.col("question_id") % 4 == 0, "mastered").otherwise("learning")
        )

    def favorites(self) -> DataFrame:
        return self.attempts().join(self.table("events").where("event_type = 'purchase'").select(F.col("event_id").alias("attempt_id")), "attempt_id").select("user_id", "question_id").distinct()

    def directory(self) -> DataFrame:
        """Directory entries from part: documents of forty entries, more of them the more there are."""
        k = F.col("p_partkey")
        return self.table("part").select(
            k.alias("id"), (F.floor(k / 200) * 5 + k % 5).alias("document_id"), F.when(k % 3 == 0, "answer").otherwise("question").alias("content_role"),
            F.when(k % 4 == 0, "").otherwise(F.col("p_brand")).alias("section_scope"), (F.col("p_size") % 3).cast("int").alias("set_no"),
            F.get(F.array(F.lit("single"), F.lit("judge"), F.lit("essay")), (k % 3).cast("int")).alias("question_type"), (F.floor(k % 200 / 5) + 1).cast("long").alias("question_no"),
            (F.floor(k % 200 / 10) + 1).cast("long").alias("page_start"), (F.floor(k % 200 / 10) + 1 + F.col("p_size") % 2).cast("long").alias("page_end"), (F.col("p_size") * 7 % 10).cast("int").alias("marker_top"), F.col("p_name").alias("anchor"),
        )

    def candidates(self) -> DataFrame:
        """Candidate questions from part, whose scopes answers may share."""
        k = F.col("p_partkey")
        return self.table("part").select(
            k.alias("id"), F.col("p_brand").alias("section_scope"), F.concat_ws("/", "p_type", "p_brand").alias("section_path"), (F.col("p_size") % 3).cast("int").alias("set_no"),
            F.get(F.array(F.lit("single_choice"), F.lit("true_false"), F.lit("subjective")), (k % 3).cast("int")).alias("question_type"), (k % 40).cast("long").alias("question_no"), F.col("p_name").alias("stem"),
            F.floor(k % 200 / 20).cast("long").alias("page_start"), (F.floor(k % 200 / 20) + k % 3).cast("long").alias("page_end"), F.floor(k / 200).alias("document_id"),
        )

    def answers(self) -> DataFrame:
        """Answer records from customer."""
        k = F.col("c_custkey")
        return self.table("customer").select(
            k.alias("id"), F.concat(F.lit("Brand#"), (k % 25 + 1).cast("string")).alias("section_scope"),
            F.concat_ws("/", F.get(F.array(*(F.lit(x) for x in ("STANDARD", "ECONOMY", "MEDIUM", "PROMO", "LARGE", "SMALL"))), (k % 6).cast("int")), F.concat(F.lit("Brand#"), (k % 25 + 1).cast("string"))).alias("section_path"),
            (F.col("c_nationkey") % 3).alias("set_no"), F.get(F.array(F.lit("single_choice"), F.lit("true_false"), F.lit("subjective")), (k % 3).cast("int")).alias("question_type"),
            (F.floor(k / 25) % 40).cast("long").alias("question_no"), F.substring("c_mktsegment", 1, 1).alias("value"), (F.col("c_nationkey") % 5).alias("run_id"), F.col("c_acctbal").alias("confidence"),
            F.floor(k % 150 / 15).cast("long").alias("page_start"), (F.floor(k % 150 / 15) + k % 2).cast("long").alias("page_end"), F.floor(k / 150).alias("document_id"),
        )

    def lines(self) -> DataFrame:
        """(doc_id, page_no, line_no, line): documents as pages of 10 lines."""
        d = self.table("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
        return d.select("doc_id", (F.floor(F.col("i") / 10) + 1).cast("int").alias("page_no"), F.col("i").alias("line_no"), F.trim("line").alias("line"))


#: The same views as SQL for DuckDB.
SQL = r"""
attempts AS (
  SELECT event_id AS attempt_id, user_id, CAST(props->>'$.k' AS BIGINT) + 1 AS question_id, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS is_correct,
         CAST(floor(value * 10) AS BIGINT) AS duration_ms, CAST(ts AS TIMESTAMP) AS created_at, event_type FROM events),
now AS (SELECT max(CAST(ts AS TIMESTAMP)) AS as_of FROM events),
questions AS (
  SELECT p_partkey AS question_id, p_partkey % 25 AS bank_id, p_brand AS subject, p_type AS chapter, p_name || ' ' || (p_partkey % 40) AS stem,
         ['single_choice', 'multiple_choice', 'true_false', 'fill_blank', 'short_answer'][p_partkey % 5 + 1] AS type,
         CASE WHEN p_partkey % 7 = 0 THEN 'draft' ELSE 'published' END AS status, CAST(p_size % 5 + 1 AS DOUBLE) AS difficulty,
         CASE p_size % 6 WHEN 0 THEN '["A"]' WHEN 1 THEN '["A","C"]' WHEN 2 THEN '[]' WHEN 3 THEN NULL WHEN 4 THEN '[" "]' ELSE 'not json' END AS answer_json,
         CASE p_size % 4 WHEN 1 THEN '[{"key":"A","content":""}]' WHEN 2 THEN '[]' ELSE '[{"key":"A","content":"x"},{"key":"B","content":"y"}]' END AS options_json,
         '["' || split_part(p_name, ' ', 1) || '","' || split_part(p_name, ' ', 2) || '"]' AS knowledge_points_json FROM part),
banks AS (SELECT CAST(n_nationkey AS BIGINT) AS bank_id, CAST(n_regionkey AS BIGINT) AS owner_id, n_name AS name FROM nation),
wrong AS (
  SELECT user_id, question_id, wrong_count, last_wrong_at,
         CASE WHEN question_id % 3 > 0 THEN last_wrong_at + to_days(CAST(wrong_count % 5 AS INTEGER)) END AS next_review_at,
         CASE WHEN question_id % 4 = 0 THEN 'mastered' ELSE 'learning' END AS status
  FROM (SELECT user_id, question_id, count(*) AS wrong_count, max(created_at) AS last_wrong_at FROM attempts WHERE is_correct = 0 GROUP BY ALL)),
favorites AS (SELECT DISTINCT user_id, question_id FROM attempts WHERE event_type = 'purchase'),
directory AS (
  SELECT p_partkey AS id, p_partkey // 200 * 5 + p_partkey % 5 AS document_id, CASE WHEN p_partkey % 3 = 0 THEN 'answer' ELSE 'question' END AS content_role,
         CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END AS section_scope, p_size % 3 AS set_no, ['single', 'judge', 'essay'][p_partkey % 3 + 1] AS question_type,
         p_partkey % 200 // 5 + 1 AS question_no, p_partkey % 200 // 10 + 1 AS page_start, p_partkey % 200 // 10 + 1 + p_size % 2 AS page_end, p_size * 7 % 10 AS marker_top, p_name AS anchor FROM part),
candidates AS (
  SELECT p_partkey AS id, p_brand AS section_scope, p_type || '/' || p_brand AS section_path, p_size % 3 AS set_no,
         ['single_choice', 'true_false', 'subjective'][p_partkey % 3 + 1] AS question_type, p_partkey % 40 AS question_no, p_name AS stem,
         p_partkey % 200 // 20 AS page_start, p_partkey % 200 // 20 + p_partkey % 3 AS page_end, p_partkey // 200 AS document_id FROM part),
answers AS (
  SELECT c_custkey AS id, 'Brand#' || (c_custkey % 25 + 1) AS section_scope,
         ['STANDARD', 'ECONOMY', 'MEDIUM', 'PROMO', 'LARGE', 'SMALL'][c_custkey % 6 + 1] || '/Brand#' || (c_custkey % 25 + 1) AS section_path, c_nationkey % 3 AS set_no,
         ['single_choice', 'true_false', 'subjective'][c_custkey % 3 + 1] AS question_type, (c_custkey // 25) % 40 AS question_no, substr(c_mktsegment, 1, 1) AS value,
         c_nationkey % 5 AS run_id, c_acctbal AS confidence, c_custkey % 150 // 15 AS page_start, c_custkey % 150 // 15 + c_custkey % 2 AS page_end, c_custkey // 150 AS document_id FROM customer),
lines AS (
  SELECT doc_id, CAST(i // 10 + 1 AS INTEGER) AS page_no, CAST(i AS INTEGER) AS line_no, trim(line) AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents))
"""


def sql(body: str) -> str:
    """A query over the views: body starts with SELECT, or with further views and a comma before the first."""
    return f"WITH RECURSIVE {SQL.strip()}\n{body.strip()}"
