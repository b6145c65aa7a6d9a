"""Line dedup by winnowing over line hashes, with DataFrame functions only.

A span is `window` consecutive non-blank lines, or one line of at least `min_words` words. Of each span the
smallest line hash is its fingerprint (winnowing: any repeated run of `window` lines shares one). Fingerprints
that occur once can't lie in a repeat, so only spans around repeated ones go on: their positions join on the
hashed lines of the whole span, which extends each fingerprint to both sides. Every span that also starts
earlier (smaller doc_id, or the same document and an earlier line) is marked; marked spans that overlap or touch
form the later repeated runs, which are deleted. Spans are judged on the input, not on what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import drop_saved, fresh, save

#: Lines of a span, and the words from which on a single line is one.
WINDOW, MIN_WORDS = 2, 25
_LAST = 2**63 - 1


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key() -> Column:
    """Rows without an id come after all others."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))


def _tag() -> Column:
    """Tells rows that share an id, or have none, apart by their texts."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def spans(docs: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, tag, at, lines, mark, h1, h2): each span's first line, line numbers, fingerprint and 128-bit hash."""
    line = lambda x, i: F.struct(i.alias("i"), F.xxhash64(F.trim(x)).alias("h"), F.xxhash64(F.lit(1), F.trim(x)).alias("g"), F.trim(x).alias("x"))
    kept = F.filter(F.transform(_lines(F.col("text")), line), lambda r: r["x"] != "")
    words = lambda x: F.size(F.filter(F.split(x, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    runs = F.when(
        F.size("s") >= window,
        F.transform(
            F.sequence(F.lit(1), F.size("s") - window + 1),
            lambda a: F.struct(
                F.transform(F.slice("s", a, window), lambda r: r["i"]).alias("lines"),
                F.array_min(F.transform(F.slice("s", a, window), lambda r: r["h"])).alias("mark"),
                F.xxhash64(F.transform(F.slice("s", a, window), lambda r: r["h"])).alias("h1"),
                F.xxhash64(F.transform(F.slice("s", a, window), lambda r: r["g"])).alias("h2"),
            ),
        ),
    ).otherwise(F.array())
    alone = F.transform(
        F.filter("s", lambda r: words(r["x"]) >= min_words),
        lambda r: F.struct(F.array(r["i"]).alias("lines"), r["h"].alias("mark"), r["h"].alias("h1"), r["g"].alias("h2")),
    )
    both = docs.select(_key().alias("key"), _tag().alias("tag"), kept.alias("s")).select("key", "tag", F.inline(F.concat(runs, alone)))
    return both.select("key", "tag", F.col("lines")[0].alias("at"), "lines", "mark", "h1", "h2")


def repeated_lines(docs: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, tag, gone): the numbers (from 0) of the lines to delete, for each document that has any."""
    every = spans(docs, window, min_words)
    # written first, so that the join is a stage of its own, in which a mark with very many spans can be split
    often = save(every.groupBy("mark").agg(F.count("*").alias("k")).where("k > 1").select("mark"), "marks")
    near = save(every.join(often, "mark", "left_semi").select("key", "tag", "at", "lines", "h1", "h2"), "spans")
    drop_saved(often)
    size = F.size("lines").alias("size")
    first = near.groupBy("h1", "h2", size).agg(F.min(F.struct("key", "tag", "at")).alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    later = near.withColumn("size", F.size("lines")).join(first, ["h1", "h2", "size"]).where(F.struct("key", "tag", "at") > F.col("first"))
    return later.groupBy("key", "tag").agg(F.array_distinct(F.flatten(F.collect_set("lines"))).alias("gone"))


def _joined(docs: DataFrame, window: int, min_words: int) -> tuple[DataFrame, str]:
    """docs with the lines to delete, and the name of that column."""
    key, tag, name = fresh(docs, "key", "tag", "gone")
    gone = repeated_lines(docs, window, min_words).toDF(key, tag, name)
    return docs.join(gone, (_key() == F.col(key)) & (_tag() == F.col(tag)), "left"), name


def _left(text: Column, gone: Column) -> Column:
    lines = _lines(text)
    rest = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i))
    return F.when(gone.isNull(), text).otherwise(F.array_join(rest, "\n"))


def dedup_lines(docs: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later repeated runs deleted from text, and n_chars, where there is one, set to what is left.

    Lines end at a line feed and are compared without the spaces around them; blank lines count for nothing
    and stay. Texts without a repeated run, null ones included, are unchanged. Rows that share an id
    are documents of their own, ordered by a hash of their texts; rows without an id come last, ordered likewise.
    Rows of the same id, or of none, and the same text count as one, so neither is later than the other. A table
    without rows gives none; extra columns may have any name.
    """
    joined, gone = _joined(docs, window, min_words)
    joined = joined.withColumn("text", _left(F.col("text"), F.col(gone)))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns))


def line_report(docs: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines, n_removed, n_runs (of deleted lines next to one another),
    kept_sha256 (of the text that is left). A null text counts as empty, which is one blank line."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    joined, name = _joined(slim, window, min_words)
    gone = F.coalesce(F.col(name), F.array().cast("array<int>"))
    ends = F.array_except(gone, F.transform(gone, lambda i: i + 1))  # a run starts where the line before it stays
    return joined.select(
        "doc_id",
        F.size(_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"),
        F.size(ends).cast("long").alias("n_runs"),
        F.sha2(_left(F.col("text"), F.col(name)), 256).alias("kept_sha256"),
    )


#: The same report for DuckDB. {window} and {min_words} stand for the parameters.
REPORT_SQL = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i
  FROM documents),
kept AS (
  SELECT doc_id, i, trim(x) AS x, lead(trim(x)) OVER w AS x2, lead(i) OVER w AS i2
  FROM raw WHERE trim(x) <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
spans AS (
  SELECT doc_id, i AS pos, [i, i2] AS lines, 'two' || x || chr(10) || x2 AS s FROM kept WHERE x2 IS NOT NULL
  UNION ALL
  SELECT doc_id, i, [i], 'one' || x FROM kept
  WHERE len(list_filter(regexp_split_to_array(x, '[ \t\n\v\f\r]+'), lambda w: w <> '')) >= 25),
firsts AS (SELECT s, min((doc_id, pos)) AS f FROM spans GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(lines) AS i FROM spans JOIN firsts USING (s) WHERE (doc_id, pos) > f),
runs AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE p IS NULL OR p <> i - 1) AS n_runs
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM gone) GROUP BY doc_id),
texts AS (
  SELECT raw.doc_id, count(*) AS n_lines, coalesce(string_agg(x, chr(10) ORDER BY raw.i) FILTER (WHERE gone.i IS NULL), '') AS t
  FROM raw LEFT JOIN gone ON gone.doc_id = raw.doc_id AND gone.i = raw.i GROUP BY raw.doc_id)
SELECT doc_id, n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, sha256(t) AS kept_sha256
FROM texts LEFT JOIN runs USING (doc_id)
"""
