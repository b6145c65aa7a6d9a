"""Ordered operators: fills, islands, gaps, spines, segments, interval merges and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scholia.operators import ranges


def upto(keys: list[str], order: list) -> W:
    return W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)


def fill_with_seed(df: DataFrame, keys: list[str], order: list, explicit: str, stored: str, out: str) -> DataFrame:
    """The last explicit value so far; before any, the first stored one so far. Empty counts as missing."""
    w = upto(keys, order)
    e, s = (F.when(F.col(c) != "", F.col(c)) for c in (explicit, stored))
    return df.withColumn(out, F.coalesce(F.last(e, True).over(w), F.first(s, True).over(w), F.lit("")))


def fill_stored_first(df: DataFrame, keys: list[str], order: list, explicit: str, stored: str, out: str) -> DataFrame:
    """Stored beats explicit beats what is carried on."""
    e, s = (F.when(F.col(c) != "", F.col(c)) for c in (explicit, stored))
    return df.withColumn(out, F.coalesce(F.last(F.coalesce(s, e), True).over(upto(keys, order)), F.lit("")))


def islands(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Runs of consecutive whole numbers: keys, island_start, island_end, size. Repeats count once."""
    d = df.select(*keys, number).distinct()
    g = d.withColumn("__g", F.col(number) - F.row_number().over(W.partitionBy(*keys).orderBy(number)))
    return g.groupBy(*keys, "__g").agg(F.min(number).alias("island_start"), F.max(number).alias("island_end"), F.count("*").alias("size")).drop("__g")


def streaks(days: DataFrame, keys: list[str], day: str, as_of: Column) -> DataFrame:
    """Consecutive days up to as_of, or up to the day before it; keys without such a run have no row."""
    runs = islands(days.withColumn("__n", F.datediff(F.col(day), F.lit("1970-01-01"))), keys, "__n")
    today = F.datediff(as_of, F.lit("1970-01-01"))
    return runs.where((F.col("island_end") == today) | (F.col("island_end") == today - 1)).groupBy(*keys).agg(F.max_by("size", "island_end").alias("streak_days"))


def interior_gaps(df: DataFrame, keys: list[str], number: str, page: str, least: int = 3, slack: int = 10) -> DataFrame:
    """Numbers missing inside dense runs: groups of at least `least` distinct numbers whose span is at most their count
    plus `slack`. Each missing number comes with the pages of its neighbours."""
    g = df.groupBy(*keys, number).agg(F.min(page).alias("__p")).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(number, "__p"))).alias("pages"), F.min(number).alias("lo"), F.max(number).alias("hi"), F.count("*").alias("n")
    )
    g = g.where((F.col("n") >= least) & (F.col("hi") - F.col("lo") + 1 <= F.col("n") + slack))
    g = g.select(*keys, "pages", F.explode(F.array_except(F.sequence("lo", "hi"), F.map_keys("pages"))).alias("missing"))
    before, after = F.try_element_at("pages", F.col("missing") - 1), F.try_element_at("pages", F.col("missing") + 1)
    return g.select(*keys, "missing", F.coalesce(before, after).alias("page_start"), F.coalesce(after, before).alias("page_end"))


def tail_extension(known: DataFrame, extra: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Rows of extra whose numbers follow a group's highest known one without a hole."""
    top = known.groupBy(*keys).agg(F.max(number).alias("__top"))
    more = extra.join(top, keys).where(F.col(number) > F.col("__top"))
    rank = F.dense_rank().over(W.partitionBy(*keys).orderBy(number))
    return more.withColumn("__k", rank).where(F.col(number) == F.col("__top") + F.col("__k")).drop("__k", "__top")


def spine(days: DataFrame, keys: list[str], day: str, values: list[str], as_of: Column, n: int) -> DataFrame:
    """The n days up to as_of for each key, values 0 where a day has none."""
    n = n if 1 <= n <= 90 else 30
    every = days.select(*keys).distinct().withColumn(day, F.explode(F.sequence(F.date_sub(as_of, n - 1), F.to_date(as_of))))
    return every.join(days, [*keys, day], "left").select(*keys, day, *(F.coalesce(v, F.lit(0)).cast("long").alias(v) for v in values))


def segments(df: DataFrame, keys: list[str], order: list, is_start: Column, out: str = "segment") -> DataFrame:
    """Rows with the number of the segment they stand in; what precedes the first start goes."""
    return df.withColumn(out, F.sum(is_start.cast("int")).over(upto(keys, order))).where(F.col(out) > 0)


def drop_repeats(df: DataFrame, keys: list[str], order: list, value: str, least_bytes: int = 4) -> DataFrame:
    """Without rows that equal the one before them and hold enough bytes."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__b", before).where(~(F.col(value).eqNullSafe(F.col("__b")) & (F.octet_length(F.trim(value)) >= least_bytes))).drop("__b")


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, slack: int = 1) -> DataFrame:
    """Closed ranges of a key joined where they overlap or lie `slack` apart."""
    w = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("__new", (reach.isNull() | (F.col(start) > reach + slack)).cast("int"))
    grouped = marked.withColumn("__g", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return grouped.groupBy(*keys, "__g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__g")


def chains(df: DataFrame, keys: list[str], order: list, starts_mid: Column, anonymous: Column, ends_mid: str, out: str = "chain") -> DataFrame:
    """Chain numbers: a row joins the one before it if it starts midway, or is anonymous after one that ends midway."""
    before = F.lag(ends_mid).over(W.partitionBy(*keys).orderBy(*order))
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) == 1
    joins = ~first & (starts_mid | (anonymous & F.coalesce(before, F.lit(False))))
    return df.withColumn("__j", joins).withColumn(out, F.sum((~F.col("__j")).cast("int")).over(upto(keys, order))).drop("__j")


def first_row(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def renumber(df: DataFrame, keys: list[str], order: list, out: str) -> DataFrame:
    return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def trailing_count(df: DataFrame, keys: list[str], ts: str, seconds: int, out: str) -> DataFrame:
    """How many rows of a key fall in the `seconds` up to each row, itself included."""
    micros = seconds * 1_000_000
    return df.withColumn("__t", F.unix_micros(ts)).withColumn(out, F.count("*").over(W.partitionBy(*keys).orderBy("__t").rangeBetween(-micros, 0))).drop("__t")


def repair_types(directory: DataFrame) -> DataFrame:
    """Contiguous runs take the type and set of their first entry: a row whose number is the one before plus 1, on a page at
    most one after the one before, in the same scope of a document, inherits, and hands on what it inherited."""

    def goes_on(before: Column) -> Column:
        return F.col("section_scope").eqNullSafe(before["section_scope"]) & (F.col("question_no") == before["question_no"] + 1) & (F.col("page_start") <= before["page_end"] + 1)

    return ranges.carried(directory, ["document_id"], ["page_start", "marker_top", "id"], ["section_scope", "question_no", "page_end"], ["question_type", "set_no"], goes_on)


def normalise_scopes(directory: DataFrame, generic: list[str]) -> DataFrame:
    """As-of headings: two streams of each document (questions; answers and explanations). A row keeps its own scope unless
    that is empty or a generic parent of the heading in force, then takes the nearest heading at or before it."""
    stream = F.when(F.col("content_role") == "question", "question").otherwise("answer")
    order = ["page_start", "marker_top", "id"]
    own = F.when((F.col("section_scope") != "") & ~F.col("section_scope").isin(generic), F.col("section_scope"))
    w = W.partitionBy("document_id", stream).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return directory.withColumn("section_scope", F.coalesce(F.last(own, True).over(w), F.col("section_scope"), F.lit("")))
