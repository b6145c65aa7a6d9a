"""Joins that refuse to guess: unique-match, cascade, tolerant, overlap and best-with-a-gap."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scholia.operators import marks


def _aliased(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """right with r_ before its column names, so that no name clashes."""
    return left, right.select(*(F.col(f"`{c}`").alias(f"r_{c}") for c in right.columns))


def unique_join(left: DataFrame, right: DataFrame, on: Column, left_id: str) -> DataFrame:
    """left rows with their right row (columns r_*) where exactly one matches; none and several both give no row.

    `on` may name left columns and r_ columns."""
    a, b = _aliased(left, right)
    matched = a.join(b, on)
    return matched.withColumn("__n", F.count("*").over(W.partitionBy(left_id))).where("__n = 1").drop("__n")


def left_unique_join(left: DataFrame, right: DataFrame, on: Column, left_id: str, right_id: str) -> DataFrame:
    """Every left row; r_ columns are null unless exactly one right row matches. matches: how many do."""
    a, b = _aliased(left, right)
    matched = a.join(b, on, "left")
    w = W.partitionBy(left_id)
    counted = matched.withColumn("matches", F.count(f"r_{right_id}").over(w)).withColumn("__k", F.row_number().over(w.orderBy(f"r_{right_id}"))).where("__k = 1").drop("__k")
    return counted.select(*left.columns, *(F.when(F.col("matches") == 1, F.col(c)).alias(c) for c in b.columns), "matches")


class Rung(NamedTuple):
    """Keys of left and right rows that must be equal, and which rows of either side take part; several rungs may share a tier."""

    tier: int
    left: list[Column]
    right: list[Column]
    left_where: Column | None = None
    right_where: Column | None = None

    def keys(self) -> list[str]:
        return [f"__k{i}" for i in range(len(self.left))]

    def of_left(self, rows: DataFrame) -> DataFrame:
        return self._keyed(rows, self.left, self.left_where)

    def of_right(self, rows: DataFrame) -> DataFrame:
        return self._keyed(rows, self.right, self.right_where)

    def _keyed(self, rows: DataFrame, values: list[Column], where: Column | None) -> DataFrame:
        return (rows if where is None else rows.where(where)).withColumns(dict(zip(self.keys(), values)))


def cascade_totals(left: DataFrame, right: DataFrame, rungs: list[Rung], total: Callable[[DataFrame, list[str]], DataFrame], left_id: str = "id") -> DataFrame:
    """(left_id, tier, columns of the total): for each left row and rung what the right rows of its key add up to.

    total(right rows, keys) gives a row for each key. It is made before the join, so a left row meets one row a rung, however many right rows have its
    key; pairs never form."""
    met = (r.of_left(left).select(left_id, *r.keys()).join(total(r.of_right(right), r.keys()), r.keys()).drop(*r.keys()).withColumn("tier", F.lit(r.tier)) for r in rungs)
    return reduce(DataFrame.unionByName, met)


def cascade_join(left: DataFrame, right: DataFrame, rungs: list[Rung], left_id: str = "id") -> DataFrame:
    """Each left row with all right rows (columns as r_*) of the lowest tier that has any, and that tier.

    Which tier that is, distinct keys say; only then rows are joined, so no pair is made that isn't returned and none is shuffled."""
    met = cascade_totals(left, right, rungs, lambda rows, keys: rows.select(*keys).distinct(), left_id)
    top = met.groupBy(F.col(left_id).alias("__id")).agg(F.min("tier").alias("tier"))
    kept = left.join(top, F.col(left_id).eqNullSafe(F.col("__id"))).drop("__id")
    other = [F.col(f"`{c}`").alias(f"r_{c}") for c in right.columns]
    pairs = (r.of_left(kept.where(F.col("tier") == r.tier)).join(r.of_right(right).select(*r.keys(), *other), r.keys()).drop(*r.keys()) for r in rungs)
    return reduce(DataFrame.unionByName, pairs)


def tolerant(a: Column, b: Column) -> Column:
    """Equal, or either is 0."""
    return (a == b) | (a == 0) | (b == 0)


def overlaps(start: Column, end: Column, r_start: Column, r_end: Column) -> Column:
    return (end >= r_start) & (start <= r_end)


def overlap_join(left: DataFrame, right: DataFrame, key: str, start: str, end: str, width: int = 16) -> DataFrame:
    """Pairs of one key whose closed ranges overlap (right's columns as r_*), once each.

    Ranges are filed under the cells of `width` that they touch, so a key with many ranges deals out over its cells."""
    a, b = _aliased(left, right)
    cells = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))
    a, b = a.withColumn("__cell", cells(start, end)), b.withColumn("r___cell", cells(f"r_{start}", f"r_{end}"))
    on = (F.col(key) == F.col(f"r_{key}")) & (F.col("__cell") == F.col("r___cell")) & overlaps(F.col(start), F.col(end), F.col(f"r_{start}"), F.col(f"r_{end}"))
    first = F.floor(F.greatest(F.col(start), F.col(f"r_{start}")) / width)  # the cell where the overlap begins
    return a.join(b, on).where(F.col("__cell") == first).drop("__cell", "r___cell")


def either_join(left: DataFrame, right: DataFrame, first: Column, second: Column) -> DataFrame:
    """Pairs for which one or the other equality holds, by two hash joins and no nested loop."""
    a, b = _aliased(left, right)
    return a.join(b, first).unionByName(a.join(b, second & ~F.coalesce(first, F.lit(False))))


def best_with_gap(scored: DataFrame, left_id: str, score: str, tie: str, least: float = 0.0, gap: float = 0.0) -> DataFrame:
    """The best row of each left_id if its score is above `least` and more than `gap` ahead of the second best."""
    w = W.partitionBy(left_id).orderBy(F.desc(score), F.asc(tie))
    ranked = scored.withColumn("rank", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead(score).over(w), F.lit(0.0)))
    return ranked.where((F.col("rank") == 1) & (F.col(score) > least) & (F.col(score) > F.col("second") + gap)).drop("rank")


def _equal(by: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(k) == F.col(f"r_{k}") for k in by])


def _meet(needles: DataFrame, stacks: DataFrame, by: list[str]) -> DataFrame:
    """(*by, __q, __p) of needles (*by, __q, __t) and stacks (*by, __p, __t) of equal `by` that share a needle's mark; all that hold one are among them."""
    own = marks.of_needles(needles)
    levels = own.select("n").distinct().groupBy().agg(F.collect_set("n").alias("__ns"))  # as many values as texts have powers of two
    other = marks.of_stacks(stacks.join(F.broadcast(levels)))
    return own.join(other.hint("merge"), [*by, "n", "g"]).select(*by, "__q", "__p").distinct()  # Spark takes marks for no larger than their texts and would broadcast them


def contained_join(needles: DataFrame, stacks: DataFrame, by: list[str], text: str) -> DataFrame:
    """Pairs of equal `by` in which the stack's text (columns as r_*) holds the needle's anywhere; once each, empty needles in none.

    They meet by marks of windows and are verified on the texts: what meets shares a gram of a quarter of the needle, and the rows to join are a fraction of
    the texts' lengths, not pairs."""
    texts = lambda d, name: d.where(F.char_length(text) > 0).select(*by, F.xxhash64(text).alias(name), F.col(text).alias("__t")).distinct()
    met = _meet(texts(needles, "__q"), texts(stacks, "__p"), by)  # texts go along only with what has met
    a, b = _aliased(needles, stacks)
    left = met.join(a.withColumn("__q", F.xxhash64(text)), [*by, "__q"]).withColumn("r___p", F.col("__p")).drop("__p", "__q")
    return left.join(b.withColumn("r___q", F.xxhash64(f"r_{text}")), _equal(by) & (F.col("r___p") == F.col("r___q"))).where(F.contains(f"r_{text}", text)).select(*a.columns, *b.columns)


def contained_texts(needles: DataFrame, stacks: DataFrame, by: list[str], text: str) -> DataFrame:
    """(*by, needle, stack): hashes of different texts of equal `by` of which the stack holds the needle, once for each pair of texts, however many rows have them.

    needles and stacks: distinct (*by, text)."""
    own, other = needles.select(*by, F.xxhash64(text).alias("__q"), F.col(text).alias("__t")), stacks.select(*by, F.xxhash64(text).alias("__p"), F.col(text).alias("__t"))
    met = _meet(own, other, by).where("__q <> __p")
    both = met.join(own, [*by, "__q"]).withColumnRenamed("__t", "__n").join(other, [*by, "__p"])
    return both.where(F.contains("__t", "__n")).select(*by, F.col("__q").alias("needle"), F.col("__p").alias("stack"))


def _holders(needles: DataFrame, stacks: DataFrame, by: list[str]) -> DataFrame:
    """(*by, __q, __p) of needles (*by, __q, __t) and stacks (*by, __p, __t) of equal `by` that hold them. A needle meets stacks by the one of its longest grams that
    the fewest of them have, and none if one of its grams is in no stack."""
    own = marks.grams(needles, True)
    levels = own.select("n").distinct().groupBy().agg(F.collect_set("n").alias("__ns"))  # as many values as texts have powers of two
    other = marks.grams(stacks.join(F.broadcast(levels)), False)
    held = other.groupBy(*by, "n", "g").agg(F.count("*").alias("held"))
    rarest = own.join(held.hint("merge"), [*by, "n", "g"], "left").groupBy(*by, "__q", "n").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "g")).alias("r")).where("r.held > 0")
    met = rarest.select(*by, "__q", "n", "r.g").join(other.hint("merge"), [*by, "n", "g"]).select(*by, "__q", "__p")  # Spark takes grams for no larger than their texts and would broadcast them
    both = met.hint("merge").join(needles.withColumnRenamed("__t", "__n"), [*by, "__q"]).hint("merge").join(stacks, [*by, "__p"])  # texts go along only with what has met
    return both.where(F.contains("__t", "__n")).select(*by, "__q", "__p")


def clear_beginning(left: DataFrame, right: DataFrame, by: list[str], text: str, least: float = 0.75, gap: float = 0.1) -> DataFrame:
    """(id, r_id, score): for each left row the right row of equal `by` whose text it clearly shares.

    A score is 1 if one text holds the other, else the share of the shorter one that is a common beginning; it must reach `least` and lead the next by more
    than `gap`. Of all texts with one beginning only the two shortest can be a left text's best and second by it: any other has a common beginning no longer and
    is no shorter. So beginnings keep two texts each, and a left text meets two for each of its own, however many share them. Equal texts count once, with the
    number of their rows. Empty texts score nothing."""
    share, size = least - gap - 1e-9, F.char_length("__t")
    said = lambda d, name: d.where(F.char_length(text) > 0).select("id", *by, F.xxhash64(text).alias(name), F.col(text).alias("__t"))
    rows = said(left, "__x")
    mine = rows.select(*by, "__x", "__t").distinct()
    theirs = said(right, "__y").groupBy(*by, "__y", "__t").agg(F.min("id").alias("r_id"), F.count("*").alias("copies"))

    shortest = F.row_number().over(W.partitionBy(*by, "n", "g").orderBy("long", "__y"))
    ends = marks.beginnings(theirs.select(*by, "__y", size.alias("long"), "__t")).withColumn("__k", shortest).where("__k <= 2").drop("__k")
    begun = marks.beginnings(mine.select(*by, "__x", size.alias("own"), "__t")).join(ends.hint("merge"), [*by, "n", "g"])
    part = F.col("n").cast("double") / F.least("own", "long")
    begun = begun.where(part >= share).groupBy(*by, "__x", "__y").agg(F.max(part).alias("score"))

    a, b = mine.withColumnRenamed("__x", "__q"), theirs.select(*by, F.col("__y").alias("__p"), "__t")
    inside = _holders(a, b, by).select(*by, F.col("__q").alias("__x"), F.col("__p").alias("__y"))
    around = _holders(b.withColumnRenamed("__p", "__q"), a.withColumnRenamed("__q", "__p"), by).select(*by, F.col("__p").alias("__x"), F.col("__q").alias("__y"))
    whole = inside.unionByName(around).withColumn("score", F.lit(1.0))

    scored = begun.unionByName(whole).groupBy(*by, "__x", "__y").agg(F.max("score").alias("score")).hint("merge").join(theirs.drop("__t"), [*by, "__y"])
    best = F.max(F.struct("score", "copies", "r_id")).alias("best")
    top = scored.groupBy(*by, "__x").agg(best, F.max_by("__y", F.struct("score", "copies", "r_id")).alias("__y"))
    rest = scored.join(top.select(*by, "__x", F.col("__y").alias("__top")).hint("merge"), [*by, "__x"]).where("__y <> __top").groupBy(*by, "__x").agg(F.max("score").alias("next"))
    clear = top.join(rest.hint("merge"), [*by, "__x"], "left").withColumn("second", F.when(F.col("best.copies") > 1, F.col("best.score")).otherwise(F.coalesce("next", F.lit(0.0))))
    clear = clear.where((F.col("best.score") >= least) & (F.col("best.score") > F.col("second") + gap))
    return rows.select("id", *by, "__x").join(clear.hint("merge"), [*by, "__x"]).select("id", F.col("best.r_id").alias("r_id"), F.col("best.score").alias("score"))


def scalar_counts(parent: DataFrame, child: DataFrame, parent_id: str, child_key: str, name: str) -> DataFrame:
    """parent with the number of its child rows, 0 for none."""
    n = child.groupBy(F.col(child_key).alias("__key")).agg(F.count("*").alias(name))
    return parent.join(n, F.col(parent_id) == F.col("__key"), "left").drop("__key").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
