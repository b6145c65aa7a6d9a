"""Work in one global order that is dealt over ranges: numbering, and values carried from row to row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scholia.session import stored

C = F.col


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df in ranges of the order, written once so that they stay what they are; __part numbers them. Only rows that are equal in all of the order must share one."""
    return stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")


def numbered(df: DataFrame, order: list[str], out: str, after: int = 0) -> DataFrame:
    """df with whole numbers from after + 1 on, in the given order (columns that no two rows share): each range is counted, ranges are numbered
    from where those before them end, and rows within theirs."""
    parts = ranged(df, order)
    before, starts = after, []
    for r in parts.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect():  # a row a range
        starts.append((r["__part"], before))
        before += r["n"]
    own = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    at = df.sparkSession.createDataFrame(starts, "__part int, __start long")
    return parts.withColumn("__k", own).join(F.broadcast(at), "__part").withColumn(out, C("__start") + C("__k")).drop("__part", "__start", "__k")


def carried(df: DataFrame, keys: list[str], order: list[str], facts: list[str], values: list[str], goes_on) -> DataFrame:
    """values of each row replaced by those of the first row of its run, in order within the keys.

    goes_on(before) is a condition of a row, given the facts of the one before it as a struct: a row for which it holds belongs to the run of that row. A key's
    rows may fill many ranges: each finds its own runs, and what the first run of a range inherits follows from one row for each range and key."""
    full = [*keys, *order]
    parts = ranged(df, full)
    local = W.partitionBy("__part", *keys).orderBy(*order)
    fact, own = F.struct(*facts), F.struct(*values)
    rows = parts.withColumn("__before", F.lag(fact).over(local))
    rows = rows.withColumn("__breaks", F.when(C("__before").isNotNull(), ~F.coalesce(goes_on(C("__before")), F.lit(False)))).drop("__before")
    first = F.min(F.struct(*order, F.struct(*dict.fromkeys([*order, *facts, *values])).alias("row")))
    last = F.max(F.struct(*order, fact.alias("fact")))
    inner = F.max(F.when(C("__breaks"), F.struct(*order, own.alias("own"))))
    edges = rows.groupBy("__part", *keys).agg(first.alias("f"), last.alias("l"), inner.alias("b"))
    along = W.partitionBy(*keys).orderBy("__part")  # a row for each range that holds the key
    edges = edges.select("__part", *keys, "b", C("f.row").alias("__row"), F.lag("l.fact").over(along).alias("__last"))
    joins = edges.select("__part", *keys, "b", "__last", "__row.*").withColumn("__joins", F.coalesce(goes_on(C("__last")), F.lit(False)))
    head = joins.withColumn("__own", own)
    known = F.coalesce(C("b.own"), F.when(~C("__joins"), C("__own")))
    handed = F.last(known, True).over(along.rowsBetween(W.unboundedPreceding, -1))
    head = head.withColumn("__head", F.when(C("__joins"), handed).otherwise(C("__own"))).select("__part", *keys, "__head")
    since = F.last(F.when(C("__breaks"), own), True).over(local.rowsBetween(W.unboundedPreceding, W.currentRow))
    out = rows.withColumn("__since", since).join(head, ["__part", *keys]).withColumn("__value", F.coalesce("__since", "__head"))
    return out.select(*(C(f"__value.{c}").alias(c) if c in values else C(c) for c in df.columns))
