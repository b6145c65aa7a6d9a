"""Set and multiset operators, paging, top-k and folds over logs of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def multiset_difference(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    """left rows without one for each equal row of right; which of equals stay is by `n`, their order of occurrence."""
    count = lambda df: df.groupBy(*cols).agg(F.count("*").alias("n"))
    both = count(left).join(count(right).withColumnRenamed("n", "m"), cols, "left")
    rest = F.col("n") - F.coalesce("m", F.lit(0))
    return both.where(rest > 0).select(*cols, F.explode(F.sequence(F.lit(1).cast("long"), rest)).alias("n"))


def max_merge(parts: list[DataFrame], key: str, score: str, rank: str) -> DataFrame:
    """Union by key with the highest score, ordered by the part and rank a key was first seen at."""
    every = None
    for i, p in enumerate(parts):
        q = p.select(key, score, F.struct(F.lit(i).alias("part"), F.col(rank).cast("long").alias("rank")).alias("seen"))
        every = q if every is None else every.unionByName(q)
    return every.groupBy(key).agg(F.max(score).alias(score), F.min("seen").alias("seen"))


def sorted_union(a: Column, b: Column) -> Column:
    """Trimmed, non-empty, distinct values of two arrays, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.concat(a, b), lambda x: F.trim(x)), lambda x: x != "")))


def merge_options(left: Column, right: Column, norm) -> Column:
    """struct(options, conflict): right's options of new keys after left's; conflict if a key's contents differ."""
    key = lambda o: F.upper(F.trim(o["key"]))
    clash = F.exists(right, lambda r: F.exists(left, lambda x: (key(x) == key(r)) & (key(r) != "") & (norm(x["content"]) != norm(r["content"]))))
    fresh = F.filter(right, lambda r: (key(r) != "") & ~F.exists(left, lambda x: key(x) == key(r)))
    return F.struct(F.concat(left, F.transform(fresh, lambda r: F.struct(key(r).alias("key"), r["content"].alias("content")))).alias("options"), F.coalesce(clash, F.lit(False)).alias("conflict"))


def page(df: DataFrame, order: list, number: int, size: int, most: int = 100, default: int = 20) -> DataFrame:
    """One page of a totally ordered result; an odd size falls back to the default, pages start at 1."""
    size = size if 1 <= size <= most else default
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def after(df: DataFrame, cursor: str, value: int, size: int, most: int = 500) -> DataFrame:
    """Keyset page: rows past a cursor in its order."""
    return df.where(F.col(cursor) > value).orderBy(cursor).limit(min(size, most))


def latest(df: DataFrame, keys: list[str], order: list, values: list[str]) -> DataFrame:
    """Keyed upsert by the last row, with the number of rows as version."""
    s = F.struct(*order)
    return df.groupBy(*keys).agg(*(F.max_by(v, s).alias(v) for v in values), F.count("*").alias("version"))


def keep_prior(df: DataFrame, keys: list[str], order: list, values: list[str]) -> DataFrame:
    """Keyed upsert in which a null keeps the value before."""
    s = F.struct(*order)
    return df.groupBy(*keys).agg(*(F.max_by(F.col(v), F.when(F.col(v).isNotNull(), s)).alias(v) for v in values))


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Insert or ignore."""
    return df.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def cascade_delete(tables: dict[str, DataFrame], roots: DataFrame, edges: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """tables without the roots of the first edge's parent and all that hangs on them.

    edges: (parent, parent key, child, child key), parents before children. roots: (key) of the first parent."""
    first, key = edges[0][0], edges[0][1]
    dead = {first: roots.select(F.col(roots.columns[0]).alias(key)).distinct()}
    out = dict(tables)
    out[first] = tables[first].join(dead[first], key, "left_anti")
    for parent, pk, child, ck in edges:
        gone = dead[parent].select(F.col(pk).alias(ck)).distinct()
        keys = [e[1] for e in edges if e[0] == child]
        dead[child] = tables[child].join(gone, ck, "left_semi").select(*(keys or [ck])).distinct()
        out[child] = tables[child].join(gone, ck, "left_anti")
    return out


def content_hash(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """SHA-256 over a group's rows in order: a row's values joined by "|", rows by line feeds."""
    line = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols))
    rows = F.sort_array(F.collect_list(F.struct(*order, line.alias("line"))))
    return df.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), 256).alias("content_hash"))


def upper_median_recent(df: DataFrame, keys: list[str], order: list, value: str, n: int = 20) -> DataFrame:
    """Element number n div 2 of the sorted newest n values, and the nearest-rank 75th percentile."""
    recent = df.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__k") <= n)
    v = F.sort_array(F.collect_list(value))
    return recent.groupBy(*keys).agg(
        F.get(v, F.floor(F.size(v) / 2).cast("int")).alias("upper_median"), F.element_at(v, F.greatest(F.floor((3 * F.size(v) + 3) / 4), F.lit(1)).cast("int")).alias("p75")
    )
