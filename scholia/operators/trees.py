"""Trees as parent links, of any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scholia.session import stored

C = F.col


def ancestors(nodes: DataFrame) -> DataFrame:
    """(id, ancestor, distance) of every node, itself at 0 included; nodes: id, parent.

    A node whose parent is null or missing is a root. By pointer doubling: after k rounds each node knows its ancestors up to 2^k - 1 steps away and the one
    2^k steps away, so the rounds are the logarithm of the depth. Nodes on or below a ring of parents have no root and no row."""
    own = nodes.select("id", "parent").dropDuplicates(["id"])
    jump = stored(own.join(own.select(C("id").alias("parent")), "parent", "left_semi").select("id", C("parent").alias("to")), "jump")
    known = stored(own.select("id", C("id").alias("ancestor"), F.lit(0).cast("long").alias("distance")), "ancestors")
    total, step = own.count(), 1
    while step < 2 * total and not jump.isEmpty():
        further = jump.join(known.select(C("id").alias("to"), "ancestor", (C("distance") + step).alias("distance")), "to").select("id", "ancestor", "distance")
        known = stored(known.unionByName(further), "ancestors")
        jump = stored(jump.alias("a").join(jump.select(C("id").alias("to"), C("to").alias("next")), "to").select("id", C("next").alias("to")), "jump")
        step *= 2
    return known if jump.isEmpty() else known.join(jump.select("id"), "id", "left_anti")  # who still has somewhere to go walks a ring


def tree(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """(id, parent, level, path, place, leaves) of nodes: id, parent, name, sort_order; leaves: node, n.

    level is 1 for roots, among them nodes whose parent is missing, which lose it; path holds the names from the root on; place is a node's number
    among its parent's children (or among roots) by (sort_order, id); leaves are those of a node and of all below it."""
    up = ancestors(nodes)
    named = up.join(nodes.select(C("id").alias("ancestor"), "name"), "ancestor")
    path = named.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-C("distance")).alias("d"), "name"))), lambda x: x["name"]).alias("path"))  # as long as the tree is deep
    parent = up.where("distance = 1").select("id", C("ancestor").alias("parent"))
    below = leaves.groupBy("node").agg(F.sum("n").alias("n")).join(up, C("node") == C("id")).groupBy(C("ancestor").alias("id")).agg(F.sum("n").alias("leaves"))
    out = nodes.select("id", "sort_order").join(path, "id").join(parent, "id", "left").join(below, "id", "left")
    place = F.row_number().over(W.partitionBy("parent").orderBy("sort_order", "id"))
    return out.select("id", "parent", F.size("path").alias("level"), "path", place.alias("place"), F.coalesce("leaves", F.lit(0)).cast("long").alias("leaves"))
