"""Components, roots and paths of any length in about log rounds, each written once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.sources.workspace import Work


def connected(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to (node, label), the label being the component's least node.

    A tree's nodes hang under ever smaller ones: first each node's greater
    neighbours move to its least, then its smaller ones do, until no edge changes.
    Nodes without an edge to another one are absent.
    """
    work = Work(edges.sparkSession)
    edges = work.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("up"), F.least("a", "b").alias("down")).distinct())
    mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("up", "down"))).first()
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("down").alias("up"), F.col("up").alias("down")))
        least = both.groupBy("up").agg(F.min("down").alias("least")).select("up", F.least("up", "least").alias("least"))
        star = both.join(least, "up").where("down > up").select(F.col("down").alias("up"), F.col("least").alias("down")).distinct()
        least = star.groupBy("up").agg(F.min("down").alias("least"))
        moved = star.join(least, "up").where("down <> least").select(F.col("down").alias("up"), F.col("least").alias("down"))
        edges = work.cut(moved.unionByName(least.select("up", F.col("least").alias("down"))).distinct(), edges)
        was, mark = mark, edges.agg(F.count("*"), F.bit_xor(F.xxhash64("up", "down"))).first()
        if mark == was:
            break
    under = edges.select(F.col("up").alias("node"), F.col("down").alias("label"))
    return under.unionByName(edges.select(F.col("down").alias("node"), F.col("down").alias("label")).distinct())


def roots(work: Work, pointers: DataFrame) -> DataFrame:
    """``pointers(node, to)``, where a root points to itself, to (node, root): each round replaces a node's target by its target's."""
    here, moved = pointers.select("node", "to"), 1
    while moved:
        on = here.select(F.col("node").alias("to"), F.col("to").alias("next"))
        new = here.join(on, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved"))
        new, moved = work.counted(new, F.col("moved"), here)
        here = new.select("node", "to") if not moved else work.owns(new)
    return work.owns(new).select("node", F.col("to").alias("root"))


def on_the_way(work: Work, pointers: DataFrame, starts: DataFrame) -> DataFrame:
    """The nodes on the ways from ``starts(node)`` to their roots, both included: each round looks twice as far."""
    jump, parts = pointers.select("node", "to"), [work.cut(starts.select("node").distinct())]
    while True:
        seen = reduce(DataFrame.unionByName, parts)
        new = seen.join(jump, "node").select(F.col("to").alias("node")).distinct().join(seen, "node", "left_anti")
        new, n = work.counted(new, F.lit(True))
        if not n:
            return seen
        parts.append(new)
        on = jump.select(F.col("node").alias("to"), F.col("to").alias("next"))
        jump = work.cut(jump.join(on, "to").select("node", F.col("next").alias("to")), jump)
