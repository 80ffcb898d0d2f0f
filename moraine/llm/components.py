"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations and two joins on the edge table; no group is
collected, so a component may hold any share of the nodes. Rounds are written to
the shared folder, each in place of the last, and only two scalars a round reach
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.common import discard, materialize


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count("*").alias("n"),
        F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x"),
    ).first()
    return row.n, row.x


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(node, component)``, component being the least node.

    Nodes without an edge to another node are absent; self-loops and nulls are
    ignored and repeated edges count once. An empty input gives an empty result.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(spark, edges, "edges")
    seen = _fingerprint(edges)
    while seen[0]:
        last, edges = edges, materialize(spark, _small_star(_large_star(edges)), "edges")
        discard(spark, last)
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = materialize(spark, nodes.unionByName(roots), "components")
    discard(spark, edges)
    return out
