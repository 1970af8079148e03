"""Connected components of a graph that lies in a table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import salted_join, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or the smaller) neighbours of every node on the least of its neighbourhood.

    Sums and minima combine before the shuffle, and a node with very many neighbours is joined salted.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    hung = salted_join(both, least, ["a"], F.col("b"), "inner")
    if large:  # what occurs twice is told apart by the step that follows, so that rows move once less
        return hung.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(hung.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _open(edges: DataFrame) -> bool:
    """Whether a node has two edges downwards, or one downwards and one upwards; if none has, every component is a star around its least node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or down > 0 and up > 0").agg(F.count("*")).first()[0] > 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b), two longs: root is the least node reachable.

    Edges are written to the shared folder after each round; the rounds end when all components are stars, which takes
    about the logarithm of the longest path.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while _open(now):
        now = written(_star(_star(now, True), False), "edges")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
