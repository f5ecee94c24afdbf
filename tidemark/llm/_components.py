"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import stage, unstage


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): every node that has a link, with the smallest node of its component.

    Links stay distributed: each round is two aggregations with map-side combining
    and two joins, written to the shared folder; the driver sees one number a
    round. The number of rounds grows with the logarithm of the nodes.
    """
    edges = stage(_oriented(links.select("a", "b")), "links")
    while _unsettled(edges):
        moved = stage(_small_star(_large_star(edges)), "links")
        unstage(edges)
        edges = moved
    # now every edge joins a node to its root
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _unsettled(edges: DataFrame) -> int:
    """Nodes that hang on two others, or on one while others hang on them; without any, all edges lead to smallest nodes."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    return ends.groupBy("node").agg((F.sum("below") + F.max("above")).alias("n")).agg(F.count_if(F.col("n") > 1)).first()[0]


def _oriented(edges: DataFrame) -> DataFrame:
    """Each link once, from its larger to its smaller end."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Join each node's larger neighbours to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), F.least("a", "m").alias("m"))
    # written, so that the join deals both sides anew and the neighbours of a hub can be split
    least = stage(least, "least-neighbours")
    return _oriented(both.filter("b > a").join(least, F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Join each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), "m")
    moved = edges.join(least, F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _oriented(moved.unionByName(least.select(F.col("_a").alias("a"), F.col("m").alias("b"))))
