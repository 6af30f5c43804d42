"""Connected components of a graph given as a table of edges, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def _with_least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with the smallest of a node and its neighbours. These are stored, as Spark can't split a join with an
    aggregate on one side of it, and a node may have very many edges. Also the table that they are stored in."""
    least = stored(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return edges.join(least, "a"), least


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node reachable.

    Large star: each node links its larger neighbours to its smallest one. Small star: it links its smaller neighbours
    and itself to the smallest one. Both keep the components, and the edges end as stars around the roots, after about
    the logarithm of the longest path. Each round is a stored table, and those of the round before go; nothing but two sums reaches the driver. A node
    with very many edges is met in equi-joins only, which Spark can split. Self-loops and repeated edges are harmless;
    an empty table gives an empty one.
    """
    now, seen = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"), None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large, first = _with_least(both)
        large = large.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large.filter("a <> b"), "large")
        small, second = _with_least(large)
        before = now
        now = stored(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "edges")
        dropped(before, first, large, second)
        found = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if found == seen:
            break
        seen = found
    else:
        raise RuntimeError("components: not settled")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
