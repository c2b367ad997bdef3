"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.scratch import discard, stored


#: Tasks that share the neighbours of one node.
SALTS = 16


def _with_least(edges: DataFrame) -> DataFrame:
    """edges with m, the smallest neighbour b of their node a.

    The neighbours of a node are dealt to SALTS tasks by hash; these meet in one row each, and the least goes back to them, so no
    task holds all neighbours of a node.
    """
    dealt = edges.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    places = dealt.groupBy("a", "s").agg(F.min("b").alias("m"))
    least = places.groupBy("a").agg(F.min("m").alias("m"))
    return dealt.join(places.select("a", "s").join(least, "a"), ["a", "s"]).drop("s")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is tied to the smallest node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    tied = _with_least(both).where("b > a")
    return tied.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours (edges run from larger to smaller) are tied to the smallest of them."""
    tied = _with_least(edges)
    nodes = F.when(F.col("b") != F.col("m"), F.array("a", "b")).otherwise(F.array("a"))
    return tied.select(F.explode(nodes).alias("a"), F.col("m").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of edges (a, b) that has a link to another.

    Only edges move between tasks; a round ends in a table in the shared folder. The number of rounds grows with the
    logarithm of the longest path. Loops and repeated edges are allowed; an empty table gives an empty result.
    """
    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = None
    while True:
        n, total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not n or (n, total) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = n, total
        after = stored(_small_star(_large_star(now)), "edges")
        discard(now)
        now = after


def linked_groups(pairs: DataFrame) -> DataFrame:
    """node and component of the groups that items connect, of pairs (a: group, b: item); groups that share no item with another are left out.

    Only items of several groups link anything, so rows whose items are their own never enter the rounds.
    """
    ends = pairs.groupBy("b").agg(F.min("a").alias("_least"), F.max("a").alias("_most")).where("_least <> _most").select("b", "_least")
    return connected_components(pairs.join(ends, "b").select("a", F.col("_least").alias("b")))
