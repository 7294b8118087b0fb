"""Connected components of an edge table: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import materialize


def _are_stars(edges: DataFrame) -> bool:
    """Every node hangs on one other node only, or has others hanging on it, never both."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    counted = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counted.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges ``u, v`` (long) to ``node, label``: the smallest node reachable, for every node that has an edge.

    A round hangs the larger neighbours of each node, then the smaller ones, on
    the smallest of them. Rounds end when the edges are stars; their number
    grows with the logarithm of the longest path. Each round is written to the
    shared folder.
    """
    a, b = F.greatest("u", "v"), F.least("u", "v")
    current = materialize(edges.where("u <> v").select(a.alias("a"), b.alias("b")).distinct(), "edges")
    while not _are_stars(current):
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            current.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        current = materialize(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
