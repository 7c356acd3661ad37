"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanmill.llm.common import Scratch, written


def _meet(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with the minimum of their node u. The minima's key is computed, so that both sides are dealt for this join alone
    and Spark may split the node that a third of all edges hang on."""
    return edges.join(least.withColumn("u", F.col("u").bitwiseXOR(F.lit(0).cast("long"))), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Hangs every larger neighbour of a node on the least node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return _meet(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hangs every smaller neighbour of a node, and the node, on the least of them. Edges come as (larger, smaller)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = _meet(edges, least).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes in `edges` (a, b: long); the component is its least node.

    Self-loops and repeated edges do no harm, null ends are dropped, no edges give no rows. Each round contracts
    stars twice by joins on counted minima, so no neighbour list is ever gathered; the edges of each round are
    written to the shared folder, and the rounds end when the edges stay the same. Only the result stays there."""
    with Scratch(edges.sparkSession) as keep:
        now = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        mark = None
        while True:
            now = keep(_small_star(_large_star(now)).distinct())
            seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if seen == mark:
                break
            mark = seen
        heads = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        return written(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads))
