"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limner.plans.staging import stage


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(u, v)``; the component is its smallest node."""
    edges = stars(links)
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("v", F.col("v")))


def stars(links: DataFrame) -> DataFrame:
    """``(u, v)`` for every node ``u`` of ``links(u, v)`` that is not the smallest node ``v`` of its component.

    Each round hangs every neighbour on the smallest one (first larger, then smaller
    neighbours), which keeps the number of links and halves long chains. Every round is
    a written table. The rounds end when each node hangs on one root. To add links to
    stars that were found before, give the union of both.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    edges = stage(edges, "links")
    while not _is_star(edges):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # one row for each edge: its larger end and the least of the smaller one
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
    return edges


def _is_star(edges: DataFrame) -> bool:
    """Whether no node hangs on two others, or on one and has others hang on it; in one pass."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty()
