"""Connected components by alternating large and small stars, on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termgap.llm.common import keep


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in `links` (u, v); component is the smallest node reachable.

    A large star ties the larger neighbours of a node to its smallest one, a small star the others; both keep every
    component whole and end as stars around its smallest node. Only minima and single links are shuffled, never a list of
    neighbours, so a node with a third of all links is a skewed join that can be split. Every half round is a written
    table; the driver sees three numbers of it.
    """
    both = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = keep(both, "links")
    before = _state(edges)
    while before[0]:
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m"))
        large = around.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = keep(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = keep(small.select("e.*").filter("u <> v").distinct(), "small-star")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
