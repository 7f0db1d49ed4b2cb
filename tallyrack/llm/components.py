"""Connected components of links, on Spark throughout.

Rounds of large-star and small-star: every node tells its neighbours of its smallest one, until
each component is a star around its smallest node.  Each round's links are written to the shared
folder, so the plan stays short and lost executors cost a round at most.  The number of rounds
is logarithmic in the size of a component, in practice a handful.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node that has a link; root is the component's smallest node."""
    above = lambda x, y: (F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    edges = materialise(links.where(F.col(a) != F.col(b)).select(*above(F.col(a), F.col(b))).distinct(), "links", light=True)
    while not _is_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # plain scans on both sides of a join, so that a node of many links can be split
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", light=True)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large-star", light=True)
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least", light=True)
        small = large.join(least, "u").where("v <> m").select(*above(F.col("v"), F.col("m")))
        edges = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star", light=True)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return materialise(roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components", light=True)


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node but the roots has one link, to a root: then nothing is left to do."""
    twice = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    inner = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
    return twice.unionByName(inner).isEmpty()
