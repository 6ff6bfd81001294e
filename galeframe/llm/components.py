"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import saved, scratch


def _mirrored(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _towards_smallest(pairs: DataFrame) -> DataFrame:
    """(a, b, low): every pair with the smallest of a and all partners of a."""
    low = pairs.groupBy("a").agg(F.min("b").alias("low"))
    return pairs.join(low, "a").withColumn("low", F.least("a", "low"))


def _round(links: DataFrame) -> DataFrame:
    """Each node's larger partners, then its smaller ones and itself, are linked to the smallest node around it."""
    around = _towards_smallest(_mirrored(links))
    large = around.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")
    small = _towards_smallest(large.filter("b < a"))
    moved = small.select(F.col("b").alias("a"), F.col("low").alias("b"))
    own = small.select("a", F.col("low").alias("b"))
    return moved.unionByName(own).filter("a <> b").distinct()


def _chained(links: DataFrame) -> DataFrame:
    """The nodes by which links (a, b) are no stars: with several smaller partners, or with one and a larger one too."""
    ends = F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("down")))
    nodes = links.select(F.inline(ends)).groupBy("node").agg(F.sum("down").alias("downs"), F.min("down").alias("least"))
    return nodes.filter("downs > 1 OR (downs = 1 AND least = 0)")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in the links (a, b); root is the smallest node of its component.

    Rounds go on until the links are stars; there are about as many as the logarithm of the longest chain.
    """
    with scratch() as keep:
        links = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        while not _chained(links).isEmpty():
            links = saved(_round(links), "links")
        keep(links)
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
