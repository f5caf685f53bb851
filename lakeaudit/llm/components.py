"""Connected components of links between numbered nodes, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.llm.spark import cut


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). node and label, the smallest node of its component, for each node that has a link.

    A step joins each link with the smallest neighbour of one end, so no neighbourhood is ever collected, and a hub's
    links stay spread. Steps end when the links no longer change; the number of steps grows with the logarithm of the
    nodes.
    """
    edges = cut(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = None
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        # Large star: each node's larger neighbours go to its smallest one.
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.where(F.col("hi") != F.col("lo")).distinct()
        # Small star: each node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("lo").alias("u"), "m").unionByName(least.select(F.col("hi").alias("u"), "m"))
        edges = cut(small.where(F.col("u") != F.col("m")).select(F.col("u").alias("hi"), F.col("m").alias("lo")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.hash("hi", "lo").cast("long"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())
