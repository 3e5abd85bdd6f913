"""Connected components of links between keys, by rounds of large and small stars; no node's links meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.session import stage


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _lowest(links: DataFrame) -> DataFrame:
    """(a, low): the lowest neighbour of each node; folded before the shuffle, so a node with many links is one row a task."""
    return links.groupBy("a").agg(F.min("b").alias("low"))


def _round(links: DataFrame) -> DataFrame:
    """Links point from a higher to a lower node. Each neighbour is linked to the lowest node around it instead."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = _lowest(both).select("a", F.least("a", "low").alias("low"))
    large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    pairs = F.array(F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))
    return large.join(_lowest(large), "a").select(F.explode(pairs).alias("p")).select("p.a", "p.b").where("a <> b").distinct()


def components(links: DataFrame, folder: str) -> DataFrame:
    """(a, b): every node that has a lower node in its component, and the component's lowest node.

    `links` has columns a and b of one orderable type; nulls and links of a node to itself are left out. Each round is
    written to `folder`, so a lost executor costs one round at most.
    """
    links = links.where("a is not null and b is not null and a <> b")
    links = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folder, "links")
    seen = _fingerprint(links)
    while seen[0]:
        links = stage(_round(links), folder, "links")
        now = _fingerprint(links)
        if now == seen:
            break
        seen = now
    return links
