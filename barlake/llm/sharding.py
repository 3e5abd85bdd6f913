"""Shards chosen by descending a weighted tree of regions, racks and shards, one hash draw for each child."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from barlake.llm.columns import whole
from barlake.session import stage


@dataclass(frozen=True)
class Node:
    """A shard (with a number), or a group of nodes that weighs as much as its children together."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def tree_of(shards: int, built: int = 8, per_rack: int = 2, racks: int = 2) -> Node:
    """The tree for a number of shards: `built` of them in racks and regions, each later one in a region of its own.

    A new region leaves all other weights as they were, so from `built` shards on a later one takes rows only into itself.
    Up to `built`, a new shard makes its rack and region heavier as well, which take rows into their other shards too.
    """
    if shards < 1:
        raise ValueError("a tree needs a shard")
    regions = []
    for region in range(0, min(shards, built), per_rack * racks):
        own = [
            Node(f"rack{rack}", tuple(Node(f"shard{s}", shard=s) for s in range(rack, min(rack + per_rack, shards, built))))
            for rack in range(region, min(region + per_rack * racks, shards, built), per_rack)
        ]
        regions.append(Node(f"region{region}", tuple(own)))
    later = [Node(f"region{s}", (Node(f"rack{s}", (Node(f"shard{s}", shard=s),)),)) for s in range(built, shards)]
    return Node("root", (*regions, *later))


def draw(key: Column, node: Node, path: str) -> Column:
    """An exponential draw of this key for this node at the rate of its weight; the smallest of a group wins."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(f"{path}/{node.name}"), key), 11)
    return -F.log((bits.cast("double") + 0.5) / F.lit(2.0**53)) / F.lit(float(node.weight))


def descend(key: Column, node: Node, path: str = "") -> Column:
    """The shard number that a key reaches below `node`; only the groups on its way are drawn.

    A child whose weight grows only takes keys from its siblings, one whose weight shrinks only gives keys away, so a
    change moves keys into or out of the subtrees whose weights change and leaves the rest where they are. Children of
    weight 0 get none.
    """
    if node.shard is not None:
        return F.lit(node.shard)
    path = f"{path}/{node.name}"
    children = [c for c in node.children if c.weight > 0]
    if not children:
        raise ValueError(f"{path} has no weight")
    if len(children) == 1:
        return descend(key, children[0], path)
    draws = [F.struct(draw(key, c, path).alias("draw"), F.lit(k).alias("child")) for k, c in enumerate(children)]
    chosen = F.least(*draws)["child"]
    reached = F.when(F.lit(False), F.lit(0))
    for k, child in enumerate(children):
        reached = reached.when(chosen == k, descend(key, child, path))
    return reached


def shard_rows(docs: DataFrame, tree: Node, grown: Node, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The shard depends on doc_id and the tree alone, so equal ids (repeated rows, null ids) share a shard. `size` is the
    number of UTF-8 bytes plus 1, a null text has none. `slot` counts a shard's rows from 0 without gaps, by a hash of
    the id, size and checksum, then by these; rows that agree in all of them are alike. Slots are numbered in pieces of a
    shard: there are about as many pieces as rows in a piece, so neither the list of pieces nor a piece grows with
    the whole. `folder` takes the narrow rows, which are read twice.
    """
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    body = whole(text)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        descend(key, tree).alias("shard"),
        descend(key, grown).alias("grown_shard"),
    ).withColumn("place", F.xxhash64(F.lit("slot"), key, "size", "text_crc32"))
    rows = stage(rows, folder, "shards")
    pieces = max(1, math.isqrt(rows.count()) // 4)
    piece = F.pmod("place", F.lit(pieces)).cast("int")
    rows = rows.withColumn("piece", piece)
    sizes = rows.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "piece").orderBy("place", "doc_id", "size", "text_crc32")
    return (
        rows.withColumn("rank", F.row_number().over(within) - 1)
        .join(offsets, ["shard", "piece"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("offset") + F.col("rank")).cast("long").alias("slot"),
            "grown_shard",
        )
    )
