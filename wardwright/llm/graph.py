"""Connected components as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwright.session import settle


def _nearest(pairs: DataFrame) -> DataFrame:
    """The smallest neighbour of each node, itself included; settled, so that a hot node's join can be split."""
    return settle(pairs.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("low")), "star-lows")


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the node's smallest neighbour."""
    pairs = edges.select(F.col("node"), F.col("other")).union(edges.select(F.col("other"), F.col("node")))
    return (pairs.join(_nearest(pairs), "node").where("other > node")
            .select(F.col("other").alias("node"), F.col("low").alias("other")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    lows = _nearest(edges)
    moved = edges.join(lows, "node").where("other <> low").select(F.col("other").alias("node"), F.col("low").alias("other"))
    return moved.union(lows.select("node", F.col("low").alias("other"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (two long columns) that reaches a smaller one; root is the smallest it reaches.

    Alternates two star operations, whose edges stay as many as the links and whose paths
    shorten by half or more each round. Every round is settled in the shared folder; only a
    count and a checksum reach the driver. Self-links and nulls are ignored.
    """
    a, b = links.columns
    edges = settle(links.where(f"`{a}` <> `{b}`").select(
        F.greatest(a, b).alias("node"), F.least(a, b).alias("other")).distinct(), "star-edges")
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("node", "other").cast("decimal(20,0)"))).first()
        if mark == before or not mark[0]:
            return edges.select("node", F.col("other").alias("root"))
        before = mark
        edges = settle(_small_star(_large_star(edges)), "star-edges")
