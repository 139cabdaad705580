"""Decisions that hang on one another, settled by doubling pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwright.session import settle

HOPS = 2  # doublings per job


def _doubled(chain: DataFrame, key: str) -> DataFrame:
    """Every pointer goes on to where its target points; a decided target decides."""
    target = chain.select(F.col(key).alias("ahead"), F.col("known").alias("_known"), F.col("ahead").alias("_next"), F.col("flips").alias("_flips"))
    decided = F.coalesce("known", F.col("_known") != F.col("flips"))
    return chain.join(target, "ahead", "left").select(
        key, decided.alias("known"), F.when(decided.isNull(), F.coalesce("_next", "ahead")).alias("ahead"),
        F.when(F.col("_next").isNull(), F.col("flips")).otherwise(F.col("flips") != F.col("_flips")).alias("flips"),
        (decided.isNull() & F.col("_next").isNotNull()).alias("live"))


def settle_negations(nodes: DataFrame, key: str) -> DataFrame:
    """(key, known) for `nodes` (key, known, ahead): `known` as it stands, or else the opposite of the node `ahead`,
    or NULL where that leads to a node with neither.

    Pointers carry the parity of the steps they stand for, and double with each join, so a chain of n nodes takes
    log n joins, two in a job. `ahead` must lead to other nodes of the table without cycles.
    """
    chain = settle(nodes.select(key, "known", F.when(F.col("known").isNull(), F.col("ahead")).alias("ahead"), F.lit(True).alias("flips"),
                                (F.col("known").isNull() & F.col("ahead").isNotNull()).alias("live")), "chains")
    while not chain.where("live").isEmpty():
        for _ in range(HOPS):
            chain = _doubled(chain, key)
        chain = settle(chain, "chains")
    return chain.select(key, "known")
