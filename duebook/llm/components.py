"""Connected components of a graph given by its links.

Alternating large-star and small-star steps: every step is an aggregation and a join on the node,
so no component is ever gathered in one task, and the number of links doesn't grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.session import write_and_read


def _low(links: DataFrame) -> DataFrame:
    """The smallest of each node and its neighbours; read back, so that the join can split a node with many."""
    return write_and_read(links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low")), "lowest")


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        both.join(_low(both), "u")
        .where("v > u")
        .select(F.col("v").alias("u"), F.col("low").alias("v"))
        .where("u <> v")
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, is linked to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _low(down)
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(low.select("u", F.col("low").alias("v"))).where("u <> v").distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def connected_components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node`` and ``component``, the smallest node it can reach, for every node with a link to another.

    Links with a null or to the node itself are left out; repeated links change nothing. Each
    round is written to the shared folder, so a lost executor costs one round at most. The number
    of rounds grows with the logarithm of the longest chain.
    """
    links = (
        links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"), F.col(u).isNotNull() & F.col(v).isNotNull())
        .toDF("u", "v", "whole")
        .where("whole AND u <> v")
        .drop("whole")
        .distinct()
    )
    links = write_and_read(links, "links")
    before = _state(links)
    while before[0]:
        links = write_and_read(_small_star(_large_star(links)), "links")
        after = _state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
