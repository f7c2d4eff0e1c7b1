"""Distributed union-find on a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import cut

MOST_ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (smallest node reachable) of every node that has a link.

    Alternates two steps until nothing changes, each a grouped minimum and one join on the node: every node's larger
    neighbours, then every node's smaller ones, are hung on its smallest neighbour. Neighbour lists are never collected,
    so a hub is only as heavy as its links, which partial minima and adaptive skew splitting spread. Links with a null end
    and links of a node with itself are left out. Each round is checkpointed, so its lineage is short and survives lost
    executors.
    """
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # larger neighbours of each node go to its smallest neighbour
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # each node's smaller neighbours, and itself, go to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        edges = cut(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u != v").distinct())
        # a sum of hashes tells whether the set of links changed
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no end after {MOST_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def local_components(n: int, pairs: np.ndarray) -> np.ndarray:
    """Smallest row reachable, by pointer jumping on minima."""
    root = np.arange(n)
    while pairs.shape[1]:
        low = root.copy()
        np.minimum.at(low, pairs[0], root[pairs[1]])
        np.minimum.at(low, pairs[1], root[pairs[0]])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return root
