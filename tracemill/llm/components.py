"""Connected components over link tables, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component): the smallest node reachable from each node of a link.

    Nodes are longs; links with a null end and self links are dropped, and nodes
    without a link aren't returned. Every round replaces the links by stars that
    point at smaller nodes and writes them to a checkpoint; the number of rounds
    grows with the logarithm of the longest chain. An empty table gives an empty one.
    """
    now = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where(F.col("u") != F.col("v"))
    now = checkpointed(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state
        now = checkpointed(_small_star(_large_star(now)).distinct())


def joined(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least place of each place's component, once components with the least places ``root`` are joined along (p, q).

    Only least places are lowered, and all places follow theirs, so links of earlier calls stay.
    """
    while (root[p] != root[q]).any():
        x, y = root[p], root[q]
        root = root.copy()
        np.minimum.at(root, x, y)
        np.minimum.at(root, y, x)
        while ((up := root[root]) != root).any():
            root = up
    return root
