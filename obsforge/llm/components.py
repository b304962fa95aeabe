"""Connected components of an undirected graph by alternating star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_split, written


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest reachable number of each of n nodes, for the links of one bounded block."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def with_low(pairs: DataFrame) -> DataFrame:
    """(node, root, low): each pair with the least root of its node; minima combine on the map side."""
    return join_split(pairs, pairs.groupBy("node").agg(F.min("root").alias("low")), ["node"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node reachable from node. Nodes that are their own root have no row.

    Each round links every node to the smallest of its neighbours, first from smaller to larger nodes, then the other way;
    rounds grow with the logarithm of the graph's size and are tables in the shared folder.
    """
    now = written(edges.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).where("node != root").distinct())
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")))
    seen = now.agg(mark).first()[0]
    while seen[0]:
        both = now.unionByName(now.select(F.col("root").alias("node"), F.col("node").alias("root")))
        large = with_low(both).where("root > node").select(F.col("root").alias("node"), F.least("low", "node").alias("root")).distinct()
        found = with_low(large)
        small = found.where("root != low").select(F.col("root").alias("node"), F.col("low").alias("root"))
        now = written(small.unionByName(found.select("node", F.col("low").alias("root"))).distinct())
        last, seen = seen, now.agg(mark).first()[0]
        if seen == last:
            break
    return now
