"""Connected components of links between 64-bit nodes, on the cluster and within one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, reading


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a long, b long)`` -> ``(node, component)``, component being the smallest node reachable.

    Alternating stars: a round first points every larger neighbour of a node at the smallest node
    near it, then gathers each node's smaller neighbours under the smallest of them. Rounds grow
    with the logarithm of the longest path. Each round is written to the shared folder; the driver
    only learns whether one more is due. Null ends and loops are dropped; no edges give no rows. The
    result reads one table (``reads``); ``edges`` isn't read any more.
    """
    high, low = F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")
    links = materialize(edges.filter("a <> b").select(high, low).distinct(), "links")
    while not stars(links):
        both = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
        # written, so that both sides of the join are plain exchanges, which adaptive execution splits where many links share an end
        nearest = materialize(both.groupBy("high").agg(F.min("low").alias("m")).select(F.col("high").alias("low"), F.least("m", "high").alias("m")), "nearest")
        large = materialize(links.join(nearest, "low").select("high", F.col("m").alias("low")).distinct(), "large")
        smallest = large.groupBy("high").agg(F.min("low").alias("m"))
        side = large.join(smallest, "high").filter("low <> m").select(F.col("low").alias("high"), F.col("m").alias("low"))
        after = materialize(smallest.select("high", F.col("m").alias("low")).unionByName(side).distinct(), "links")
        discard(links, nearest, large)
        links = after
    roots = links.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return reading(links.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(roots), links)


def stars(links: DataFrame) -> bool:
    """Whether every node is the higher end of one link at most, and then the lower end of none."""
    ends = links.select(F.col("high").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("low").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return nodes.filter("up > 1 OR up > 0 AND down > 0").isEmpty()


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest-index labels of one task's items after the links a-b; ``label`` holds those so far."""
    while len(a):
        la, lb = label[a], label[b]
        if not (apart := la != lb).any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (shorter := label[label]).tobytes() != label.tobytes():
            label = shorter
    return label
