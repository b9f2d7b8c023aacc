"""Connected components of a large graph by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

MAX_ROUNDS = 60


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the same components as the edges (a, b): (node, smallest node)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        # roots take the smaller label too, so long chains shrink fast
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v) with u > v; the result has the same form."""
    pairs = edges
    if large:
        pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written before the join, so that both sides come straight from a shuffle and Spark can split a hub
    low = materialise(pairs.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m")), "least")
    rows = pairs.join(low, "u")
    if large:
        out = rows.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        # the node itself is tied to m by the row of its smallest neighbour
        out = rows.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b: longs); root is the smallest node.

    Loops and repeated edges change nothing; nodes without an edge are not in the result.
    Each round is written to the shared folder, so a lost executor repeats one round at most.
    """
    now = materialise(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = None
    for step in range(MAX_ROUNDS):
        state = now.agg(mark.alias("s")).first().s
        if state == before:
            break
        before = state
        now = materialise(_stars(_stars(now, True), False), f"stars-{step}")
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
