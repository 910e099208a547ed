"""Connected components: within a task over numpy arrays, and over a DataFrame of links in rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage

MAX_ROUNDS = 60


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for every node that is not its own root."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while True:
            short = label[label]
            if np.array_equal(short, label):
                break
            label = short
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
        if np.array_equal(before, label):
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node but the roots, from links (a, b) of longs; root is the smallest node.

    Alternates two star steps until nothing changes: a node's larger neighbours
    join its smallest neighbour, then its smaller ones do.  Each step is an
    aggregation (combined before the shuffle) and a join; each round is staged.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hooked = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stage(hooked.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        unstage(large)
        size = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if size(after) == size(edges):
            unstage(edges)
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        unstage(edges)
        edges = after
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
