"""Connected components by alternating stars, for edge tables of any size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.plans.tables import discard, materialize


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("b", "a"))
    least = both.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.col("c")).alias("m"))
    return both.join(least, both["a"] == least["c"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m"))
    inner = e.join(least, e["a"] == least["c"]).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return inner.union(least.select("c", "m"))


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of longs or strings: (node, label) for every node of an edge; label is the
    least node of its component. Each round is written to the shared folder, so a lost executor
    costs that round's work at most. Rounds grow with the logarithm of the nodes."""
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).first())

    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    seen = state(now)
    while seen[0]:
        after = materialize(_small_star(_large_star(now).distinct()).distinct(), "edges", seen[0])  # rounds keep the number of edges or lower it
        discard(now)
        was, seen, now = seen, state(after), after
        if was == seen:
            break
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots.select("node", F.col("node").alias("label")))


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component, for nodes 0 to n-1 that fit in memory."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        shorter = label[label]
        if np.array_equal(label[a], label[b]) and np.array_equal(shorter, label):
            return label
        label = shorter
