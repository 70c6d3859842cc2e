"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmill.llm.common import scratch, written


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of an edge list and the least node that each reaches within it."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b); root is the least node of the component.

    Each round groups by node with partial minima and joins them back, so that a
    hub's edges are split by Spark's skew join; the number of rounds grows with
    the logarithm of the longest path. Nothing but one row of counts comes to the
    driver. An edge from a node to itself, a null end and repeated edges are allowed and change nothing.
    """
    with scratch(edges.sparkSession):
        links = written(
            edges.where("a is not null and b is not null and a <> b")
            .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
            .distinct()
        )
        before = None
        while True:
            both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            links = written(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
            now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
            if now == before:
                break
            before = now
        found = links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
            links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
        )
        return written(found, keep=True)
