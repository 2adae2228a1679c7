"""Connected components: few edges in one task, more by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, materialise


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b), and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
        if not len(x):
            return nodes, nodes[root]
        #: Roots go under the least root beside them, then every node straight under its root.
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, np.concatenate([root[x], root[y]]), np.concatenate([low, low]))
        while (root[root] != root).any():
            root = root[root]


def in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [(batch["a"].to_numpy(), batch["b"].to_numpy()) for batch in batches if batch.num_rows]
    if found:
        nodes, roots = least_reached(*(np.concatenate(side) for side in zip(*found, strict=True)))
        yield from pa.table({"node": nodes, "root": roots}).to_batches(1 << 16)


def components(edges: DataFrame, few: int = 1 << 20) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node it reaches.

    Up to ``few`` distinct edges, 16 bytes each, are solved by one task: a
    round of stars is two plans and seven shuffles, which cost the driver
    more than so few edges cost a task. More are solved in rounds, with the
    same result. Neither round gathers a node's neighbours: each takes their least by a
    pre-aggregated group and joins it back, so a hub is only a skewed join
    key, which adaptive execution splits. The number of rounds grows with the
    logarithm of the longest path. Self loops and repeated edges are allowed.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    if now.count() <= few:
        found = materialise(now.coalesce(1).mapInArrow(in_one_task, "node long, root long"), "cc-found")
        free(now)
        return found
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        after = materialise(small.select("e.a", "e.b").where("a <> b").distinct(), "cc")
        state = after.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        free(now)
        now = after
        if state == seen:
            break
        seen = state
    #: At the end every edge leads from a node to its root.
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
