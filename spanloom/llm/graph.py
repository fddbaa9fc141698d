"""Connected components: within a block in numpy, and across the cluster with star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import cut, joined_by_count


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node that each of ``n`` nodes reaches over the undirected edges (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        left = root[a] != root[b]
        a, b = a[left], b[left]
    return root


def components(edges: DataFrame, in_task: int = 1_000_000) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``: root is the smallest node reached.

    Up to ``in_task`` distinct edges (16 MB) are contracted in one task. Beyond that,
    large-star and small-star contraction alternate until every edge points at a root.
    Minima are aggregated before they meet the edges again, those of hubs by a broadcast of
    bounded size, so no task gathers the neighbours of a hub, and each round is cut off in
    the checkpoint folder. Only two numbers a round reach the driver. Null nodes take no
    part; loops are ignored.
    """
    pairs = edges.where("a is not null and b is not null and a <> b")
    now = cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n = now.count()
    if n <= in_task:
        return now.coalesce(1).mapInArrow(_contract, "node long, root long")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = joined_by_count(both, least, "a", "n", 2 * n).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.unionByName(least.where("m <> a").select("a", F.col("m").alias("b"))).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = joined_by_count(large, low, "a", "n", large.count()).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        after = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before, n = after, after[0]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of all edges of one task."""
    held = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
    if not held:
        return
    a, b = (np.concatenate(x) for x in zip(*held))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = nodes[local_components(len(nodes), at[: len(a)], at[len(a) :])]
    step = 1 << 16
    for k in range(0, len(nodes), step):
        yield pa.RecordBatch.from_pydict({"node": nodes[k : k + step], "root": root[k : k + step]})
