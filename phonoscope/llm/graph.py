"""Connected components of an undirected graph by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonoscope.llm.common import materialize, release, small


#: A graph of so many edges at most (16 bytes each) is worked out in one task.
TOGETHER = 1 << 19


def _in_one_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [b[["u", "v"]].to_numpy(dtype=np.int64) for b in batches]
    nodes, ends = np.unique(np.concatenate([p.ravel() for p in parts] or [np.zeros(0, np.int64)]), return_inverse=True)
    parent = list(range(len(nodes)))

    def top(n: int) -> int:
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in ends.reshape(-1, 2).tolist():
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    yield pd.DataFrame({"node": nodes, "root": nodes[[top(n) for n in range(len(nodes))]] if len(nodes) else nodes})


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of the edges (long columns u and v) the smallest node that can be reached.

    Loops and repeated edges change nothing; without edges the result is empty.  Each step hangs the neighbours of
    a node onto the smallest of them, so the number of rounds grows with the logarithm of the longest path.
    A small graph, by its counted edges, takes one task instead.
    A node with very many neighbours is a hot join key, but the other side is a written table with one
    row per node, which is broadcast while small and beyond that lets the adaptive join split the key.
    """
    lower, upper = F.least("u", "v"), F.greatest("u", "v")
    edges = materialize(edges.where("u <> v").select(upper.alias("u"), lower.alias("v")).distinct())
    if edges.count() <= TOGETHER:
        return edges.repartition(1).mapInPandas(_in_one_task, "node long, root long")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = materialize(both.where("v > u").join(small(least, 16), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        release(edges, least)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        hung = large.join(small(least, 16), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        release(large, least)
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
