"""Connected components of an undirected graph by alternating large-star and small-star steps.

Every step hangs nodes onto the smallest neighbour that it sees; the number of edges never grows and a star is a fixed
point. All work is partial aggregation by node and a join of edges with one row per node, so a hub with a third of all
edges is summed before the shuffle and its side of the join can be split by adaptive execution.

The steps run while there are more than FEW edges. So many fit into one task's memory, which then finishes; the result
is the same at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


#: Edges that one task may hold: 16 bytes each for numbered nodes.
FEW = 500_000


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node that each can reach, by hooking and pointer jumping over arrays."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        for end in (a, b):
            np.minimum.at(root, root[end], low)
            np.minimum.at(root, end, low)
        while (root[root] != root).any():
            root = root[root]
        if (before == root).all():
            return nodes, nodes[root]


def _finish(edges: DataFrame) -> DataFrame:
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)  # FEW rows at most
        if parts:
            rows = pd.concat(parts)
            nodes, of = roots(rows["u"].to_numpy(), rows["v"].to_numpy())
            yield pd.DataFrame({"node": nodes, "root": of})

    return edges.coalesce(1).mapInPandas(run, f"node {kind}, root {kind}")


def _lowest(edges: DataFrame) -> DataFrame:
    """u, m: the smallest of u and its neighbours v."""
    return staged(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60, few: int = FEW) -> DataFrame:
    """node, root for every node of edges (u, v); root is the smallest node that it can reach.

    Null ends and self loops bind nothing, repeated edges count once; an empty table gives an empty result. Nodes may
    be numbers or strings. Raises if the rounds, of which a few are usual, do not end.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = staged(e, "edges")
    before = _print(e)
    for _ in range(max_rounds):
        if before[0] <= few:
            return _finish(e)
        both = staged(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        low = _lowest(both)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # u itself hangs onto m too; without this a chain would come apart.
        large = staged(large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).distinct(), "large")
        low = _lowest(large)  # every edge points down here: u > v
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = staged(small.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _print(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    # Settled: every edge leads from a node to its root.
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
