"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of the edges a - b, by min labels and pointer jumping."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if (new == root).all():
            return nodes, nodes[root]
        root = new


#: Edges (16 bytes each) that one task may settle by itself.
LOCAL = 1 << 20


def components(edges: DataFrame) -> DataFrame:
    """(node, root), stored: every node of the edges (a, b), root being its component's smallest node.

    More than LOCAL edges go through half rounds of an aggregation and a join by node each; a hub's rows stay rows, so a
    skewed join can split them. Every half round is written to the shared folder and takes the place of the one before.
    The rounds end when the edges are stars, or are few enough for one task, whose memory LOCAL bounds.
    """
    big, small = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = stored(edges.where("a != b").select(big, small).distinct(), "edges")
    last = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == last or now[0] <= LOCAL:
            break
        last = now
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "lows")
        large = stored(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        discard(edges, low)
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "lows")
        hung = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(hung.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(large, low)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in b.columns] for b in batches]
        if held:
            node, root = local_roots(*(np.concatenate(c) for c in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])

    if now[0] <= LOCAL:
        found = edges.coalesce(1).mapInArrow(settle, "node long, root long")
    else:
        stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        found = stars.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    out = stored(found, "components")
    discard(edges)
    return out
