"""Connected components of a link table, by alternating large-star and small-star contraction (Kiveris et al., 2014).

A table of few links is contracted by one task instead, with the same result: each of the rounds costs more than that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


#: Links that one task contracts, 16 bytes each.
FEW = 1 << 20


def _contracted(batches):
    """(node, root) of links (a, b), all of them."""
    held = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    a, b = np.concatenate(held, axis=1) if held else np.zeros((2, 0), np.int64)
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:  # hooking to the smaller root and halving of paths
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for end in (x, y):
            np.minimum.at(new, end, low)
            np.minimum.at(new, root[end], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def _mark(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """links(a, b): long, undirected, repeats and self-links allowed -> (node, root), root the smallest node reachable.

    Nodes without a link to another node are not in the result; a link with a null end links nothing. An empty table
    gives an empty result. Each round moves only minima and links, both aggregated before the shuffle; a node with very
    many links is a skewed join key, never a list. Rounds grow with the logarithm of the longest chain; each is written
    to the shared folder. Up to FEW links are one task's work.
    """
    first = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(first, "links")
    mark = _mark(edges)
    if mark[0] <= FEW:
        return edges.coalesce(1).mapInArrow(_contracted, "node long, root long")
    while mark[0]:
        both = edges.select("a", "b").union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after = stored(small, "links")
        again = _mark(after)
        dropped(edges)
        edges = after
        if again == mark:
            break
        mark = again
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b")).distinct()
