"""Connected components of a distributed graph by alternating large and small stars; a small graph's in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Edges (16 bytes each) up to which a graph is solved in one task.
FEW = 1 << 20


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges u, v and the smallest node of each one's component: roots are hooked to smaller ones, then all paths cut short."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[label]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label = label[label]


def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges (u, v) of the task."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if got:
        node, root = least_reached(*map(np.concatenate, zip(*got, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, root) of edges (u, v) of longs: each node that has an edge, with the smallest node of its component.

    A star moves a node's larger neighbours to its smallest; the number of rounds grows with the logarithm of the longest
    path, and the last one changes nothing. Each step joins edges with one row for each node, so a node of many edges is split by the join, never collected.
    Up to `few` distinct edges go to one task instead, which gives the same rows: rounds over a small graph are thousands of tasks
    that have next to nothing to do. No edges: no rows.
    """
    edges = checkpoint(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = _fingerprint(edges)
    if last[0] <= few:
        return edges.coalesce(1).mapInArrow(solved, "node long, root long")
    while last[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = checkpoint(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = checkpoint(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = _fingerprint(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
