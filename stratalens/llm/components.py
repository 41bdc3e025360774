"""Connected components by alternating large-star and small-star rounds over locally contracted edges.

Each task replaces its edges by one star for each of their components, which keeps what hangs together. What tasks know
apart is joined by a round of stars, and the rounds end as soon as the edges are stars over the whole table. A round costs
the driver several jobs with a task for each partition of each shuffle, whatever the number of edges, so few rounds count
more than little work in each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILES_A_CORE, discard, trim, written

#: Edges that a task contracts at once, with the stars of those before.
AT_ONCE = 1 << 20


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges but the smallest of its component, and that one."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    inner = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[inner], nodes[root[inner]]


def _contracted(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) as stars (u, v), v the smallest node, of what hangs together within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, held = [], 0, 0
        for batch in batches:
            parts.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
            size += len(batch)
            if size >= held + AT_ONCE:
                parts = [_stars(*map(np.concatenate, zip(*parts)))]
                size = held = len(parts[0][0])
        if size:
            u, v = _stars(*map(np.concatenate, zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
        trim()

    few = FILES_A_CORE * edges.sparkSession.sparkContext.defaultParallelism
    return edges.select("u", "v").filter("u <> v").distinct().coalesce(few).mapInArrow(run, "u long, v long")  # the shuffle spreads a root's edges


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v") if not large else edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:  # each edge once, from its larger end
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v")


def _settled(edges: DataFrame) -> bool:
    """Whether the edges, each from its larger end, are stars: no node has two roots, and no root has one."""
    ends = edges.select(F.col("u").alias("node"), "v").union(edges.select("v", F.lit(None).cast("long")))
    seen = ends.groupBy("node").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max(F.col("v").isNull()).alias("root"))
    return seen.filter("low <> high or root and low is not null").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v longs) to (node, root): root is the smallest node of the component.

    Nodes without an edge are not returned. Each round is a written table, so a lost executor costs one
    round; their number grows with the logarithm of the number of nodes at most. Null ends are ignored.
    """
    now = written(_contracted(edges), "edges")
    while not _settled(now):  # a table is deleted as the next one is written
        before = now
        now = written(_contracted(_star(_star(before, True), False)), "star")
        discard(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
