"""Connected components by alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandstream.llm.common import stored

#: Edges that a task turns into stars at once; bounds its memory, not the result.
EDGES_AT_ONCE = 500_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node but the least with the least one that these edges join it to."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = np.split(ends, 2)
    root = np.arange(len(nodes))
    while (apart := root[a] != root[b]).any():
        x, y = root[a[apart]], root[b[apart]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    leaves = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[leaves], nodes[root[leaves]]


def _local_stars(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components: each task replaces those it has by stars."""

    def packed(waiting):
        u, v = (np.concatenate(side) for side in zip(*waiting))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in stars(u, v)], ["u", "v"])

    def run(batches):
        waiting, n = [], 0
        for batch in batches:
            waiting.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
            if n >= EDGES_AT_ONCE:
                yield packed(waiting)
                waiting, n = [], 0
        if waiting:
            yield packed(waiting)

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _undone(edges: DataFrame) -> DataFrame:
    """Nodes with two roots, or with a root while they are one."""
    ends = edges.select(F.col("u").alias("node"), "v", F.lit(False).alias("root")).unionByName(
        edges.select(
            F.col("v").alias("node"), F.lit(None).cast("long").alias("v"), F.lit(True).alias("root")
        )
    )
    nodes = ends.groupBy("node").agg(
        F.min("v").alias("least"), F.max("v").alias("most"), F.max("root").alias("root")
    )
    return nodes.where("least != most OR (least IS NOT NULL AND root)")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    out = both.where(F.col("v") > F.col("u")).join(least, "u")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m"))
    return (
        moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.withColumnRenamed("m", "v"))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v); root is the least.

    Tasks first replace the edges they hold by stars, a bounded number at once.  What
    is left takes rounds: each only takes minima per node and joins them back, so that
    no task holds the neighbours of one node; the number of rounds is logarithmic.
    A round has some eight exchanges, each a thread, a plan and code in the driver, so
    none is begun once all edges form stars.  Roots themselves are not listed.
    """
    current = _local_stars(edges.where("u != v")).distinct()
    current = stored(_local_stars(current), "edges")
    while not _undone(current).isEmpty():
        current = stored(_local_stars(_small_star(_large_star(current))), "edges")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).distinct()
