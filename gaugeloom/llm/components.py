"""Connected components of an undirected graph as Spark joins, without a driver-side structure."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written

#: So many edges (16 bytes each) are settled by one task; graphs with more are contracted by joins until they are stars or have no more.
LOCAL_EDGES = 1_000_000


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, root) for every node (long) of ``edges`` (a, b): root is the smallest node of its component.

    Alternates the large-star and small-star steps: each node's larger neighbours, then its smaller ones,
    are linked to its smallest. That ends when the edges form stars, after a number of rounds that grows with
    the logarithm of the longest path. As soon as no more than ``local_edges`` edges are left, which is counted,
    one task of bounded memory settles them by the same rule. Each step is written to shared storage; nulls
    and loops are left out. The result is not written.
    """
    edges = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi is not null and lo is not null and hi <> lo").distinct()
    edges = written(edges, "edges")
    while edges.count() > local_edges:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.filter("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct(), "large")
        dropped(edges)
        if _are_stars(large):
            roots = large.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return large.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        linked = large.join(down, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = written(linked.unionByName(down.select("hi", F.col("m").alias("lo"))).filter("hi <> lo").distinct(), "small")
        dropped(large)
    return edges.repartition(1).mapInArrow(_settle, "node long, root long")


def _settle(batches):
    """Components of the edges of one task: every root hooks on to the smallest root beside it, then paths are halved."""
    parts = [(b.column("hi").to_numpy(), b.column("lo").to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    hi, lo = (np.concatenate(x) for x in zip(*parts))
    nodes, ends = np.unique(np.concatenate([hi, lo]), return_inverse=True)
    a, b = ends[: len(hi)], ends[len(hi) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
    for i in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(nodes[label[i : i + 100_000]])], names=["node", "root"])


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one root, and no root hangs on another node."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(edges.select(F.col("lo").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return nodes.agg(F.count(F.when(F.col("below") + F.col("above") > 1, 1)).alias("odd")).first()["odd"] == 0
