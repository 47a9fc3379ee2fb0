"""Connected components of an edge table, as Spark jobs.

Large-star / small-star: each pass replaces a vertex's edges by edges to the
smallest vertex seen around it, until every vertex points at the smallest
vertex of its component. A pass is two partial aggregations and two joins
(hot vertices are combined before the shuffle, and AQE splits them in the
joins); its edges are written to the shared folder, so neither plans nor
recovery grow with the number of passes.

A table of few edges, as a count shows, is settled by one task instead: there
the jobs of the passes cost far more than the edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodgauge.llm.common import ship_package, written

# distinct edges that one task takes; more go through the passes
FEW_EDGES = 250_000


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable from each) of undirected edges."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, z = at[:len(u)], at[len(u):]
    low = np.arange(len(nodes))
    while True:
        x, y = low[a], low[z]
        if (x == y).all():
            return nodes, nodes[low]
        # the larger root of an edge hangs on the smaller, then all on roots
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]


def _settle(batches):
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if parts:
        node, root = smallest_reachable(*(np.concatenate(x) for x in zip(*parts)))
        yield pa.record_batch({"node": pa.array(node, pa.int64()), "component": pa.array(root, pa.int64())})


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on directed edges (u, v) with u > v."""
    if large:       # neighbours on both sides; larger ones move to the minimum
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:           # smaller neighbours only
        both = edges
    low = both.groupBy("u").agg(F.min("v").alias("lo")).select("u", F.least("u", "lo").alias("lo"))
    moved = both.join(low, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("lo").alias("v"))
        # the vertex itself keeps its link to the minimum
        out = out.unionAll(low.where("lo < u").select("u", F.col("lo").alias("v")))
    else:
        out = moved.where("v > lo").select(F.col("v").alias("u"), F.col("lo").alias("v"))
        out = out.unionAll(low.select("u", F.col("lo").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u long, v long), any direction, repeats and loops allowed.

    Returns (node, component) for every node of an edge between two nodes;
    component is the smallest node reachable. Null ends are ignored; an empty
    table gives an empty result."""
    e = written(edges.where("u != v").select(F.greatest("u", "v").cast("long").alias("u"),
                                             F.least("u", "v").cast("long").alias("v")).distinct(), "edges")
    if e.limit(FEW_EDGES + 1).count() <= FEW_EDGES:
        ship_package(e.sparkSession)
        return e.coalesce(1).mapInArrow(_settle, "node long, component long")
    while True:
        # done when no vertex has two targets and no target has one itself
        state = e.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        many = state.where("n > 1").limit(1).count()
        if not many and not e.join(state.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            break
        e = written(_star(_star(e, True), False), "edges")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
