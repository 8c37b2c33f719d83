"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemspark.storage import forget, ship, stored


def linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 and edges a-b the smallest node of each one's component: roots hook on smaller roots, then paths
    shrink to their roots, until no edge joins two of them."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label = up


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    a, b = (np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i in (0, 1))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    found = nodes[linked(len(nodes), at[: len(a)], at[len(a) :])] if len(nodes) else nodes
    yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "component": pa.array(found, pa.int64())})


def components(edges: DataFrame, one_task: int = 0) -> DataFrame:
    """node, component (its smallest node) for every node of edges(a, b); both long.

    Each level hooks every node on the neighbour (or itself) with the smallest hash and contracts the edges by that map, so
    the hash's random order shrinks chains as well as stars by a constant factor a level. The minimum per node is summed
    map-side; the contraction is two equi-joins, whose skewed keys Spark splits. Levels are stored on shared storage.
    Null ends and loops count for nothing (a loop makes no node); repeated and reversed edges are one edge. Up to `one_task`
    edges, which are counted first, go to one task instead.
    """
    both = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    current = stored(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    if one_task and current.count() <= one_task:
        ship(edges.sparkSession)
        found = stored(current.repartition(1).mapInArrow(_in_one_task, "node long, component long"), "cc-labels")
        forget(current)
        return found
    levels = []
    while not current.isEmpty():
        ways = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = ways.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("n"))).alias("m"))
        self_ = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("n"))
        hooks = stored(near.select(F.col("a").alias("node"), F.least("m", self_)["n"].alias("up")), "cc-hooks")
        levels.append(hooks)
        left, right = hooks.select(F.col("node").alias("a"), F.col("up").alias("ua")), hooks.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        raised = current.join(left, "a").join(right, "b").where("ua <> ub")
        done = current
        current = stored(raised.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "cc-edges")
        forget(done)
    if not levels:
        return both.select(F.col("a").alias("node"), F.col("b").alias("component")).where(F.lit(False))
    top = levels[-1].withColumnRenamed("up", "root")
    for hooks in reversed(levels[:-1]):
        above = top.select(F.col("node").alias("up"), F.col("root").alias("far"))
        top = hooks.join(above, "up", "left").select("node", F.coalesce("far", "up").alias("root"))
    smallest = top.groupBy("root").agg(F.min("node").alias("component"))
    found = stored(top.join(smallest, "root").select("node", "component"), "cc-labels")
    forget(current, *levels)
    return found
