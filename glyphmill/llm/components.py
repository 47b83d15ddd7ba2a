"""Connected components of an edge table: smallest id reachable.

Every round points each node at its smallest neighbour, follows the pointers to
their roots by doubling, and replaces both ends of every edge by its root. Each
round leaves at most half of the roots that still have edges, so the rounds are
logarithmic in the number of nodes. Tables are written between rounds; only
counts reach the driver. A node with very many edges is pre-aggregated by the
minimum and joined through a join that Spark can split.

Up to ``AT_ONCE`` edges, a size that is counted first, one task does the same with
a union-find over their ends; the result doesn't depend on which way it came.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch

#: Edges that one task may hold: 16 bytes each in Arrow, some hundred in Python.
AT_ONCE = 250_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        at = x
        while up.setdefault(at, at) != at:
            at = up[at]
        while up[x] != at:
            up[x], x = at, up[x]
        return at

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            low, high = sorted((root(a), root(b)))
            up[high] = low
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(n) for n in nodes], pa.int64())], ["node", "component"])


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); self-loops and
    repeated edges are allowed, null ends are dropped."""
    clean = edges.where("a is not null and b is not null and a != b")
    left = scratch.save(clean.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges-0")
    if left.count() <= AT_ONCE:
        return scratch.save(left.coalesce(1).mapInArrow(_union_find, "node long, component long"), f"{name}-roots-0")
    root = None
    for turn in range(1, 64):
        if left.isEmpty():
            break
        both = left.select("a", "b").union(left.select("b", "a"))
        parent = scratch.save(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), f"{name}-parents-{turn}-0")
        for jump in range(1, 64):
            above = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
            moved = scratch.save(parent.join(above, "p").select("a", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), f"{name}-parents-{turn}-{jump}")
            still = moved.where("moved").isEmpty()
            scratch.drop(f"{name}-parents-{turn}-{jump - 1}")
            parent = moved.select("a", "p")
            if still:
                break
        if root is None:
            root = parent.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            step = parent.select(F.col("a").alias("component"), "p")
            root = root.join(step, "component", "left").select("node", F.coalesce("p", "component").alias("component"))
        root = scratch.save(root, f"{name}-roots-{turn}")
        to_a, to_b = parent.select("a", F.col("p").alias("pa")), parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        joined = left.join(to_a, "a").join(to_b, "b").where("pa != pb")
        left = scratch.save(joined.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), f"{name}-edges-{turn}")
    if root is None:
        return left.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return root
