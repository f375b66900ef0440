"""Connected components of an edge table: spanning forests within tasks, then joins and aggregations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webposture.session import materialize


#: Edges that a task joins up in its memory.
TASK_EDGES = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An Arrow function over edges (a, b): an edge from every node but the least to the least one that these edges reach."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["a", "b"])


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``node`` and ``component`` (least node reached) for all nodes of the edges (a, b).

    A task first reduces ``task_edges`` edges to a spanning forest, which has no more edges than nodes.  If one task holds all
    of them that is the answer.  Else rounds of large-star and small-star steps follow: every node hands its greater neighbours, then its
    lesser ones, to its least neighbour, so long chains halve.  A node with many edges spreads over tasks: minima combine before
    the shuffle and the joins are plain, so that Spark can split them.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialize(edges)
    tasks = math.ceil(edges.count() / task_edges)
    forest = edges.where("a > b").coalesce(max(1, tasks)).mapInArrow(_forest, "a long, b long")
    edges = materialize(forest if tasks <= 1 else forest.distinct())  # a > b
    before = _digest(edges) if tasks > 1 else None
    while tasks > 1:
        large = _star(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "b > a")
        after = materialize(_star(large, "true"))
        edges, now = after, _digest(after)
        if now == before:
            break
        before = now
    # Now every edge leads to the least node of its component.
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _digest(edges: DataFrame) -> tuple:
    """Number of the distinct edges and two hashes of them, whatever their order."""
    hashed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(hashed), F.bit_xor(F.xxhash64(hashed, "b"))).first())


def _star(edges: DataFrame, which: str) -> DataFrame:
    """Link the neighbours b of each a for which ``which`` holds to the least of a and its neighbours."""
    least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
    least = least.select("node", F.least("node", "least").alias("least"))
    moved = edges.join(least, F.col("a") == F.col("node")).select("a", "b", "least")
    linked = moved.where(which).select(F.col("b").alias("a"), F.col("least").alias("b"))
    if which == "true":  # the centre itself, too
        linked = linked.unionByName(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    return linked.where("a > b").distinct()
