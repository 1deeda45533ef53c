"""Connected components of a link table, distributed.

First every task unites the links it holds, so a long chain inside a task costs nothing, and only a
spanning forest of each task's links goes on. Then alternating large-star and small-star rounds
link every node to the smallest node of its neighbourhood until nothing changes; stars shrink to one
centre, so a hub never has to hold its neighbours. Each round is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.plans.session import discard, materialize

#: Up to so many forest links (16 bytes each) one task unites them all; beyond, rounds follow.
ONE_TASK = 2_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(node, root)`` of all nodes of the links but the roots; a root is its set's smallest node."""
    nodes, place = np.unique(np.r_[a, b], return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    n = len(a)
    for x, y in zip(place[:n].tolist(), place[n:].tolist(), strict=True):
        x, y = find(x), find(y)
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    root = np.array([find(i) for i in range(len(nodes))], np.int64)
    inner = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[inner], nodes[root[inner]]


def _unite(batches):
    parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches if batch.num_rows]
    if parts:
        node, root = forest(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()


def labels(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``(id, root)`` of every node of ``links (a, b)`` that is not itself a root.

    ``root`` is the smallest node of the component. Links of a node to itself, repeated links and
    links in either direction change nothing; NULL ends are left out; an empty table has no labels.
    """
    clean = links.where("a is not null and b is not null and a <> b").select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))
    edges = materialize(clean.mapInArrow(_unite, "a bigint, b bigint"), "forest")
    if edges.count() <= one_task:
        united = edges.coalesce(1).mapInArrow(_unite, "a bigint, b bigint")
        found = materialize(united.select(F.col("a").alias("id"), F.col("b").alias("root")), "labels")
        discard(edges)
        return found
    before = None
    while True:
        last, edges = edges, materialize(_small_star(_large_star(edges)), "stars")
        discard(last)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = state
