"""Connected components of an edge table: tasks contract their own edges to stars, then large-star and small-star steps alternate.

Stars of at most CHUNK edges are contracted once more, by one task, and are done: a round is a plan of many shuffles and joins, which costs
the driver more than so few edges do. More edges stay dealt, and both steps are groupings and joins on a node. A node's neighbour list is never gathered: its minimum is a
pre-aggregated groupBy, joined back. The minima of hubs, nodes with over a fixed share of all rows and hence bounded in
number, are broadcast, so that no key brings more than that share to one task. The lineage is cut after each
round by a table in the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.plans.lineage import cut

#: A node with over 1 / HUBS of all rows is a hub; there are at most that many.
HUBS = 4096

#: Edges that a task contracts at once.
CHUNK = 1 << 18


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges that are not the least of their component, and that least node of each."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    least = np.arange(len(names))
    while True:
        x, y = least[u], least[v]
        apart = x != y
        if not apart.any():
            own = np.flatnonzero(least != np.arange(len(names)))
            return names[own], names[least[own]]
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least[least] != least).any():
            least = least[least]


def _contracted(edges: DataFrame, chunk: int) -> DataFrame:
    """edges (a, b), each `chunk` of a task's replaced by the stars that connect the same nodes."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def told():
            a, b = (np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in held]) for c in "ab")
            kinds = [held[0].schema.field(c).type for c in "ab"]
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(_stars(a, b), kinds, strict=True)], ["a", "b"])

        for batch in batches:
            for start in range(0, batch.num_rows, chunk):
                part = batch.slice(start, chunk)
                if rows + part.num_rows > chunk:
                    yield told()
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            yield told()

    return edges.select("a", "b").mapInArrow(contract, edges.select("a", "b").schema)


def _open(edges: DataFrame) -> tuple[int, int]:
    """How many nodes of the distinct edges (a, b), b < a, keep them from being stars around least nodes; how many edges there are."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.max("root").alias("root"))
    seen = nodes.agg(F.count_if(F.col("ups") + F.col("root") > 1).alias("open"), F.sum("ups").alias("n")).first()
    return seen.open, seen.n or 0


def _least_joined(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """rows (a, b) with m of least (a, m, n), n being how many rows a has."""
    floor = total / HUBS
    hubs = least.filter(F.col("n") > floor).select("a", F.col("m").alias("of_hub"))
    marked = rows.join(F.broadcast(hubs), "a", "left")
    light = marked.filter("of_hub is null").select("a", "b").join(least.filter(F.col("n") <= floor).select("a", "m"), "a")
    return marked.filter("of_hub is not null").select("a", "b", F.col("of_hub").alias("m")).union(light.select("a", "b", "m"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
    return _least_joined(both.filter("b > a"), least, 2 * total).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = _least_joined(down, least, total).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, chunk: int | None = None) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    Self loops, repeated edges and edges with a null end add nothing. An empty edge table gives an empty
    result. A task holds at most `chunk` (CHUNK) edges. Raises RuntimeError if max_rounds do not suffice (the rounds grow with the logarithm of the
    longest chain).
    """
    chunk = chunk or CHUNK
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(F.col("a") != F.col("b"))
    now = cut(_contracted(now, chunk), "edges")
    total = now.count()
    now = _contracted(now.coalesce(max(1, math.ceil(total / chunk))), chunk)
    now = cut(now if total <= chunk else now.distinct(), "star")
    left, total = (0, total) if total <= chunk else _open(now)
    for _ in range(max_rounds):
        if not left:
            nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return nodes.union(roots)
        # a large star has no more rows than there are edges
        now = cut(_small_star(_large_star(now, total), total).distinct(), "star")
        left, total = _open(now)
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
