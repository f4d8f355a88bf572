"""Connected components of a link table, by local union and alternating stars.

The links are first replaced, task by task, by the stars of what they join there. As many as a task can hold are
then settled by one task; more go through rounds of stars until they are so few or settled, with the same result. Each round points the larger neighbours of a node at the smallest one (large star) and then the smaller
neighbours (small star), until every component is a star. The number of rounds grows with the logarithm of the longest
chain. A node with very many links is a hot key: its links are aggregated before the shuffle, and the join
back has two plain exchanges, so that a hot partition is split at run time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, dropped, written

MOST_ROUNDS = 60
#: Links that a task holds at once (16 MB for long nodes).
HELD_LINKS = 1 << 20


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node with a link to another one.

    Links that are null at an end or join a node to itself are left out; repeated links count once. Without
    links the result is empty.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and u <> v")
    if getattr(links, "_shared_path", None) and edges.count() <= HELD_LINKS:  # read again at no cost, so that one table is saved
        return _settled(edges.coalesce(1), HELD_LINKS)
    edges = written(_settled(edges, HELD_LINKS).where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")), "links")
    for _ in range(MOST_ROUNDS):
        if edges.count() <= HELD_LINKS:
            return _settled(edges.coalesce(1), HELD_LINKS)
        if _is_star_forest(edges):
            break
        for large in (True, False):
            least = written(_least(edges, large), "least")
            new = written(_star(edges, least, large), "stars")
            dropped(least)
            dropped(edges)
            edges = new
    else:
        raise RuntimeError(f"no star forest after {MOST_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def smallest_nodes(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the links from ``one`` to ``two``, and the smallest node that each reaches."""
    nodes, codes = np.unique(np.concatenate([one, two]), return_inverse=True)
    a, b = codes[: len(one)], codes[len(one) :]
    root = np.arange(len(nodes))
    while len(a):  # links between roots: the larger ends move to a smaller one
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[root]


def _settled(edges: DataFrame, most: int) -> DataFrame:
    """``node`` and ``component`` of what each task's ``edges`` (u, v) join, of ``most`` edges at a time."""
    kind = edges.schema["u"].dataType.simpleString()

    def settled(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        found = smallest_nodes(*(rows.column(c).to_numpy() for c in ("u", "v")))
        return pa.RecordBatch.from_arrays([pa.array(x, rows.schema.field("u").type) for x in found], ["node", "component"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        room = most
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                room -= held[-1].num_rows
                if not room:
                    yield settled(held)
                    held, room = [], most
        if held:
            yield settled(held)

    bound_batches(edges.sparkSession)
    return edges.mapInArrow(run, f"node {kind}, component {kind}")


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node either points at one smaller node or is pointed at."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.count("*").alias("n"))
    return nodes.where("up > 1 or up = 1 and n > 1").isEmpty()


def _pairs(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` hold u > v; for a large star each is seen from both ends."""
    pairs = edges.select("u", "v")
    return pairs.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs


def _least(edges: DataFrame, large: bool) -> DataFrame:
    """The smallest of each node and its neighbours. Written out, so that the join with it splits hot nodes."""
    return _pairs(edges, large).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _star(edges: DataFrame, least: DataFrame, large: bool) -> DataFrame:
    """Large: the larger neighbours of each node move to its smallest; small: the smaller ones, and itself."""
    joined = _pairs(edges, large).join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
