"""Connected components of an edge table; nothing is collected.

Each task first contracts its edges to stars, one row for a node at most, so that what the rounds read grows with the nodes and not
with the edges (dense groups have many more). A graph that then fits one task is done there; a larger one goes through alternating
large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyloom.llm import common


#: Edges of one node beyond which they are not brought together: there are few such nodes (counted first), and their least neighbours are sent to all edges.
MANY = 256


#: Rows of edges in a partition: a small graph is worked in few tasks, so that no round writes hundreds of files.
ROWS = 100_000


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, ascending, and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    up = np.arange(len(nodes))
    while len(a):
        x, y = up[a], up[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))  # roots only, each to a smaller one
        while (up[up] != up).any():
            up = up[up]
    return nodes, nodes[up]


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a task's edges (two columns): each node u that isn't the least it reaches by them, with that least v. The held edges are contracted on the way."""
    u = v = np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        rows += batch.num_rows
        if rows >= max(ROWS, len(u)):
            (u, v), held, rows = contracted(u, v, held), [], 0
    u, v = contracted(u, v, held)
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def contracted(u: np.ndarray, v: np.ndarray, more: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    node, least = least_reached(np.concatenate([u, *(x for x, _ in more)]), np.concatenate([v, *(y for _, y in more)]))
    own = node != least
    return node[own], least[own]


def with_least(both: DataFrame, least: DataFrame) -> DataFrame:
    """The edges, each with the least neighbour m of its u. least: u, m, k_ (edges of u), already written."""
    hot = least.where(F.col("k_") > MANY).drop("k_")
    if not 0 < hot.count() <= common.SMALL_IDS:
        return both.join(least.drop("k_"), "u")
    rest = both.join(F.broadcast(hot.select("u")), "u", "left_anti").join(least.where(F.col("k_") <= MANY).drop("k_"), "u")
    return rest.unionByName(both.join(F.broadcast(hot), "u"))


def pairs(df: DataFrame, *ways: tuple[str, str]) -> DataFrame:
    """Edges (u, v) from each row's columns, taken in these ways."""
    x = F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ways])).alias("x")
    return df.select(x).select("x.u", "x.v")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """From edges (a, b) of ids: node, component (the smallest id it reaches). Nodes without an edge are not in it; loops and repeats do no harm."""
    common.shared_dir(edges.sparkSession)
    contract = lambda df: df.mapInArrow(stars, "u bigint, v bigint").checkpoint()
    e = contract(edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a <> b"))
    left, last = e.count(), 0
    while left > ROWS and (not last or 2 * left <= last):
        e, last = contract(e.coalesce(-(-left // ROWS))), left
        left = e.count()
    e = contract(e.coalesce(1)) if left <= ROWS else settled(e, rounds)
    return pairs(e, ("u", "v"), ("v", "v")).select(F.col("u").alias("node"), F.col("v").alias("component")).distinct()


def settled(e: DataFrame, rounds: int) -> DataFrame:
    """The edges (u, v) by rounds of large and small stars, until each node's only one leads to the least of its component."""
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    state = lambda: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = state()
    for _ in range(rounds):
        parts = max(1, -(-before[0] // ROWS))
        both = pairs(e.coalesce(parts), ("u", "v"), ("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k_")).coalesce(parts).checkpoint()
        large = with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        # small star: every edge points from the larger node to the smaller
        linked = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        e = pairs(linked, ("u", "m"), ("v", "m")).where("u <> v").distinct().coalesce(parts).checkpoint()
        now = state()
        if now == before:
            return e
        before = now
    raise RuntimeError("components did not settle")
