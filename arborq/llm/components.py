"""Connected components of an edge table: of few edges in one task, of more by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborq.llm import common

#: Each round at least halves the longest path to a component's smallest node; this is for 2 ** 60 nodes.
MOST_ROUNDS = 60


def star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v, once each. Large: each node's larger neighbours, small: its smaller ones and itself, are
    linked with the smallest of the node and its neighbours. The smallest is a partial aggregate, joined back, so that a
    node with very many neighbours is split like any skewed join."""
    both = edges.union(edges.select("v", "u")) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if large:
        return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


#: So many edges at most are joined up in one task, a fixed bound for its memory. A round of stars takes thousands of tasks
#: where there are hundreds of partitions, whose shuffle files and records outweigh so small a table.
FEW = 250_000
PARTS = pa.schema([("node", pa.int64()), ("component", pa.int64())])


def joined_up(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges that is not its component's smallest, and that smallest one."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    up = list(range(len(nodes)))
    for x, y in zip(ends[: len(u)].tolist(), ends[len(u) :].tolist(), strict=True):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[max(x, y)] = min(x, y)
    for x in range(len(up)):  # what is above a node is smaller, and has its root already
        up[x] = up[up[x]]
    root = np.array(up, np.int64)
    inner = np.flatnonzero(root != np.arange(len(root)))
    return nodes[inner], nodes[root[inner]]


def of_few(edges: DataFrame) -> DataFrame:
    """edges (u, v) to (node, component), or to one row of nulls if there are more than FEW."""
    most = FEW

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.keeps("shingles", dict)
        held, n = [], 0
        for batch in batches:
            n += batch.num_rows
            if n <= most:
                held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)])
        if n > most:
            yield common.to_batch([(None, None)], PARTS)
        elif n:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in joined_up(*map(np.concatenate, zip(*held, strict=True)))], schema=PARTS)

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(settle, "node long, component long")


def settled(edges: DataFrame) -> DataFrame:
    """components(), of at most FEW edges by one task. edges are read twice: a table, or rows of one."""
    few = common.cut(of_few(joined(edges)), 1)
    return few if few.where("node IS NULL").isEmpty() else components(edges)


def joined(edges: DataFrame) -> DataFrame:
    """edges (a, b) as (u, v) with u > v."""
    return edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of whole numbers, in any order, repeated or not; (node, component) of every node on an edge that is not
    its component's smallest. Nothing but a sum and a count of each round reaches the driver."""
    now, was, rows = joined(edges).distinct(), None, None
    for _ in range(MOST_ROUNDS):
        now = common.cut(star(star(now, large=True), large=False), rows)
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == was or not mark[0]:
            break
        was, rows = mark, mark[0]
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
