"""Connected components of a graph whose links are in a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, tidy

#: Links that a task connects at once. Where no more are left than that, one task connects all; else rounds of joins do.
AT_ONCE = 1_000_000


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while True:
        x, y = least[a], least[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[least]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        # of two roots the larger points to the smaller, then all nodes to their roots
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least[least] != least).any():
            least = least[least]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b) to (u, v): for each node of a task's links the least that it reaches by them. Over AT_ONCE links are taken in parts."""

    def out() -> pa.RecordBatch:
        links = pa.Table.from_batches(held)
        found = least_reachable(links.column(0).to_numpy(), links.column(1).to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n > AT_ONCE:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def _least_neighbour(links: DataFrame) -> DataFrame:
    """``links`` (u, v) with ``m``, the least of u and all its neighbours.

    The least is found by a combined aggregate; it is joined by the complement of ``u``, so that the join
    has exchanges of its own and adaptive execution can split the links of a node with very many.
    """
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not("u").alias("k"), F.least("u", "m").alias("m"))
    return links.withColumn("k", F.bitwise_not("u")).join(least, "k").select("u", "v", "m")


def connected_components(links: DataFrame, forests: bool = False) -> DataFrame:
    """(node, component) for every node of ``links`` (a long, b long); the component is its least node.

    ``links`` is run once: each task leaves a forest of its own links, which is written to the shared folder. With ``forests``, ``links`` are such
    forests already, made by ``_forest`` in the tasks that find the links, which so need no second Python worker. A forest of AT_ONCE rows at most is
    connected by one task. A larger one goes through alternating large-star and small-star steps, each written to the shared folder, until none changes a
    link; their number grows with the logarithm of the size of a component. A node linked only with itself is its own component. Nulls are ignored; no links give no rows.
    """
    both = links.select(F.col(links.columns[0]).cast("long").alias("a"), F.col(links.columns[1]).cast("long").alias("b")).where("a is not null and b is not null")
    forest = materialize(both.toDF("u", "v") if forests else both.mapInArrow(tidy(_forest), "u long, v long"), "links")
    if forest.count() <= AT_ONCE:
        return forest.coalesce(1).mapInArrow(tidy(_forest), "u long, v long").select(F.col("u").alias("node"), F.col("v").alias("component"))
    current, before = forest, None
    while True:
        proper = current.where("u <> v")
        all_ = proper.unionByName(proper.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(all_).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: each node and its smaller neighbours point to the least of them
        own = large.where("u <> v").distinct()
        small = _least_neighbour(own)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        current = materialize(small.where("u <> v").distinct(), "links")
        state = tuple(current.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u))")).first())
        if state == before:
            break
        before = state
    # roots and lone nodes point to themselves in the forest
    stars = current.unionByName(forest.where("u = v"))
    return stars.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
