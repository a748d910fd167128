"""Connected components as iterated Spark joins (large star, small star)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) with the same components."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for side in (x, y):
            np.minimum.at(new, root[side], low)
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars on its smallest nodes, half a million at a time."""
    held, n = [np.zeros((2, 0), np.int64)], 0
    for batch in batches:
        held.append(np.stack([batch.column("a").to_numpy(), batch.column("b").to_numpy()]))
        n += len(batch)
        if n > 1 << 19:
            held = [np.stack(contract(*np.concatenate(held, axis=1)))]
            n = held[0].shape[1]
            if n > 1 << 18:
                yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], ["a", "b"])
                held, n = [], 0
    if held:
        a, b = contract(*np.concatenate(held, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(edges: DataFrame, scratch: Scratch, rounds: int = 40, small: int = 1 << 20, reduced: bool = False) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node reachable.

    Tasks first reduce their edges to forests, unless what makes the edges has
    ``reduced`` them so (one Python worker per task, not two, then). Up to ``small`` edges are then
    contracted by one task, in about 50 MB. Beyond that, each round relinks all
    neighbours of a node to the smallest of them, so depth falls geometrically;
    each round's table is written to the shared folder. Only minima per node
    are aggregated (combined before the shuffle); no neighbour list is gathered.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            both = pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(low, "a")
        if large:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        """The table, and its count and checksum, taken while it is written."""
        seen = Observation()
        out = scratch.table(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 40)).alias("sum")))
        return out, (seen.get["n"], seen.get["sum"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All components of a small graph."""
        pairs = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
        a, b = contract(*(np.concatenate([np.zeros(0, np.int64), *(p[i] for p in pairs)]) for i in (0, 1)))
        roots = np.unique(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(a, roots)), pa.array(np.append(b, roots))], ["node", "component"])

    first = edges.select("a", "b").where("a <> b")
    now, before = written(first if reduced else first.mapInArrow(forest, "a long, b long"))
    if before[0] <= small:
        return scratch.table(now.coalesce(1).mapInArrow(whole, "node long, component long"))
    for _ in range(rounds):
        then, after = written(star(star(now, True), False).mapInArrow(forest, "a long, b long"))
        scratch.drop(now)
        now = then
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # at the fixpoint every edge is (node, smallest of its component)
    return scratch.table(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct())
