"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import cut

#: Edges of a task that are made a forest together.
FOREST = 1 << 20


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that it reaches) of the nodes of these edges that reach a lesser one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v), v < u, to fewer edges that reach the same: of FOREST edges at a time not more than their nodes are left."""
    held, size = [], 0

    def made() -> pa.RecordBatch:
        u, v = _roots(*(np.concatenate([np.asarray(b.column(k)) for b in held]) for k in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= FOREST:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with m, the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("w")).select("u", "v", "m")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of edges (a long, b long): component is the least node that a path reaches.

    Edges with a null end or both ends alike say nothing and are left out; an empty table gives no
    rows. A task's edges first become a forest, so a dense component does not move all of its edges. Each round is written to the shared folder; the number of rounds grows with the logarithm of the longest path.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e, before = cut(e.mapInArrow(_forest, "u long, v long").distinct(), name), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        s = _star(large)  # here v < u, so m < u
        small = s.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        e = cut(small.where("u <> v").distinct(), name)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
