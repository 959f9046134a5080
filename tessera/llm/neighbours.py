"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Vectors are dealt into blocks; a block's index
is an inverted file: for each pivot, the vectors that have it and at which place. A query reads the lists of its own first
pivots only, which gives a partial footrule nearness of the vectors in them (0 for the others). A line fitted in the block turns
nearness into a cosine, and the vector's length that into an inner product, so that vectors of unequal lengths are ranked rightly;
the nearest share of a block is ranked again by exact inner products. The queries, a stated set, meet all rows in blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, read_table

PIVOTS = 1024
#: Pivots in a vector's representation; pivots of a query whose lists are read.
LENGTH, PROBED = 128, 32
#: Share of a block that is ranked again, and the least number; vectors that tie with its last one are, too.
SHARE, LEAST = 0.14, 512
#: Vectors of a block, which have an index together, queries that ask it at once, vectors that the line is fitted on.
BLOCK, QUERY_BLOCK, FITTED = 8192, 16384, 48
NEAREST = 20
#: Numbers of components that have pivots of their own, the commonest ones; other vectors are all ranked exactly.
SIZES = 16


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part: an id, and a vector that isn't null, empty or zero and has finite components only."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    df = vectors.select(col(id_col).cast("long").alias("vec_id"), col(vector_col).cast("array<double>").alias("v"))
    return df.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))


def choose_pivots(vectors: DataFrame, n: int, pivots: int = PIVOTS) -> np.ndarray:
    """At most `pivots` of vectors (vec_id, v), n in number and of one length, made unit vectors; chosen by a hash of id and vector, half of them at most. Equal vectors are chosen once."""
    pivots = min(pivots, -(-n // 2))
    spot = F.pmod(F.xxhash64("vec_id", "v", F.lit("pivot")), F.lit(1 << 40)) / float(1 << 40)
    rows = vectors.withColumn("spot", spot).where(F.col("spot") < min(1.0, 4.0 * pivots / max(n, 1))).groupBy("v").agg(F.min("spot").alias("spot")).orderBy("spot").limit(pivots).collect()
    p = np.array([r["v"] for r in rows])
    return p / np.linalg.norm(p, axis=1, keepdims=True) if len(p) else p


def places(x: np.ndarray, pivots: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each row of x the numbers of its nearest pivots, nearest first, ties to the lower number."""
    near = x @ pivots.T
    length = min(length, len(pivots))
    some = np.sort(np.argpartition(-near, length - 1, axis=1)[:, :length], axis=1)
    order = np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, order, 1).astype(np.int32)


class InvertedFile:
    """The permutation index of one block of vectors x."""

    def __init__(self, x: np.ndarray, pivots: np.ndarray, length: int = LENGTH, probed: int = PROBED):
        order = places(x, pivots, length)
        self.n, self.length, self.probed = len(x), order.shape[1], min(probed, order.shape[1])
        pivot, place = order.ravel(), np.tile(np.arange(self.length, dtype=np.int32), len(x))
        owner = np.repeat(np.arange(len(x), dtype=np.int32), self.length)
        by = np.argsort(pivot, kind="stable")
        ends = np.searchsorted(pivot[by], np.arange(len(pivots) + 1))
        self.lists = [(owner[by[a:b]], place[by[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        # The line from nearness to cosine, and how far off it is.
        self.norms = np.linalg.norm(x, axis=1)
        unit = x / self.norms[:, None]
        some = np.arange(len(x))[:: max(1, len(x) // FITTED)][:FITTED]
        near = np.array([self.nearness(order[i]) for i in some], float)
        cosine = unit[some] @ unit.T
        apart = np.arange(len(x))[None, :] != some[:, None]
        near, cosine = near[apart], cosine[apart]
        self.slope = float(np.cov(near, cosine)[0, 1] / max(near.var(), 1e-12)) if len(near) > 1 else 0.0
        self.start = float(cosine.mean() - self.slope * near.mean()) if len(near) else 0.0
        self.spread = float((cosine - self.start - self.slope * near).std()) if len(near) else 0.0

    def nearness(self, order: np.ndarray) -> np.ndarray:
        """For each vector of the block the sum, over the first pivots of an order that it has too, of length minus difference in place."""
        out = np.zeros(self.n, np.int32)
        for at, pivot in enumerate(order[: self.probed]):
            owner, place = self.lists[pivot]
            out[owner] += self.length - np.abs(place - at)
        return out

    def likely(self, order: np.ndarray) -> np.ndarray:
        """For each vector an optimistic estimate of its inner product with a unit query of that order."""
        return (self.start + self.spread + self.slope * self.nearness(order)) * self.norms


def search(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, id_col: str = "vec_id", vector_col: str = "embedding", share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's nearest vectors found, by inner product, ties to the smaller id.

    A query never finds its own id. Vectors that are null, empty, zero or hold null or non-finite
    components take no part, nor do null ids. Vectors of different lengths never meet; each of the commonest lengths has
    pivots of its own, vectors of rarer ones are all ranked exactly. Repeated ids: as queries, one of
    their vectors is asked; as candidates, all rows count. Empty tables give no rows; other columns are not read.
    """
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"))
    common = {r["size"]: r["n"] for r in sizes.orderBy(F.desc("n"), "size").limit(SIZES).collect()}
    pivots = {size: choose_pivots(rows.where(F.size("v") == size), n) for size, n in common.items()}
    n = sizes.agg(F.sum("n")).first()[0] or 0
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-asked.count() // QUERY_BLOCK))

    def match(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, float]] = []
        if len(v) and len(q):
            v, size = v.sort_values("vec_id", kind="stable"), len(v["v"].iloc[0])
            x, ids, y = np.stack(v["v"].to_numpy()), v["vec_id"].to_numpy(), np.stack(q["v"].to_numpy())
            want = min(len(x), max(LEAST, nearest + 1, int(np.ceil(share * len(x)))))
            index = orders = None
            if want < len(x) and size in pivots:
                index, orders = InvertedFile(x, pivots[size]), places(y, pivots[size])
            for i, (query, vector) in enumerate(zip(q["vec_id"].tolist(), y, strict=True)):
                at = np.flatnonzero(ids != query)
                if index is not None:
                    likely = index.likely(orders[i])
                    at = np.flatnonzero((likely >= np.partition(likely, len(likely) - want)[len(likely) - want]) & (ids != query))
                score = (x[at] * vector).sum(1)
                best = np.lexsort((ids[at], -score))[:nearest]
                found += zip([query] * len(best), ids[at[best]].tolist(), score[best].tolist(), strict=True)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = rows.select("vec_id", "v", F.size("v").alias("size"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block"), every(query_blocks, "query_block"))
    right = asked.select("vec_id", "v", F.size("v").alias("size"), F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("query_block"), every(blocks, "block"))
    found = left.groupBy("size", "block", "query_block").cogroup(right.groupBy("size", "block", "query_block")).applyInPandas(match, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
