"""Greedy order of documents by similarity: edges, node weights, start node, chain, and the reordered index.

Documents of equal sketches are one node of the walk, with its members in id order: the edges among them are never made.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.work import cut, numbered
from .compare import min_matches
from .components import components
from .groups import BROADCAST

#: Edges of one component, whose walk is one task's, at most.
MOST_EDGES = 50_000_000
#: Edges of a component beyond which it is walked by its documents' cells, where its edges are dense: one in so many of its pairs.
DENSE, SPARSE = 100_000, 64


def edges(hits: DataFrame, least: float) -> DataFrame:
    """(src, dst, sim4) in both directions for every hit (qid, rid, score): sim4 is the score in ten-thousandths, rounded half to even."""
    h = hits.where("qid <> rid").select(F.col("qid").alias("a"), F.col("rid").alias("b"), F.bround(F.col("score") * 10000, 0).cast("long").alias("sim4"))
    h = h.where(F.col("sim4") >= least * 10000)
    return h.select(F.col("a").alias("src"), F.col("b").alias("dst"), "sim4").unionByName(h.select(F.col("b").alias("src"), F.col("a").alias("dst"), "sim4"))


def node_weights(docs: DataFrame, e: DataFrame) -> DataFrame:
    """(idx, weight4): sum of a document's edges; an edge that came from both directions counts twice."""
    w = e.groupBy(F.col("src").alias("idx")).agg(F.sum("sim4").alias("weight4"))
    return docs.select(F.col("gid").alias("idx")).distinct().join(w, "idx", "left").select("idx", F.coalesce("weight4", F.lit(0)).cast("long").alias("weight4"))


def start_node(weights: DataFrame) -> DataFrame:
    """(idx, weight4) of the heaviest document, ties to the highest id."""
    return weights.agg(F.max(F.struct("weight4", "idx")).alias("m")).select("m.idx", "m.weight4")


def best_neighbours(e: DataFrame) -> DataFrame:
    """(idx, best, sim4): each document's most similar neighbour, ties to the lowest id."""
    m = e.groupBy(F.col("src").alias("idx")).agg(F.min(F.struct((-F.col("sim4")).alias("s"), F.col("dst"))).alias("m"))
    return m.select("idx", F.col("m.dst").alias("best"), (-F.col("m.s")).alias("sim4"))


def _small(df: DataFrame) -> DataFrame:
    """The written table, broadcast where it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def class_weights(members: DataFrame, e: DataFrame) -> DataFrame:
    """(rep, n, weight4): what node_weights() gives each member of a class, from edges e (src, dst, sim4) between representatives, both directions, each once.

    members: (gid, rep, own4), own4 the similarity of two members, 0 if that makes no edge. Hits come from both sides, so an edge counts twice.
    """
    sizes = members.groupBy("rep").agg(F.count("*").alias("n"), F.max("own4").alias("own4"))
    several = _small(cut(sizes.where("n > 1").select(F.col("rep").alias("dst"), "n"), "sizes"))  # most classes have one member, and edges then stay where they are
    outer = e.join(several, "dst", "left").groupBy(F.col("src").alias("rep")).agg(F.sum(F.col("sim4") * F.coalesce("n", F.lit(1))).alias("outer"))
    return sizes.join(outer, "rep", "left").select("rep", "n", (2 * ((F.col("n") - 1) * F.col("own4") + F.coalesce("outer", F.lit(0)))).cast("long").alias("weight4"))


def _sim4(n: Column, s: int) -> Column:
    return F.bround(n / F.lit(float(s)) * 10000, 0).cast("long")


def class_members(c: DataFrame, s: int, least: float) -> DataFrame:
    """(gid, rep, own4) of classes (gid, rep, n_cells): own4 is the similarity of two members, as their cells are many, 0 if that makes no edge."""
    own = _sim4(F.col("n_cells"), s)
    return c.select("gid", "rep", F.when((own >= least * 10000) & (F.col("n_cells") >= min_matches(least, s)), own).otherwise(F.lit(0).cast("long")).alias("own4"))


def class_edges(found: DataFrame, s: int, least: float) -> DataFrame:
    """(src, dst, sim4) in both directions, each once, from pairs (qid, rid, matches) of representatives that come once. Made in one pass, beside the pairs."""
    both = F.explode(F.array(F.struct(F.col("qid").alias("src"), F.col("rid").alias("dst")), F.struct(F.col("rid").alias("src"), F.col("qid").alias("dst"))))
    return found.select(both.alias("e"), _sim4(F.col("matches"), s).alias("sim4")).where(F.col("sim4") >= least * 10000).select("e.src", "e.dst", "sim4")


def class_node_weights(docs: DataFrame, members: DataFrame, e: DataFrame) -> DataFrame:
    """node_weights() from written members (gid, rep, own4) and class_edges(). Edges are summed where they are made; a row for each representative of a task moves."""
    w = members.join(class_weights(members, e), "rep").select(F.col("gid").alias("idx"), "weight4")
    return docs.select(F.col("gid").alias("idx")).distinct().join(w, "idx", "left").select("idx", F.coalesce("weight4", F.lit(0)).cast("long").alias("weight4"))


def class_best_neighbours(members: DataFrame, e: DataFrame) -> DataFrame:
    """best_neighbours() from written members (gid, rep, own4) and class_edges(). A class's representative is its least id, so the nearest of other classes is one.

    In its own class a member's best is the representative; the representative's is the next id.
    """
    outer = e.groupBy(F.col("src").alias("rep")).agg(F.min(F.struct((-F.col("sim4")).alias("s"), F.col("dst"))).alias("outer"))
    second = members.where("gid <> rep AND own4 > 0").groupBy("rep").agg(F.min("gid").alias("second"))
    second = _small(cut(second, "second"))  # most classes have one member
    inner = F.when(F.col("second").isNotNull(), F.struct((-F.col("own4")).alias("s"), F.when(F.col("gid") == F.col("rep"), F.col("second")).otherwise(F.col("rep")).alias("dst")))
    best = members.join(outer, "rep", "left").join(second, "rep", "left").select(F.col("gid").alias("idx"), F.least("outer", inner).alias("m"))
    return best.where("m IS NOT NULL").select("idx", F.col("m.dst").alias("best"), (-F.col("m.s")).alias("sim4"))


def _visit(nodes: pd.DataFrame, finder: Callable) -> pd.DataFrame:
    """(weight4, start, place, node): the walk of one component, cut into segments at its jumps; a segment has its start's weight.

    nodes (gid, rep, own4, weight4): all members. Neighbours are visited lowest id first and jumps go to the highest id, so what is left of a class is always a run
    of its members. finder(reps, ids, own, n, low, high) makes the function from a class to the class whose next member is visited after it.
    """
    nodes = nodes.sort_values(["rep", "gid"])
    rep, gid = nodes["rep"].to_numpy(), nodes["gid"].to_numpy()
    reps, first = np.unique(rep, return_index=True)
    low, high = first.tolist(), [*first[1:].tolist(), len(rep)]  # members low to high are unvisited
    ids, of = gid.tolist(), np.searchsorted(reps, rep).tolist()
    weigh = nodes["weight4"].to_numpy()
    nearest = finder(reps, ids, nodes["own4"].to_numpy()[first], np.diff([*first, len(rep)]), low, high)
    out: list[tuple[int, int, int, int]] = []
    for at in np.lexsort((gid, weigh))[::-1].tolist():
        c = of[at]
        if not low[c] <= at < high[c]:
            continue
        high[c] -= 1  # a jump goes to the highest id that is left
        start, w, place = ids[at], int(weigh[at]), 0
        out.append((w, start, place, start))
        while (k := nearest(c)) is not None:
            place += 1
            out.append((w, start, place, ids[low[k]]))
            low[k] += 1
            c = k
    return pd.DataFrame(out, columns=["weight4", "start", "place", "node"])


def _walk(edges: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
    """The walk of one component along its edges (src, dst, sim4) between representatives."""

    def finder(reps: np.ndarray, ids: list[int], own: np.ndarray, n: np.ndarray, low: list[int], high: list[int]) -> Callable:
        inner = np.flatnonzero((n > 1) & (own > 0))
        src = np.concatenate([np.searchsorted(reps, edges["src"].to_numpy()), inner]).astype(np.int64)
        dst = np.concatenate([np.searchsorted(reps, edges["dst"].to_numpy()), inner]).astype(np.int64)
        sim = np.concatenate([edges["sim4"].to_numpy(), own[inner]])
        by = np.lexsort((-sim, src))
        src, dst, sim = src[by], dst[by].tolist(), sim[by]
        begin, end = np.searchsorted(src, np.arange(len(reps))).tolist(), np.searchsorted(src, np.arange(len(reps)), "right").tolist()
        sim = sim.tolist()
        ties: list[list[tuple[int, int]]] = [[] for _ in reps]  # of the similarity a class is at, its neighbours by their next member's id

        def nearest(c: int) -> int | None:
            heap = ties[c]
            while True:
                while heap:
                    at, k = heap[0]
                    if low[k] == high[k]:
                        heapq.heappop(heap)
                    elif ids[low[k]] != at:
                        heapq.heapreplace(heap, (ids[low[k]], k))
                    else:
                        return k
                if begin[c] == end[c]:
                    return None
                level = sim[begin[c]]
                while begin[c] < end[c] and sim[begin[c]] == level:
                    k = dst[begin[c]]
                    if low[k] < high[k]:
                        heap.append((ids[low[k]], k))
                    begin[c] += 1
                heapq.heapify(heap)

        return nearest

    return _visit(nodes, finder)


def _walk_rows(s: int, sim4: list[int]):
    """The function that walks one component by the cells (rep, cells) of its representatives, whose edges are not made: memory grows with its documents.

    sim4: of each number of matches the similarity, below 0 where it makes no edge.
    """
    table = np.array(sim4, np.int64)

    def walk(rows: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        def finder(reps: np.ndarray, ids: list[int], own: np.ndarray, n: np.ndarray, low: list[int], high: list[int]) -> Callable:
            lengths = [len(x) for x in rows["cells"]]
            owner, values = np.repeat(np.searchsorted(reps, rows["rep"].to_numpy()), lengths), np.concatenate(rows["cells"].to_numpy())
            cells = np.repeat(-1 - np.arange(len(reps), dtype=np.int32)[None], s, 0)  # holes match nothing; fingerprints have 31 bits at most
            cells[values >> 32, owner] = values & 0xFFFFFFFF
            own = np.where(own > 0, own, -1)
            live, part = np.arange(len(reps)), cells  # classes that may have members left
            ahead = np.array([ids[k] for k in low], np.int64)  # their next members' ids
            left = np.array(high) > np.array(low)

            def nearest(c: int) -> int | None:
                nonlocal live, part
                left[c] = low[c] < high[c]  # the class of the last visit: no other has changed
                if left[c]:
                    ahead[c] = ids[low[c]]
                ok = left[live]
                if 2 * np.count_nonzero(ok) < len(live):
                    live, part = live[ok], np.ascontiguousarray(part[:, ok])
                    ok = left[live]
                sim = table[(part == cells[:, c : c + 1]).sum(0, dtype=np.int32)]
                sim[live == c] = own[c]
                sim[~ok] = -1
                best = sim.max(initial=-1)
                if best < 0:
                    return None
                at = live[sim == best]
                return int(at[np.argmin(ahead[at])])

            return nearest

        return _visit(nodes, finder)

    return walk


def greedy_order(docs: DataFrame, e: DataFrame, most_edges: int = MOST_EDGES) -> DataFrame:
    """(new_gid, old_gid): start at the heaviest document, go to the best unvisited neighbour, else jump to the heaviest unvisited one.

    e: edges() of hits in both directions. class_order() does the same without edges among copies.
    """
    alone = docs.select("gid", F.col("gid").alias("rep"), F.lit(0).cast("long").alias("own4")).distinct()
    return _ordered(alone, cut(e.groupBy("src", "dst").agg(F.max("sim4").alias("sim4")), "edges"), node_weights(docs, e).select(F.col("idx").alias("rep"), F.lit(1).cast("long").alias("n"), "weight4"), most_edges)


def class_order(docs: DataFrame, c: DataFrame, hits: DataFrame, s: int, least: float, most_edges: int = MOST_EDGES, rows: DataFrame | None = None) -> DataFrame:
    """greedy_order() of all documents from classes c (gid, rep, n_cells) and hits between their representatives, in both directions, each once.

    Members of a class are as similar as their cells are many. Documents without a cell are in no class. rows: the representatives' written (gid, cells), by which
    components of many edges are walked.
    """
    m, members = min_matches(least, s), class_members(c, s, least)
    rest = docs.select("gid").distinct().join(members.select("gid"), "gid", "left_anti").select("gid", F.col("gid").alias("rep"), F.lit(0).cast("long").alias("own4"))
    members = cut(members.unionByName(rest), "members")
    e = cut(hits.where("qid <> rid").select(F.col("qid").alias("src"), F.col("rid").alias("dst"), F.bround(F.col("score") * 10000, 0).cast("long").alias("sim4")).where(F.col("sim4") >= least * 10000), "edges")
    walk = None
    if rows is not None:
        levels = docs.sparkSession.range(s + 1).select(F.col("id").alias("n"), _sim4(F.col("id"), s).alias("sim")).orderBy("n").collect()  # s + 1 rows
        walk = _walk_rows(s, [x["sim"] if x["n"] >= max(1, m) and x["sim"] >= least * 10000 else -1 for x in levels])
    return _ordered(members, e, class_weights(members, e), most_edges, rows, walk)


def _ordered(members: DataFrame, e: DataFrame, weights: DataFrame, most_edges: int, rows: DataFrame | None = None, walk: Callable | None = None) -> DataFrame:
    """The order of members (gid, rep, own4), from edges e (src, dst, sim4) between representatives, both directions, and weights (rep, n, weight4).

    A walk only jumps out of a component, and what it does in one depends on no other. So each component is walked in a task of its own, and the
    segments between jumps, sorted by their start's weight and id, highest first, are the whole walk. With `rows`, a component of many and dense edges, or of more
    than most_edges, is walked by its cells, and its edges do not move; without, one of more than most_edges edges or members is an error, not a cut.
    """
    part = cut(components(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), "parts").select(F.col("node").alias("rep"), "component"), "parts")
    nodes = cut(members.join(weights, "rep").join(part, "rep", "left").select("gid", "rep", "own4", "weight4", "component", "n"), "nodes")
    alone = nodes.where("component IS NULL AND n = 1").select("weight4", F.col("gid").alias("start"), F.lit(0).cast("long").alias("place"), F.col("gid").alias("node"))
    nodes = nodes.where("component IS NOT NULL OR n > 1").select("gid", "rep", "own4", "weight4", F.coalesce("component", "rep").alias("component"))
    degrees = e.groupBy(F.col("src").alias("rep")).agg(F.count("*").alias("degree"))
    held = degrees.join(part, "rep").groupBy("component").agg(F.sum("degree").alias("edges"), F.count("*").cast("double").alias("reps"))
    sizes = nodes.groupBy("component").agg(F.count("*").alias("members")).join(held, "component", "left")
    sizes = cut(sizes.select("component", "members", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("reps", F.lit(1.0)).alias("reps")), "walks")
    dense = (F.col("edges") > DENSE) & (F.col("edges") * SPARSE >= F.col("reps") * F.col("reps"))
    many = dense | ((F.col("edges") > 0) & (F.col("edges") + F.col("members") > most_edges))
    by_rows = cut(sizes.where(many if walk else F.lit(False)).select("component"), "by-rows")
    size = sizes.join(by_rows, "component", "left_anti").agg(F.max(F.col("edges") + F.col("members"))).first()[0] or 0
    if size > most_edges:
        raise ValueError(f"a component has {size} edges and documents, {most_edges} at most can be walked; raise the least similarity")
    kind, few = "weight4 long, start long, place long, node long", by_rows.count()
    if few:
        dense = _small(cut(part.join(by_rows, "component"), "dense"))
        at = rows.join(dense, F.col("gid") == F.col("rep")).select("component", "rep", "cells")
        heavy = at.groupBy("component").cogroup(nodes.join(by_rows, "component", "left_semi").groupBy("component")).applyInPandas(walk, kind)
        alone = alone.unionByName(heavy)
        e = e.join(dense.select(F.col("rep").alias("src")), "src", "left_anti")
        nodes = nodes.join(by_rows, "component", "left_anti")
    owned = e.join(part, F.col("src") == F.col("rep")).select("component", "src", "dst", "sim4")
    walked = owned.groupBy("component").cogroup(nodes.groupBy("component")).applyInPandas(_walk, kind)
    return numbered(walked.unionByName(alone), F.desc("weight4"), F.desc("start"), "place", name="new_gid").select("new_gid", F.col("node").alias("old_gid"))


def preview(order: DataFrame, n: int = 8) -> DataFrame:
    """The first n rows of an order."""
    return order.orderBy("new_gid").limit(n)


def reordered(sk: DataFrame, order: DataFrame) -> DataFrame:
    """The sketch with new ids."""
    rest = [c for c in sk.columns if c != "gid"]
    return sk.join(order, sk["gid"] == order["old_gid"]).select(F.col("new_gid").alias("gid"), *rest)
