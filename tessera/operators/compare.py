"""Comparison of sketches: an equi-join on position and fingerprint, counted for each pair.

A sketch is a table of cells (gid, pos, fp) or of rows (gid, cells), see sketch(). Everything here takes both.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.u64 import np_fmix64
from ..sources.work import cut, numbered
from .blocks import block_counts, block_parts
from .groups import BROADCAST, group_pairs, n_words, words_of

#: Documents that tell which cells are frequent, at least this number and this share, and cells that are remembered as such, at most. They split
#: work, and change no result.
SAMPLE, SHARE, FREQUENT = 1000, 1 / 1024, 1 << 16
#: References of a block of a matrix, and blocks whose lists of ids are broadcast at most.
COLUMNS, COLUMN_BLOCKS = 4096, 1024
#: Documents of a cell that meet in one task, about.
MEETING = 1 << 14
#: Positions of a key at most, where groups are not whole, keys of a document then, what a chance meeting costs in keys, and keys' cells that a task mixes at once.
MOST_TOGETHER, MOST_SETS, MEET_COST, KEYS = 4, 2048, 8, 1 << 20
#: What moving a document to a block, and a meeting in a block, cost in keys.
MOVE_COST, HIT_COST = 32, 2


def min_matches(threshold: float, s: int) -> int:
    return math.ceil(threshold * s) if threshold > 0 else 0


def is_rows(sk: DataFrame) -> bool:
    return "cells" in sk.columns


def as_cells(sk: DataFrame) -> DataFrame:
    """(gid, cell), one row a cell."""
    if is_rows(sk):
        return sk.select("gid", F.explode("cells").alias("cell"))
    if "cell" in sk.columns:
        return sk.select("gid", "cell")
    return sk.select("gid", F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("fp")).alias("cell"))


def as_positions(sk: DataFrame) -> DataFrame:
    """(gid, pos, fp), one row a cell."""
    if not is_rows(sk):
        return sk.select("gid", "pos", "fp")
    return as_cells(sk).select("gid", F.shiftright("cell", 32).cast("int").alias("pos"), F.col("cell").bitwiseAND((1 << 32) - 1).alias("fp"))


def as_rows(sk: DataFrame) -> DataFrame:
    """(gid, cells), one row a document; cells ascend."""
    if is_rows(sk):
        return sk.select("gid", "cells")
    return as_cells(sk).groupBy("gid").agg(F.array_sort(F.collect_list("cell")).alias("cells"))


def first_positions(sk: DataFrame, s: int, n: int) -> tuple[DataFrame, int]:
    """The sketch cut to its first n positions, and the number of positions it then has; 0 or too many: all."""
    if not 0 < n < s:
        return sk, s
    if is_rows(sk):
        few = sk.select("gid", F.filter("cells", lambda c: c < n << 32).alias("cells"))
        return few.where(F.size("cells") > 0), n
    return sk.where(F.col("pos") < n), n


def classes(sk: DataFrame) -> DataFrame:
    """(gid, rep, n_cells): documents whose sketches are equal throughout share the least id. Copies then meet once, not pair by pair.

    A sketch's signature is the number of its cells and two 64-bit values: of a table of cells XORs of hashes, which do not depend on the cells' order, else hashes of the row.
    """
    key = ["n_cells", "x1", "x2"]
    if is_rows(sk):
        whole = sk.select("gid", F.size("cells").cast("long").alias("n_cells"), *[F.xxhash64(F.lit(seed), "cells").alias(f"x{seed}") for seed in (1, 2)])
    else:
        signs = [F.bit_xor(F.xxhash64(F.lit(seed), "pos", "fp")).alias(f"x{seed}") for seed in (1, 2)]
        whole = sk.groupBy("gid").agg(F.count("*").alias("n_cells"), *signs)
    return whole.join(whole.groupBy(*key).agg(F.min("gid").alias("rep")), key).select("gid", "rep", "n_cells")


def representatives(sk: DataFrame, c: DataFrame) -> DataFrame:
    """The sketches of the classes' representatives; c is written. Only ids of other members move, if they are BROADCAST at most; else the joined rows are written."""
    others = c.where("gid <> rep").select("gid")
    if others.count() <= BROADCAST:
        return sk.where("gid IS NOT NULL").join(F.broadcast(others), "gid", "left_anti")
    return cut(sk.join(c.where("gid = rep").select("gid"), "gid", "left_semi"), "representatives")


def _several(c: DataFrame) -> DataFrame:
    """(gid, rep) of the classes of more than one member; broadcast, if they have BROADCAST members at most."""
    several = cut(c.join(c.where("gid <> rep").select("rep").distinct(), "rep", "left_semi").select("gid", "rep"), "copies")
    return F.broadcast(several) if several.count() <= BROADCAST else several


def spread(found: DataFrame, cq: DataFrame, cr: DataFrame) -> DataFrame:
    """Pairs (qid, rid, matches) of representatives, spread over the members of their classes. Only classes of several members are joined, so the pairs seldom move."""
    q = _several(cq)
    r = q if cq is cr else _several(cr)
    out = found.join(q.select(F.col("gid").alias("q"), F.col("rep").alias("qid")), "qid", "left").join(r.select(F.col("gid").alias("r"), F.col("rep").alias("rid")), "rid", "left")
    return out.select(F.coalesce("q", "qid").alias("qid"), F.coalesce("r", "rid").alias("rid"), "matches")


def frequent_cells(*sketches: DataFrame) -> list[tuple[int, int]]:
    """(cell, documents) of the cells that several documents of a small sample hold, most frequent first, scaled up to all documents.

    The sample is chosen by a hash of the id. At most FREQUENT cells come to the driver.
    """
    found: dict[int, float] = {}
    for sk in sketches:
        n = sk.count() if is_rows(sk) else sk.agg(F.approx_count_distinct("gid")).first()[0]
        share = min(1.0, max(SHARE, SAMPLE / max(n, 1)))
        some = as_cells(sk.where(F.pmod(F.xxhash64(F.col("gid"), F.lit("frequent")), F.lit(1_000_000)) < share * 1_000_000))
        for r in some.groupBy("cell").count().where("count > 1").orderBy(F.desc("count"), "cell").limit(FREQUENT).collect():
            found[r[0]] = found.get(r[0], 0) + r[1] / share
    return [(cell, int(n)) for cell, n in sorted(found.items(), key=lambda x: (-x[1], x[0]))]


def meetings(a: DataFrame, b: DataFrame, frequent: list[tuple[int, int]], most: int = MEETING) -> DataFrame:
    """a (cell, qid, ...) joined with b (cell, rid, ...) on the cell.

    A cell of more than about `most` documents is dealt: a's and b's documents are each split in parts, and each pair of parts meets in a key of its own. A
    pair of documents meets once, and no task has all pairs of a cell.
    """
    hot = [(cell, -(-n // most)) for cell, n in frequent if n > most]
    if not hot:
        return a.join(b, "cell")
    parts = F.broadcast(a.sparkSession.createDataFrame(hot, "cell long, parts long"))  # FREQUENT rows at most
    others = lambda: F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    part = lambda gid: F.pmod(F.xxhash64(gid), F.col("parts"))
    left = a.join(parts, "cell").select(*a.columns, part("qid").alias("i"), others().alias("j"))
    right = b.join(parts, "cell").select(*b.columns, part("rid").alias("j"), others().alias("i"))
    dealt = left.join(right, ["cell", "i", "j"]).drop("i", "j")
    cold = a.join(parts, "cell", "left_anti").join(b.join(parts, "cell", "left_anti"), "cell")
    return cold.unionByName(dealt)


def _written(sk: DataFrame) -> DataFrame:
    """The sketch as rows that are read again: those of a table are, cells are put together first."""
    return sk.select("gid", "cells") if is_rows(sk) else cut(as_rows(sk), "rows")


def pair_counts(query: DataFrame, ref: DataFrame, least: int = 1, half: bool = False) -> DataFrame:
    """(qid, rid, matches): number of positions in which both have the same fingerprint, for all pairs that have any, or `least` of them. half: only pairs with qid <= rid.

    Blocks of documents meet, see block_counts(): the pairs, which chance makes nearly as many as the square of the documents, are never shuffled.
    """
    q = _written(query)
    r = q if query is ref else _written(ref)
    shape = _shape(q)
    return block_counts(q, r, (shape, shape if query is ref else _shape(r)), least, half)


def scored(pairs: DataFrame, s: int, threshold: float = 0.0) -> DataFrame:
    """(qid, rid, matches, score) of the pairs with enough matches; the score's base is all positions."""
    return pairs.where(F.col("matches") >= min_matches(threshold, s)).withColumn("score", F.col("matches") / F.lit(float(s)))


def compare(query: DataFrame, ref: DataFrame, s: int, threshold: float = 0.0) -> DataFrame:
    """All against all; a document that is in both meets itself. With a threshold above 0 keys meet, see prefix_compare(), unless blocks of documents cost less, as for few queries."""
    m = min_matches(threshold, s)
    if m <= 1:
        return scored(pair_counts(query, ref), s, threshold)
    same = query is ref
    q = _written(query)
    r = q if same else _written(ref)
    if not same and m <= s:
        (nq, _, fq), (nr, _, fr) = shapes = _shape(q), _shape(r)
        bits, (pq, pr) = _bits(fq, fr), block_parts(nq, nr, s, False, 1)
        if MOVE_COST * (nq * pr + nr * pq) + HIT_COST * nq * nr * s / 2.0**bits < key_sets(m, s, bits, nq * nr, nq + nr)[1]:
            return scored(block_counts(q, r, shapes, m), s, threshold)
    return prefix_compare(q, r, s, threshold)


def compare_self(sk: DataFrame, s: int, threshold: float = 0.0) -> DataFrame:
    """All against all of one table, both directions, without a document's hit on itself."""
    return compare(sk, sk, s, threshold).where("qid <> rid")


def _whole_groups(m: int, s: int) -> list[list[int]]:
    """The s positions in s - m + 1 groups: two documents that match in m positions differ in too few to spoil every group."""
    at = np.arange(s)
    return [x.tolist() for x in np.split(at, np.flatnonzero(np.diff(at * (s - m + 1) // s)) + 1)]


def _bits(*fingerprints: int) -> int:
    """Bits of fingerprints below the least of these numbers."""
    return max(1, min(fingerprints) - 1).bit_length()


def key_sets(m: int, s: int, bits: int, pairs: float, documents: float) -> tuple[list[list[int]], float]:
    """Sets of positions, and what they cost, such that two documents that match in m of s positions match throughout one of the sets.

    Either whole groups (_whole_groups), or all sets of t positions of (m - 1) / (t - 1) groups at most: with t - 1 matches at most in each group there would
    be less than m in all. Chance makes t fingerprints of some bits equal once in 2 ** (t * bits) pairs, so the sets grow with the tables: that t is taken
    whose keys and chance meetings, of `documents` in `pairs`, cost least.
    """
    best = _whole_groups(m, s)
    meetings = lambda sets, t: pairs * sets / 2.0 ** (t * bits)
    cost = len(best) * documents + MEET_COST * sum(meetings(1, len(x)) for x in best)
    for t in range(2, MOST_TOGETHER + 1):
        groups = min((m - 1) // (t - 1), s // t)
        if not groups:
            break
        at = np.arange(s)
        split = [x.tolist() for x in np.split(at, np.flatnonzero(np.diff(at * groups // s)) + 1)]
        n = sum(math.comb(len(x), t) for x in split)
        if n <= MOST_SETS and n * documents + MEET_COST * meetings(n, t) < cost:
            cost = n * documents + MEET_COST * meetings(n, t)
            best = [list(c) for x in split for c in itertools.combinations(x, t)]
    return best, cost


def _keys(sets: list[list[int]], s: int):
    """Rows (gid, cells) to rows (gid, cell, w0, ...): a key for each set of positions of which the document has all cells, and n_words() words of the document.

    A key is a 64-bit sum of mixed cells; where two differ in their cells and not in their sums, a pair is looked at in vain. Words hold two bits of each fingerprint.
    """
    width = max(map(len, sets))
    at = np.array([x + [s] * (width - len(x)) for x in sets], np.int64)  # place s is filled in every document and adds nothing
    most, words = max(1, KEYS // at.size), n_words(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                gids, rows = np.asarray(batch.column(0).slice(lo, most)), batch.column(1).slice(lo, most)
                values, n = np.asarray(rows.flatten()), np.asarray(pa.compute.list_value_length(rows))
                owner = np.repeat(np.arange(len(n)), n)
                mixed, has = np.zeros((len(n), s + 1), np.uint64), np.zeros((len(n), s + 1), bool)
                mixed[owner, values >> 32], has[owner, values >> 32], has[:, s] = np_fmix64(values.view(np.uint64)), True, True
                doc, k = np.nonzero(has[:, at].all(2))
                keys = mixed[:, at].sum(2)[doc, k]
                held = [pa.array(w[doc].view(np.int64)) for w in words_of(owner, values >> 32, values, len(n), words)]
                yield pa.RecordBatch.from_arrays([pa.array(gids[doc], pa.int64()), pa.array(keys.view(np.int64)), *held], ["gid", "cell", *[f"w{i}" for i in range(words)]])

    return run


def _shape(rows: DataFrame) -> tuple[int, int, int]:
    """Documents of a table of rows, positions, and fingerprints: one more than the highest of each."""
    r = rows.agg(F.count("*"), F.max(F.shiftright(F.array_max("cells"), 32)), F.max(F.array_max(F.transform("cells", lambda c: c.bitwiseAND((1 << 32) - 1))))).first()
    return r[0], (-1 if r[1] is None else r[1]) + 1, (-1 if r[2] is None else r[2]) + 1


def near_pairs(q: DataFrame, r: DataFrame, s: int, m: int, whole: bool = False, fold: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(qid, rid, matches), whole: and both, the cells that both have: pairs of written rows that match in m or more of s positions. Of one table (q is r) each pair once, qid < rid.

    fold: a function of pairs' equal positions, a row of truth values each; its numbers, m at least, are the matches then.
    """
    same = q is r
    q = q.where(F.size("cells") >= m)
    r = q if same else r.where(F.size("cells") >= m)
    shapes = (_shape(q),) * 2 if same else (_shape(q), _shape(r))
    (nq, _, fq), (nr, _, fr) = shapes
    if m > s or not nq or not nr:
        both = [F.col("cells").alias("both")] if whole else []
        return q.select(F.col("gid").alias("qid"), F.col("gid").alias("rid"), F.size("cells").cast("long").alias("matches"), *both).limit(0)
    n = nq if same else nq + nr
    sets, _ = key_sets(m, s, _bits(fq, fr), nq * nr / (2 if same else 1), n)
    kind = "gid long, cell long" + "".join(f", w{i} long" for i in range(n_words(s)))
    keys = q.mapInArrow(_keys(sets, s), kind).withColumn("side", F.lit(0))
    if not same:
        keys = keys.unionByName(r.mapInArrow(_keys(sets, s), kind).withColumn("side", F.lit(1)))
    return group_pairs(keys, q, r, shapes, s, m, n * len(sets), whole, fold)


def prefix_compare(query: DataFrame, ref: DataFrame, s: int, threshold: float) -> DataFrame:
    """compare(), for any threshold above 0, exactly: two documents that match in m of s positions match throughout one of the sets of key_sets().

    Only keys of such sets meet, which chance seldom makes equal. The whole rows of two documents that share a key decide, see group_pairs().
    """
    m = max(1, min_matches(threshold, s))
    return scored(near_classes(query, ref, s, m), s, threshold)


def class_pairs(sk: DataFrame, s: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Written classes (gid, rep, n_cells) of one table, and (qid, rid, matches) of the pairs of representatives with enough matches, one at least: each pair once, qid < rid.

    What compare_self() lists, without the pairs among copies, and not written: who only counts or ranks a document's pairs moves none of them.
    """
    rows = _written(sk)
    c = cut(classes(rows), "classes")
    reps = representatives(rows, c)
    return c, near_pairs(reps, reps, s, max(1, min_matches(threshold, s)))


def _own(rows: DataFrame, s: int, m: int, fold: Callable[[np.ndarray], np.ndarray] | None) -> DataFrame:
    """(qid, rid, matches) of each row with itself, for m matches or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, KEYS // s)
        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                gids, cells = batch.column(0).slice(lo, most), batch.column(1).slice(lo, most)
                has = np.zeros((len(gids), s), bool)
                has[np.repeat(np.arange(len(gids)), np.asarray(pa.compute.list_value_length(cells))), np.asarray(cells.flatten()) >> 32] = True
                n = fold(has) if fold else has.sum(1)
                gids = gids.filter(pa.array(n >= m))
                yield pa.RecordBatch.from_arrays([gids, gids, pa.array(n[n >= m], pa.int64())], ["qid", "rid", "matches"])

    return rows.select("gid", "cells").mapInArrow(run, "qid long, rid long, matches long")


def near_classes(query: DataFrame, ref: DataFrame, s: int, m: int, fold: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(qid, rid, matches) of all pairs that match in m or more of s positions, m at least by `fold`, see near_pairs()."""
    same = query is ref
    q = _written(query)
    r = q if same else _written(ref)
    cq = cut(classes(q), "classes")
    cr = cq if same else cut(classes(r), "classes")
    qs = representatives(q, cq)
    rs = qs if same else representatives(r, cr)
    found = near_pairs(qs, rs, s, m, fold=fold)
    if same:
        found = cut(found, "found")
        found = found.unionByName(found.select(F.col("rid").alias("qid"), F.col("qid").alias("rid"), "matches")).unionByName(_own(qs, s, m, fold))
    return spread(found, cq, cr)


def totals(hits: DataFrame, queries: DataFrame, refs: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(mode, total): scores that a sparse report of the hits lists, and cells of a matrix that are at least the threshold: all of them if it is 0 or less."""
    sparse = hits.agg(F.lit("sparse").alias("mode"), F.count("*").alias("total"))
    if threshold > 0:
        return sparse.unionByName(hits.where(F.col("score") >= threshold).agg(F.lit("matrix").alias("mode"), F.count("*").alias("total")))
    ids = queries.select(F.col("gid").alias("q")).agg(F.countDistinct("q").alias("n")).crossJoin(refs.select(F.col("gid").alias("r")).agg(F.countDistinct("r").alias("m")))  # one row each
    return sparse.unionByName(ids.select(F.lit("matrix").alias("mode"), (F.col("n") * F.col("m")).alias("total")))


def decimals4(x: Column) -> Column:
    """Four decimals, exact ties to the even digit."""
    return F.format_number(x, 4)


def sparse_lines(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, line): 'query_<q>' and, after a tab, 'r:score' by falling matches, then id; queries without hits have an empty list."""
    listed = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("matches")).alias("m"), "rid", "score"))).alias("l"))
    text = F.concat_ws(",", F.transform("l", lambda h: F.concat_ws(":", h["rid"].cast("string"), decimals4(h["score"]))))
    return queries.select(F.col("gid").alias("qid")).distinct().join(listed, "qid", "left").select("qid", F.concat(F.lit("query_"), F.col("qid").cast("string"), F.lit("\t"), F.coalesce(text, F.lit(""))).alias("line"))


def _grid(hits: DataFrame, queries: DataFrame, refs: DataFrame, threshold: float) -> DataFrame:
    """(qid, block, rids, scores): every query's row of the matrix in blocks of COLUMNS references, by id; scores (place in the block -> score) of its hits.

    References are numbered; a block's list goes to the queries' blocks, whose hits, a map each, are put in their places. No row or list is as long as the references are many.
    """
    block = F.floor(F.col("place") / COLUMNS).alias("block")
    places = numbered(refs.select(F.col("gid").alias("rid")).distinct(), "rid", name="place")
    places = cut(places, "references")
    lists = cut(places.groupBy(block).agg(F.array_sort(F.collect_list("rid")).alias("rids")), "columns")
    n = lists.count()
    scored = hits.where(F.col("score") >= threshold).select("qid", "rid", "score").join(places, "rid")
    maps = scored.groupBy("qid", block).agg(F.map_from_entries(F.collect_list(F.struct((F.col("place") % COLUMNS).cast("int").alias("at"), "score"))).alias("scores"))
    rows = queries.select(F.col("gid").alias("qid")).distinct().select("qid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("block")) if n else queries.limit(0).select(F.col("gid").alias("qid"), F.lit(0).cast("long").alias("block"))
    lists = F.broadcast(lists) if n <= COLUMN_BLOCKS else lists
    return rows.join(maps, ["qid", "block"], "left").join(lists, "block")


def matrix(hits: DataFrame, queries: DataFrame, refs: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(qid, rid, score) for every query and reference; below the threshold 0. As large as the product: that is the report."""
    cells = _grid(hits, queries, refs, threshold).select("qid", "scores", F.posexplode("rids").alias("at", "rid"))
    return cells.select("qid", "rid", F.coalesce(F.element_at("scores", F.col("at")), F.lit(0.0)).alias("score"))


def matrix_lines(hits: DataFrame, queries: DataFrame, refs: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(qid, line) of a matrix, references in id order. Blocks are written first; a line is put together from its blocks' texts."""
    text = F.array_join(F.transform("rids", lambda _, i: F.coalesce(decimals4(F.element_at("scores", i)), F.lit("0.0000"))), ",")
    parts = _grid(hits, queries, refs, threshold).select("qid", F.struct("block", text.alias("text")).alias("part")).groupBy("qid").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return parts.select("qid", F.concat(F.lit("query_"), F.col("qid").cast("string"), F.lit("\t"), F.array_join(F.transform("parts", lambda p: p["text"]), ",")).alias("line"))
