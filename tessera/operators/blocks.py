"""Counts of all pairs, block of documents by block: documents move to the blocks that they meet, pairs of documents do not move."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells of a block, about, meetings that a task counts at once, rows that leave it together, and cells that may be looked up in a table.
CELLS, HITS, OUT, TABLE = 1 << 22, 1 << 21, 1 << 18, 1 << 24
#: Documents of a block at least, where blocks are made smaller to keep all tasks busy.
SMALL = 1024
#: Positions of a sketch at most, and documents of a block then, whose pairs leave list by list: so many ids as two bytes number. Pairs whose rows are compared together.
NARROW, IDS, ROWS = 128, 60_000, 1 << 13
#: A document's most frequent cells, by which documents are ordered.
MAIN = 8
#: Groups at most that are given a partition each.
PLACED = 1024


def block_parts(nq: int, nr: int, s: int, same: bool, tasks: int) -> tuple[int, int]:
    """Blocks of the query and of the reference table."""
    most = max(1, CELLS // max(s, 1))
    fit = lambda n, wanted: max(1, -(-n // most), min(-(-n // SMALL), wanted))
    if same:
        return (fit(nq, math.isqrt(4 * tasks) + 1),) * 2
    return fit(nq, 1), fit(nr, 2 * tasks)


class _Side:
    """A block: its classes of equal documents with their codes (int32 or int64) and members."""

    def __init__(self, gids: list[np.ndarray], rows: list[bytes], kind: np.dtype):
        found: dict[bytes, int] = {}
        of = np.fromiter((found.setdefault(x, len(found)) for x in rows), np.int64, len(rows))
        self.size = np.bincount(of, minlength=len(found))
        self.first = np.cumsum(self.size) - self.size
        self.gids = (np.concatenate(gids) if gids else np.empty(0, np.int64))[np.argsort(of, kind="stable")]
        self.n = np.array([len(x) // kind.itemsize for x in found], np.int64)
        self.codes = np.frombuffer(b"".join(found), kind)
        self.owner = np.repeat(np.arange(len(found), dtype=np.int32), self.n)


def _ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., n[0] places, then those of the next."""
    return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)


def _pieces(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive sizes that add up to `most` at most, or are one."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def _met(q: _Side, r: _Side, top: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(q's id, r's id, equal cells) of all members of two blocks with `least` equal cells or more, in pieces."""
    order = np.argsort(r.codes, kind="stable")
    owners = r.owner[order]
    if top <= TABLE:
        ends = np.cumsum(np.bincount(r.codes, minlength=top))
        hi = ends[q.codes]
        lo = hi - np.diff(ends, prepend=0)[q.codes]
    else:
        ranked = r.codes[order]
        lo, hi = np.searchsorted(ranked, q.codes), np.searchsorted(ranked, q.codes, "right")
    n = hi - lo
    cells = np.cumsum(q.n) - q.n
    for a, b in _pieces(np.bincount(q.owner, n, len(q.n)), HITS):
        part = slice(cells[a], cells[b - 1] + q.n[b - 1])
        width = max(1, len(r.n))
        kind = np.int32 if (b - a) * width < 1 << 31 else np.int64
        pair = np.repeat((q.owner[part] - a).astype(kind) * kind(width), n[part]) + owners[_ragged(lo[part], n[part])]
        pair.sort()
        at = np.flatnonzero(np.diff(pair, prepend=-1))
        found = np.diff(at, append=len(pair))
        at, found = at[found >= least], found[found >= least]
        x, y = np.divmod(pair[at].astype(np.int64), width)
        x += a
        for c, d in _pieces(r.size[y], OUT):
            of = np.repeat(np.arange(c, d), r.size[y[c:d]])
            rid, own, m = r.gids[_ragged(r.first[y[c:d]], r.size[y[c:d]])], x[of], found[of]
            copy = 0
            while len(own):  # a copy of q's documents at a time
                yield q.gids[q.first[own] + copy], rid, m
                copy += 1
                more = q.size[own] > copy
                rid, own, m = rid[more], own[more], m[more]


def _counter(top: int, kind: str, same: bool, least: int):
    """The function that counts the pairs of a group (i, j) of rows (i, j, side, gid, codes)."""
    code = np.dtype(kind)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gids, rows = ([], []), ([], [])
        for batch in batches:
            side = np.asarray(batch.column("side"))
            for k in (0, 1):
                at = pa.array(side == k)
                gids[k].append(np.asarray(batch.column("gid").filter(at)))
                rows[k].extend(batch.column("codes").filter(at).to_pylist())
        within = same and key[0].as_py() == key[1].as_py()
        q = _Side(gids[0], rows[0], code)
        r = q if within else _Side(gids[1], rows[1], code)
        out = lambda x: pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in x], ["qid", "rid", "matches"])
        for qid, rid, m in _met(q, r, top, least):
            yield out((qid, rid, m))
            if same and not within:
                yield out((rid, qid, m))

    return run


def _coded(rows: DataFrame, base: int, kind: str) -> DataFrame:
    """(gid, codes): a row's cells as position times base plus fingerprint, in binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.column(1):
                x = np.asarray(row.values)
                made.append(((x >> 32) * base + (x & 0xFFFFFFFF)).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["gid", "codes"])

    return rows.select("gid", "cells").mapInArrow(run, "gid long, codes binary")


class _Matrix:
    """A block: its classes of equal documents, a row of fingerprints and one each, 0 for holes, with their members. Classes that share frequent cells lie together."""

    def __init__(self, gids: list[np.ndarray], rows: list[bytes], kind: np.dtype, s: int):
        found: dict[bytes, int] = {}
        of = np.fromiter((found.setdefault(x, len(found)) for x in rows), np.int64, len(rows))
        cells = np.frombuffer(b"".join(found), kind).reshape(-1, s)
        order = _together(cells)
        of = np.argsort(order)[of]
        self.size = np.bincount(of, minlength=len(found))
        self.first = np.cumsum(self.size) - self.size
        self.gids = (np.concatenate(gids) if gids else np.empty(0, np.int64))[np.argsort(of, kind="stable")]
        self.single = self.gids[self.first]
        self.cells = np.zeros((len(found), -(-s // 64) * 64), kind)
        self.cells[:, :s] = cells[order]


def _together(cells: np.ndarray) -> np.ndarray:
    """An order of rows by their most frequent cells: those that leave a list together, as an earlier one had them, are neighbours in it."""
    codes = cells + (np.arange(cells.shape[1]) << 32)
    _, of, n = np.unique(codes, return_inverse=True, return_counts=True)
    rank = np.argsort(np.argsort(-n, kind="stable"))
    ranks = np.sort(np.where(cells == 0, len(n), rank[of.reshape(cells.shape)]), 1)[:, :MAIN]
    return np.lexsort(ranks.T[::-1])


def _members(q: _Matrix, r: _Matrix, x: np.ndarray, y: np.ndarray, found: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of classes to pairs of their members' ids, in pieces; those of single documents first."""
    n = q.size[x] * r.size[y]
    one = np.flatnonzero(n == 1)
    yield q.single[x[one]], r.single[y[one]], found[one]
    several = np.flatnonzero(n > 1)
    x, y, found, n = x[several], y[several], found[several], n[several]
    for a, b in _pieces(n, OUT):
        for c in range(0, int(n[a:b].sum()), OUT):  # one pair of classes may be more than a piece
            size = min(OUT, n[a] - c) if b - a == 1 else n[a:b]
            of = np.repeat(np.arange(a, b), size)
            copy, other = np.divmod(c + _ragged(np.zeros(b - a, np.int64), np.atleast_1d(size)), r.size[y[of]])
            yield q.gids[q.first[x[of]] + copy], r.gids[r.first[y[of]] + other], found[of]


def _listed(q: _Matrix, r: _Matrix, s: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(q's id, r's id, equal cells) of all members of two blocks with any equal cell, in pieces: list by list.

    A list is the documents with a fingerprint at a position. A pair leaves with the first list that has both; its rows are compared there, and at each later one that
    has both, so nothing is kept. As a list's ids follow each document of it, files of the pairs are compressed to a part of what the same pairs take in order of their ids.
    """
    holes = np.where(q.cells == 0, np.iinfo(q.cells.dtype).max, q.cells)  # match nothing
    words = holes.shape[1] // 64
    for pos in range(s):
        word, below = pos >> 6, np.uint64((1 << (pos & 63)) - 1)
        x, y = (np.argsort(k.cells[:, pos], kind="stable").astype(np.int32) for k in (q, r))
        x, ranked = x[np.count_nonzero(q.cells[:, pos] == 0) :], r.cells[y, pos]
        lo, hi = np.searchsorted(ranked, q.cells[x, pos]), np.searchsorted(ranked, q.cells[x, pos], "right")
        met = np.flatnonzero(hi > lo)
        x, lo, n = x[met], lo[met].astype(np.int32), (hi - lo)[met].astype(np.int32)
        for a, b in _pieces(n, max(1, HITS >> 4)):
            begins = np.cumsum(n[a:b], dtype=np.int32) - n[a:b]
            left = np.repeat(x[a:b], n[a:b])
            right = y[np.repeat(lo[a:b] - begins, n[a:b]) + np.arange(len(left), dtype=np.int32)]
            equal = np.empty((words, len(left)), np.uint64)
            for c in range(0, len(left), ROWS):
                same = holes.take(left[c : c + ROWS], 0, mode="clip") == r.cells.take(right[c : c + ROWS], 0, mode="clip")
                equal[:, c : c + ROWS] = np.packbits(same.reshape(-1), bitorder="little").view(np.uint64).reshape(-1, words).T
            first = (equal[word] & below) == 0
            for w in equal[:word]:
                first &= w == 0
            first = np.flatnonzero(first)
            found = sum(np.bitwise_count(w[first]).astype(np.int64) for w in equal)
            yield from _members(q, r, left[first], right[first], found)


def _lister(kind: str, s: int, half: bool):
    """The function that counts the pairs of a group of rows (i, j, side, gid, row)."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gids, rows = ([], []), ([], [])
        for batch in batches:
            side = np.asarray(batch.column("side"))
            for k in (0, 1):
                at = pa.array(side == k)
                gids[k].append(np.asarray(batch.column("gid").filter(at)))
                rows[k].extend(batch.column("row").filter(at).to_pylist())
        q, r = (_Matrix(gids[k], rows[k], np.dtype(kind), s) for k in (0, 1))
        for out in _listed(q, r, s):
            if half:
                kept = out[0] <= out[1]
                out = [x[kept] for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["qid", "rid", "matches"])

    return run


def _filled(rows: DataFrame, kind: str, s: int) -> DataFrame:
    """(gid, row): a row's fingerprints and one each, 0 for holes, in binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.column(1):
                x, full = np.asarray(row.values), np.zeros(s, kind)
                full[x >> 32] = (x & 0xFFFFFFFF) + 1
                made.append(full.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["gid", "row"])

    return rows.select("gid", "cells").mapInArrow(run, "gid long, row binary")


def _places(spark: SparkSession, groups: int) -> list[int]:
    """For each group j a number i, so that the hash of both deals every group to a partition of its own: else some tasks have several, others none, and a file more ids than two bytes number."""
    tried = spark.range(16 * groups * groups).select((F.col("id") % groups).cast("int").alias("j"), F.floor(F.col("id") / groups).cast("int").alias("i"))
    found = tried.where(F.pmod(F.hash("i", "j"), F.lit(groups)) == F.col("j")).groupBy("j").agg(F.min("i").alias("i")).collect()
    return [dict(map(tuple, found)).get(j, 0) for j in range(groups)]


def list_parts(n: int, tasks: int) -> tuple[int, int]:
    """Blocks of a table of n documents as queries and as references for _listed()."""
    pr = max(1, -(-n // IDS))
    return max(pr, min(-(-n // SMALL), -(-2 * tasks // pr))), pr


def _list_counts(rows: DataFrame, n: int, s: int, base: int, half: bool) -> DataFrame:
    """block_counts() of one table of narrow sketches, for any number of matches: its blocks as queries meet its blocks as references."""
    spark = rows.sparkSession
    kind = "uint16" if base < (1 << 16) - 1 else "uint32"
    pq, pr = list_parts(n, spark.sparkContext.defaultParallelism)
    block = lambda parts: F.pmod(F.xxhash64("gid", F.lit("block")), F.lit(parts)).cast("int")
    others = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    filled = _filled(rows, kind, s)
    left = filled.select(F.lit(0).alias("side"), "gid", "row", block(pq).alias("a"), others(pr).alias("b"))
    right = filled.select(F.lit(1).alias("side"), "gid", "row", others(pq).alias("a"), block(pr).alias("b"))
    j = F.col("a") * pr + F.col("b")
    i = F.get(F.lit(_places(spark, pq * pr)), j) if pq * pr <= PLACED else F.lit(0)
    dealt = left.unionByName(right).select(i.alias("i"), j.alias("j"), "side", "gid", "row")
    return dealt.repartition(pq * pr, "i", "j").groupBy("i", "j").applyInArrow(_lister(kind, s, half), "qid long, rid long, matches long")


def block_counts(query: DataFrame, ref: DataFrame, shapes: tuple[tuple[int, int, int], tuple[int, int, int]], least: int = 1, half: bool = False) -> DataFrame:
    """(qid, rid, matches) of all pairs of written rows (gid, cells) with `least` equal cells or more, one at least. Of one table (query is ref) both directions and each document with itself.

    shapes: documents, positions and fingerprints of both tables. Both are dealt to blocks of about CELLS cells; two blocks meet in a task, which has no more than
    both and a piece of their pairs at once, and whose pairs are whole. A document moves once for each block of the other table, in some 4 bytes a cell. Documents with
    equal cells meet as one. half: only pairs with qid <= rid. Where all pairs of one table of narrow sketches are wanted, they leave list by list, see _listed().
    """
    (nq, sq, fq), (nr, sr, fr) = shapes
    same, s, base = query is ref, max(sq, sr), max(fq, fr, 1)
    if same and least <= 1 and 0 < s <= NARROW:
        return _list_counts(query, nq, s, base, half)
    kind = "int32" if s * base < 1 << 31 else "int64"
    pq, pr = block_parts(nq, nr, s, same, query.sparkSession.sparkContext.defaultParallelism)
    block = lambda parts: F.pmod(F.xxhash64("gid", F.lit("block")), F.lit(parts)).cast("int")
    others = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    def dealt(rows: DataFrame, own: int, parts: int, i: Column, j: Column, side: Column) -> DataFrame:
        return _coded(rows, base, kind).select("gid", "codes", block(own).alias("b")).select("gid", "codes", "b", others(parts).alias("o")).select(i.alias("i"), j.alias("j"), side.alias("side"), "gid", "codes")

    b, o = F.col("b"), F.col("o")
    if same:
        rows = dealt(query, pq, pq, F.least(b, o), F.greatest(b, o), (b > o).cast("int"))
    else:
        rows = dealt(query, pq, pr, b, o, F.lit(0)).unionByName(dealt(ref, pr, pq, o, b, F.lit(1)))
    groups = pq * (pq + 1) // 2 if same else pq * pr
    found = rows.repartition(groups, "i", "j").groupBy("i", "j").applyInArrow(_counter(s * base, kind, same, max(1, least)), "qid long, rid long, matches long")
    return found.where("qid <= rid") if half else found
