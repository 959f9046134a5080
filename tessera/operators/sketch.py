"""One-permutation MinHash sketches: bucket minima of k-mer hashes, densified, cut to fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kmers import many_kmer_hashes
from ..functions.u64 import np_fmix64, np_xorshift_star, unsigned_min

#: Cells, and letters, that a task handles at once; letters of a digest.
CELLS, LETTERS, DIGESTED = 1 << 18, 1 << 20, 1 << 17


@dataclass(frozen=True)
class SketchParams:
    """k-mer length, log2 of the number of positions, fingerprint bits, expected size, mode and whether holes are filled."""

    k: int = 31
    ls: int = 10
    w: int = 16
    e: int = 5_000_000
    mode: str = "default"
    densify: bool = True

    def __post_init__(self):
        if not (self.k >= 1 and 0 <= self.ls <= 20 and 1 <= self.w <= 31 and self.mode in ("default", "perfect")):
            raise ValueError(f"bad sketch parameters: {self}")

    @property
    def s(self) -> int:
        return 1 << self.ls

    def agrees(self, other: SketchParams) -> bool:
        same = (self.k, self.ls, self.w, self.mode) == (other.k, other.ls, other.w, other.mode)
        return same and (self.mode != "perfect" or self.e == other.e)


def bucket_minima(hashes: np.ndarray, ls: int, owner: np.ndarray | None = None, owners: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(cells, filled): for each position the least raw hash of its bucket; with owners, one row each."""
    cells = np.full(owners << ls, np.uint64(0xFFFFFFFFFFFFFFFF))
    filled = np.zeros(owners << ls, bool)
    if len(hashes):
        at = (np_fmix64(hashes) >> np.uint64(64 - ls)).astype(np.int64) if ls else np.zeros(len(hashes), np.int64)
        if owner is not None:
            at += owner << ls
        np.minimum.at(cells, at, hashes)
        filled[at] = True
    return (cells, filled) if owner is None else (cells.reshape(owners, -1), filled.reshape(owners, -1))


def densify(cells: np.ndarray, filled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fills holes from filled cells, in rounds; a round in which no cell points at a hole is the last. Rows are sketches of their own."""
    shape = cells.shape
    cells, filled = cells.reshape(-1, shape[-1]).copy(), filled.reshape(-1, shape[-1]).copy()
    size = shape[-1]
    mask = np.uint64(size - 1)
    going = np.flatnonzero(filled.any(1) & ~filled.all(1))
    c, f = cells[going], filled[going]
    # Where a cell points at in round t is (first + t * stride) modulo the size; copies point where their source does.
    first, stride = (np_fmix64(c) & mask).astype(np.int32), (np_xorshift_star(c) & mask).astype(np.int32)
    step = 0
    while len(going):
        row, col = np.nonzero(f)
        target = (first[row, col] + step * stride[row, col]) & np.int32(size - 1)
        hole = ~f[row, target]
        row, col, target = row[hole][::-1], col[hole][::-1], target[hole][::-1]  # of several, the lowest source is written last
        grown = np.zeros(len(going), bool)
        grown[row] = True
        for x in (c, first, stride):
            x[row, target] = x[row, col]
        f[row, target] = True
        done = ~grown | f.all(1)
        if done.any():
            cells[going[done]], filled[going[done]] = c[done], f[done]
            c, f, first, stride, going = (x[~done] for x in (c, f, first, stride, going))
        step = (step + 1) & (size - 1)
    return cells.reshape(shape), filled.reshape(shape)


def fingerprints(cells: np.ndarray, filled: np.ndarray, p: SketchParams) -> np.ndarray:
    """-1 for holes and for what does not fit into w bits."""
    out = np.full(cells.shape, -1, np.int64)
    h = cells[filled]
    if p.mode == "default":
        out[filled] = (h & np.uint64((1 << p.w) - 1)).astype(np.int64)
        return out
    x = ((2.0**32 - (h >> np.uint64(32)).astype(np.float64)) / 2.0**32) ** (p.e / p.s)
    r = float(1 << p.w)
    out[filled] = np.where(x <= 2.0**-114, -1, np.minimum(np.floor(r - r * x), r - 1)).astype(np.int64)
    return out


def _finished(ids: list[int], cells: np.ndarray, filled: np.ndarray, p: SketchParams, rows: bool = False) -> pa.RecordBatch:
    """(gid, pos, h, fp): the filled cells of many sketches, densified. rows: (gid, cells), see sketch()."""
    if p.densify:
        cells, filled = densify(cells, filled)
    fp = fingerprints(cells, filled, p)
    row, pos = np.nonzero(fp >= 0)
    if rows:
        owner, first = np.unique(row, return_index=True)
        values = pa.array(pos.astype(np.int64) << 32 | fp[row, pos])
        return pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[owner]), pa.ListArray.from_arrays(pa.array([*first, len(row)], pa.int32()), values)], ["gid", "cells"])
    return pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[row]), pa.array(pos.astype(np.int32)), pa.array(cells[row, pos].view(np.int64)), pa.array(fp[row, pos])], ["gid", "pos", "h", "fp"])


def _groups(batches: Iterator[pa.RecordBatch], p: SketchParams) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(ids, cells, filled) of rows (gid, seq), so many at once as fit into bounded arrays."""
    most = max(1, CELLS >> p.ls)
    for batch in batches:
        ids, seqs, size = [], [], 0
        rows = zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
        for gid, seq in rows:
            ids.append(gid)
            seqs.append(seq.as_py())
            size += len(seqs[-1] or "")
            if size >= LETTERS or len(ids) >= most:
                owner, h = many_kmer_hashes(seqs, p.k)
                yield ids, *bucket_minima(h, p.ls, owner, len(ids))
                ids, seqs, size = [], [], 0
        if ids:
            owner, h = many_kmer_hashes(seqs, p.k)
            yield ids, *bucket_minima(h, p.ls, owner, len(ids))


def unique_ids(docs: DataFrame, id_col: str = "gid") -> bool:
    return not docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").take(1)


def sketch(docs: DataFrame, p: SketchParams, id_col: str = "gid", seq_col: str = "seq", unique: bool | None = None, rows: bool = False) -> DataFrame:
    """(gid, pos, h, fp), one row a filled cell. Rows of one id are one document; k-mers do not span rows.

    rows: instead (gid, cells), one row a document with any cell; a cell is its position, shifted left by 32 bits, and its fingerprint. Cells ascend.

    A null sequence, or one without a k-mer, gives no rows. Where ids are unique (None: that is looked up), documents are sketched whole in
    a task and nothing is shuffled; else the partial minima of documents of several rows are merged before holes are filled.
    """
    seqs = docs.select(F.col(id_col).cast("long").alias("gid"), F.col(seq_col).alias("seq")).where("gid IS NOT NULL")
    unique = unique_ids(seqs) if unique is None else unique
    kind = "gid long, cells array<long>" if rows else "gid long, pos int, h long, fp long"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, cells, filled in _groups(batches, p):
            yield _finished(ids, cells, filled, p, rows)

    if unique:
        return seqs.mapInArrow(whole, kind)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, cells, filled in _groups(batches, p):
            row, pos = np.nonzero(filled)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[row]), pa.array(pos.astype(np.int32)), pa.array(cells[row, pos].view(np.int64))], ["gid", "pos", "h"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, CELLS >> p.ls)
        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                part = batch.slice(lo, most)
                cells, filled = np.zeros((part.num_rows, p.s), np.uint64), np.zeros((part.num_rows, p.s), bool)
                for i, row in enumerate(part.column(1)):
                    at = np.asarray(row.values.field("pos"))
                    cells[i, at], filled[i, at] = np.asarray(row.values.field("h")).view(np.uint64), True
                yield _finished(part.column(0).to_pylist(), cells, filled, p, rows)

    # A document has at most s cells, however many rows it has.
    least = seqs.mapInArrow(partial, "gid long, pos int, h long").groupBy("gid", "pos").agg(unsigned_min(F.col("h")).alias("h"))
    return least.groupBy("gid").agg(F.collect_list(F.struct("pos", "h")).alias("cells")).mapInArrow(finish, kind)


def _digests(seqs: Iterator[str | None], k: int, rows: int, letters: int = DIGESTED) -> tuple[np.ndarray, np.ndarray]:
    """(n_kmers, h_xor) of sequences, `letters` of them at once: a longer sequence is cut into pieces that overlap by k - 1 letters."""
    n, xor = np.zeros(rows, np.int64), np.zeros(rows, np.uint64)
    of, parts, size = [], [], 0

    def add() -> None:
        part, h = many_kmer_hashes(parts, k)
        first = np.flatnonzero(np.diff(part, prepend=-1))
        at = np.array(of, np.int64)[part]
        n[:] += np.bincount(at, minlength=rows)
        if len(first):
            np.bitwise_xor.at(xor, at[first], np.bitwise_xor.reduceat(h, first))

    for i, seq in enumerate(seqs):
        for lo in range(0, len(seq or ""), letters):
            parts.append(seq[lo : lo + letters + k - 1])
            of.append(i)
            size += len(parts[-1])
            if size >= letters:
                add()
                of, parts, size = [], [], 0
    add()
    return n, xor.view(np.int64)


def kmer_digest(docs: DataFrame, k: int, id_col: str = "gid", seq_col: str = "seq") -> DataFrame:
    """(gid, n_kmers, h_xor) of every row: number of k-mers and the XOR of their canonical hashes. A task hashes DIGESTED letters at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, xor = _digests((s.as_py() for s in batch.column(1)), k, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(xor)], ["gid", "n_kmers", "h_xor"])

    return docs.select(F.col(id_col).cast("long").alias("gid"), F.col(seq_col).alias("seq")).mapInArrow(run, "gid long, n_kmers long, h_xor long")


def empty_cells(docs: DataFrame, sk: DataFrame, p: SketchParams) -> DataFrame:
    """(gid, n_empty) of every document."""
    filled = sk.groupBy("gid").agg(F.count("*").alias("n"))
    return docs.select("gid").distinct().join(filled, "gid", "left").select("gid", (F.lit(p.s) - F.coalesce("n", F.lit(0))).cast("long").alias("n_empty"))


def empty_documents(docs: DataFrame, sk: DataFrame) -> DataFrame:
    return docs.select("gid").distinct().join(sk.select("gid").distinct(), "gid", "left_anti")


def mean_size(docs: DataFrame, sample: int = 100, fallback: int = 5_000_000, drop_empty: bool = False) -> DataFrame:
    """(e): integer mean size of the first `sample` documents by id, a document's rows added up; the fallback if there is none.

    drop_empty: documents without a letter do not count, as in lists of files. Null ids are left out.
    """
    sizes = docs.where("gid IS NOT NULL").groupBy("gid").agg(F.sum(F.coalesce(F.length("seq"), F.lit(0))).alias("n"))
    sizes = sizes.where("n > 0") if drop_empty else sizes
    return sizes.orderBy("gid").limit(sample).agg(F.coalesce(F.expr("sum(n) div count(n)"), F.lit(fallback)).cast("long").alias("e"))
