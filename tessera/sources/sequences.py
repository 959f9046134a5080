"""Sequence files: FASTA and FASTQ, plain, gzip or zstd, one record or one file a document."""

from __future__ import annotations

import io
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kmers import runs
from . import fastx
from .work import cut

#: Lines or records that leave a task together.
RECORDS = 1024


def plain(content: bytes) -> bytes:
    """Content, decompressed if its first bytes say so; every gzip member and zstd frame is read."""
    return b"".join(data for data, _, _ in fastx.blocks(io.BytesIO(content), fastx.kind_of(content[:18])))


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_records(spark: SparkSession, path: str, range_bytes: int = fastx.RANGE) -> DataFrame:
    """(gid, name, seq): each record is a document, in file order; a folder's or pattern's files come in order of their paths, one after the other.

    Files are read by the source "fastx": plain and block-gzip ones in ranges of range_bytes, a task each. Numbers go on from range to range and from
    file to file: a range starts where those before it, counted first, end. In a store that only Spark's readers open, a file is one task's, 2 GB at most.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield fastx.as_batch(file, 0, 0, list(fastx.content_records(content.as_py())))

    if fastx.opens(path):
        fastx.register(spark)
        found = spark.read.format("fastx").option("rangebytes", range_bytes).load(path)
    else:
        found = _files(spark, path).mapInArrow(parse, fastx.SCHEMA)
    found = cut(found, "records")
    before = F.coalesce(F.sum("n").over(Window.orderBy("p", "s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    bases = found.groupBy(F.col("path").alias("p"), F.col("start").alias("s")).agg(F.count("*").alias("n")).select("p", "s", before.alias("base"))
    return found.join(bases, (F.col("path") == F.col("p")) & (F.col("start") == F.col("s"))).select((F.col("base") + F.col("rec")).alias("gid"), "name", "seq")


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """(gid, file): the lines of a list of files, numbered; if the path has several files, of all of them, in order of their paths. The list may be compressed."""

    def cut_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names = [x.strip() for x in plain(content.as_py()).decode().splitlines()]
                for lo in range(0, max(1, len(names)), RECORDS):
                    part = names[lo : lo + RECORDS]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(part), pa.string()), pa.array(range(lo, lo + len(part)), pa.int64()), pa.array(part, pa.string())], ["path", "at", "file"])

    found = cut(_files(spark, path).mapInArrow(cut_lines, "path string, at long, file string"), "listed")
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a file of the list
    bases = found.groupBy(F.col("path").alias("p")).agg(F.count("*").alias("n")).select("p", before.alias("base"))
    return found.join(F.broadcast(bases), F.col("path") == F.col("p")).select((F.col("base") + F.col("at")).cast("long").alias("gid"), "file")


def count_listed(spark: SparkSession, path: str) -> int:
    """Lines of a list of files; each takes an id."""
    return _listed(spark, path).count()


def _rows(gid: int, first: int, seqs: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([gid] * len(seqs), pa.int64()), pa.array(range(first, first + len(seqs)), pa.int64()), pa.array(seqs, pa.string())], ["gid", "rec", "seq"])


def _kept(gid: int, found: Iterator[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    """A file's records, as far as they can be read."""
    seqs, n, letters = [], 0, 0
    try:
        for _, seq in found:
            seqs.append(seq)
            letters += len(seq)
            if len(seqs) == RECORDS or letters > fastx.LETTERS:
                yield _rows(gid, n, seqs)
                seqs, n, letters = [], n + len(seqs), 0
    except (ValueError, OSError, EOFError):
        pass  # what stands before the broken record counts
    yield _rows(gid, n, seqs)


def read_file_list(spark: SparkSession, path: str) -> DataFrame:
    """(gid, rec, seq): each line of a list names a file, which is one document; its records keep apart.

    A blank line or a path that can't be read takes its id and has no rows. The list stays a table; tasks open the files that it names and read them as
    streams. In a store that only Spark's readers open, the list's names are held by the driver, which looks into each folder that they name once.
    """
    names = _listed(spark, path).where("file <> ''")
    if fastx.opens(path):
        home, here = spark._jsc.hadoopConfiguration().get("fs.defaultFS").rstrip("/"), os.getcwd()

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for gid, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    uri = file if "://" in file or file.startswith("file:") else (home or "file://") + os.path.join(here, file)
                    fastx.pafs.FileSystem.from_uri(uri)  # an unknown store is an error; a missing file is none
                    yield from _kept(gid, fastx.file_records(uri))

        tasks = max(1, min(names.count(), 4 * spark.sparkContext.defaultParallelism))
        return names.repartition(tasks, "gid").mapInArrow(read, "gid long, rec long, seq string")
    listed = [tuple(r) for r in names.collect()]
    real = _existing(spark, {p for _, p in listed})
    named = [(i, real[p]) for i, p in listed if p in real]
    if not named:
        return spark.createDataFrame([], "gid long, rec long, seq string")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gid, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _kept(gid, fastx.content_records(content.as_py()))

    bare = lambda c: F.regexp_replace(c, "^[a-z]+:/*", "/")
    files = _files(spark, sorted(set(real.values()))).withColumn("bare", bare("path"))
    joined = spark.createDataFrame(named, "gid long, file string").withColumn("bare", bare("file")).join(files, "bare")
    return joined.select("gid", "content").mapInArrow(parse, "gid long, rec long, seq string")


def _existing(spark: SparkSession, paths: set[str]) -> dict[str, str]:
    """Those of the paths that are files, with the name that their file system gives them; each folder is listed once."""
    hadoop, folders = spark._jvm.org.apache.hadoop.fs, {}
    for p in paths:
        path = hadoop.Path(p)
        folders.setdefault(str(path.getParent()), []).append((p, path))
    found = {}
    for folder, inside in folders.items():
        try:
            there = inside[0][1].getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop.Path(folder))
        except Exception as e:  # a folder that is missing or closed has no files
            if "FileNotFound" not in str(e) and "Permission" not in str(e):
                raise
            continue
        files = {s.getPath().getName(): str(s.getPath()) for s in there if s.isFile()}
        found |= {p: files[path.getName()] for p, path in inside if path.getName() in files}
    return found


def run_table(docs: DataFrame) -> DataFrame:
    """(gid, run_idx, run_len): the runs of A, C, G, T in either case, in order."""
    found = F.regexp_extract_all(F.coalesce("seq", F.lit("")), F.lit("[ACGTacgt]+"), F.lit(0))
    return docs.select("gid", F.posexplode(found).alias("run_idx", "run")).select("gid", "run_idx", F.length("run").alias("run_len"))


def longest_run(seq: str | None) -> int:
    return max(map(len, runs(seq)), default=0)
