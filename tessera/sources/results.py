"""Result files: lines in query order, plain or as zstd streams, and the reader of sparse ones."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .sequences import plain

#: The list of the files that make a result.
COMMITTED = "_committed"


def write_lines(lines: DataFrame, path: str, level: int = 0) -> None:
    """Writes (qid, line) as text in query order: the files, in name order, are the whole result. A level above 0 makes zstd streams of that level."""
    ordered = lines.repartitionByRange(F.col("qid")).sortWithinPartitions("qid").select("line")
    if level <= 0:
        ordered.write.text(path)
        return
    spark = lines.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    target = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    target = re.sub("^file:/+", "file:///", target)
    store, at = pafs.FileSystem.from_uri(target)
    if store.get_file_info(at).type != pafs.FileType.NotFound:
        raise FileExistsError(path)
    spark.dataSource.register(LinesSink)
    ordered.write.format("zstdlines").option("level", level).mode("append").save(target)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class LinesWriter(DataSourceArrowWriter):
    """Writes each task's lines to a file of the attempt's own name. The list of files in COMMITTED, written last, makes them the result; no file is moved."""

    def __init__(self, options: dict):
        self.path, self.level = options["path"], int(options.get("level", 3))

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        import zstandard
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.txt.zst"
        store, at = pafs.FileSystem.from_uri(self.path)
        store.create_dir(at, recursive=True)
        out = None
        for batch in batches:
            if batch.num_rows:
                out = out or zstandard.ZstdCompressor(level=self.level).stream_writer(store.open_output_stream(f"{at}/{name}", compression=None))
                out.write("".join(f"{line}\n" for line in batch.column(0).to_pylist()).encode())
        if out is None:
            return Written(None)
        out.close()
        return Written(name)

    def _clear(self, kept: set[str]) -> None:
        store, at = pafs.FileSystem.from_uri(self.path)
        for left in store.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
            if left.base_name not in kept:
                store.delete_file(left.path)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, at = pafs.FileSystem.from_uri(self.path)
        store.create_dir(at, recursive=True)
        names = sorted(m.name for m in messages if m and m.name)
        with store.open_output_stream(f"{at}/{COMMITTED}") as out:
            out.write("".join(f"{n}\n" for n in names).encode())
        self._clear({COMMITTED, *names})  # what lost attempts left

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(set())


class LinesSink(DataSource):
    """Options: path, and level, that of zstd. Takes one column of text."""

    @classmethod
    def name(cls) -> str:
        return "zstdlines"

    def writer(self, schema: StructType, overwrite: bool) -> LinesWriter:
        return LinesWriter(self.options)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of result files, plain or compressed, in no order."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(plain(content.as_py()).decode().splitlines(), pa.string())], ["value"])

    if spark.read.format("binaryFile").option("pathGlobFilter", "*.zst").load(path).select("path").take(1):
        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "value string")
    return spark.read.text(path)


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """(qid, rid, score) of sparse lines."""
    head = F.split("value", "\t")
    rows = read_lines(spark, path).select(F.regexp_extract(head[0], r"query_(\d+)", 1).cast("long").alias("qid"), F.explode(F.split(head[1], ",")).alias("hit")).where("hit <> ''")
    part = F.split("hit", ":")
    return rows.select("qid", part[0].cast("long").alias("rid"), part[1].cast("double").alias("score"))
