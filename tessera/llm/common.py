"""What the operators share: tables, names, bounded samples and word patterns; written cuts come from the library."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.work import cut, fresh_path

__all__ = ["WORD", "bounded_sample", "col", "crc_table", "cut", "fresh_path", "give_back", "giving_back", "held_out", "learned_from", "looked_up", "placed", "read_table"]

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a table that looked_up() broadcasts at most.
BROADCAST_ROWS = 500_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """The column of exactly this name, whatever stands in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def learned_from(id_col: str = "doc_id"):
    """True for rows that a model may learn from: crc32 of the id as text, modulo 3, is not 1.

    A null id has no such remainder; its row is not learned from and counts as not held out.
    """
    return F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % 3 != 1, F.lit(False))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bounded_sample(rows: DataFrame, key: str, per_key: int, id_col: str = "doc_id", most_keys: int = 1000) -> tuple[DataFrame, dict]:
    """About per_key rows for each value of `key`, chosen by a hash of the id: the same rows on every run; and each value's number of rows.

    `per_key` bounds what a fit collects; the counts come from the narrow columns alone. More values of `key`
    than most_keys (languages, labels) are an error.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(key).count().limit(most_keys + 1).collect()}
    if len(counts) > most_keys:
        raise ValueError(f"{key} has more than {most_keys} values")
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(key) == F.lit(value), F.lit(min(1.0, per_key / max(n, 1)))).otherwise(share)
    spot = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1_000_000)) / 1e6
    return rows.where(spot < share), counts


def looked_up(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", spread: int = 16, most: int = BROADCAST_ROWS) -> DataFrame:
    """rows joined with `few`, which has one row for each value of the keys, by columns of the same names; `few` needs a count, so it should be written.

    Up to `most` rows are broadcast. Beyond, each row of few goes to `spread` partitions, among which the rows of one key are dealt: a key that a
    third of all rows has then fills no partition. Keys are never null.
    """
    if few.count() <= most:
        return rows.join(F.broadcast(few), keys, how)
    dealt = rows.withColumn("_deal", F.pmod(F.monotonically_increasing_id(), F.lit(spread)))
    copies = few.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))).alias("_deal"))
    return dealt.join(copies, [*keys, "_deal"], how).drop("_deal")


def placed(df: DataFrame, group: str, *order: str, index: str = "idx", total: str = "n") -> DataFrame:
    """df with each row's place in its group, from 0 without gaps in the given order, and the group's number of rows. Null values come first; groups are never null.

    The table is range-sorted by group and order, so a group of any size is spread over partitions; a table of (partition, group) counts tells where
    each partition's share of a group begins. Rows equal in group and order get places of their own.
    """
    names = [F.col(c).asc_nulls_first() for c in (group, *order)]
    rows = cut(df.orderBy(*names).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "placed")
    shares = rows.groupBy("_part", F.col(group)).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = cut(shares.select("_part", group, "_first", earlier.alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias(total)), "bases")
    found = looked_up(rows, bases, ["_part", group], spread=1)
    return found.select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first")).cast("long").alias(index), F.col(total).cast("long").alias(total))


def give_back() -> None:
    """Returns to the system what this process has freed: allocators keep it, and Spark keeps idle Python workers."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library alone
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of mapInArrow whose worker gives back at a task's end what the task has freed."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def crc_table() -> list[int]:
    """The 256 remainders that crc32 looks up byte by byte, for the SQL."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out
