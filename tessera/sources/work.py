"""The folder that driver and executors share, tables written there, and dense numbers for sorted rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, read from the session.

    Where it is unset, a local master gets a fresh temporary folder, kept for the session; on a
    cluster that would be a folder of one machine, so there the missing setting is an error.
    """
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set(key, made)
    return made


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder as Parquet and read again.

    Later stages then start from files that outlive any executor. Two columns of one name are
    not written; callers select what they need first.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order, name: str) -> DataFrame:
    """df with `name`, its rows' numbers from 0 without gaps in the given order. No task sees more than a partition and a row for each of them."""
    rows = df.orderBy(*order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    rows = cut(rows, "sorted")
    parts = rows.groupBy(F.col("part").alias("p")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = parts.select("p", "first", before.alias("before"))
    return rows.join(F.broadcast(bases), F.col("part") == F.col("p")).select(*df.columns, (F.col("before") + F.col("at") - F.col("first")).cast("long").alias(name))
