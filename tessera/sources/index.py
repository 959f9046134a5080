"""Stored indexes: an inverted file in Parquet with one row of metadata, and the reader that checks it."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compare import as_positions, as_rows, compare, min_matches, scored
from ..operators.sketch import SketchParams
from .work import cut

#: Ids of a stored posting list's chunk, and of a run that is summed up together.
CHUNK, RUN = 4096, 64
#: Buckets of an index at least, and lists of several chunks that are dealt at most.
BUCKETS, HOT_LISTS = 8, 100_000
#: Meetings of stored lists for each cell, above which documents' rows meet instead.
WIDE = 8


@dataclass
class Index:
    """postings (pos, fp, chunk, n, gids), the parameters, the number of documents and of those without a sketch."""

    postings: DataFrame
    params: SketchParams
    n_docs: int
    n_empty: int
    order: DataFrame | None = None
    #: Ids are below it: lines of a list count, even those without a document. None: n_docs.
    n_ids: int | None = None
    #: Buckets that the postings' partitions are already dealt by.
    buckets: int | None = None

    def ids(self) -> DataFrame:
        """(gid): every id, with or without rows."""
        return self.postings.sparkSession.range(self.n_docs if self.n_ids is None else self.n_ids).withColumnRenamed("id", "gid")

    def sketch(self) -> DataFrame:
        """(gid, pos, fp), as it was indexed."""
        return self.postings.select("pos", "fp", F.explode("gids").alias("gid"))

    def stats(self) -> DataFrame:
        row = (self.params.s, 1 << self.params.w, self.n_docs, self.n_empty)
        return self.postings.sparkSession.createDataFrame([row], "s int, fp_range long, n_docs long, n_empty long")

    def check(self, other: Index) -> None:
        if not self.params.agrees(other.params):
            raise ValueError(f"indexes differ in their parameters: {self.params} and {other.params}")


def postings(sk: DataFrame) -> DataFrame:
    """(pos, fp, n, gids): ascending ids of the documents with a fingerprint at a position."""
    return as_positions(sk).groupBy("pos", "fp").agg(F.array_sort(F.collect_list("gid")).alias("gids")).select("pos", "fp", F.size("gids").alias("n"), "gids")


def _chunks(size: int):
    """Rows (pos, fp, gid), sorted, to rows (pos, fp, chunk, n, gids): runs of one list are cut after every `size` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.empty((0, 3), np.int64)  # what may go on: the rows of the last chunk so far
        done = 0  # chunks of its list before it
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([kept, np.stack([np.asarray(c).astype(np.int64) for c in batch.columns], 1)])
            new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)]
            first = np.flatnonzero(new)
            place = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
            cuts = np.flatnonzero(place % size == 0)
            chunk = place[cuts] // size
            chunk[cuts < (first[1] if len(first) > 1 else len(rows))] += done
            yield _batch(rows, cuts, chunk, cuts[-1])
            kept, done = rows[cuts[-1] :], int(chunk[-1])
        if len(kept):
            yield _batch(kept, np.array([0]), np.array([done]), len(kept))

    def _batch(rows: np.ndarray, cuts: np.ndarray, chunk: np.ndarray, end: int) -> pa.RecordBatch:
        whole = cuts < end
        cuts, ends = cuts[whole], np.r_[cuts[whole], end]
        gids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rows[:end, 2].copy()))
        cols = [(rows[cuts, 0], pa.int32()), (rows[cuts, 1], pa.int64()), (chunk[whole], pa.int32()), (np.diff(ends), pa.int32())]
        return pa.RecordBatch.from_arrays([*[pa.array(x, k) for x, k in cols], gids], ["pos", "fp", "chunk", "n", "gids"])

    return run


def chunked_postings(sk: DataFrame, size: int = CHUNK, buckets: int = BUCKETS) -> DataFrame:
    """(pos, fp, chunk, n, gids): postings in chunks of at most `size` ids, dealt to buckets by position and fingerprint and sorted there.

    One shuffle and one sort; a task cuts its sorted cells as they stream by, so a list of any length fits. A document has one cell at a position: of n documents with
    s cells, a list has at most n cells of n * s, so no bucket holds more than buckets / s times the mean beyond its share.
    """
    cells = as_positions(sk).select("pos", "fp", "gid").repartition(buckets, "pos", "fp").sortWithinPartitions("pos", "fp", "gid")
    return cells.mapInArrow(_chunks(size), "pos int, fp long, chunk int, n int, gids array<long>")


def deltas(p: DataFrame) -> DataFrame:
    """Ids as the first one and then differences."""
    step = lambda x, i: F.when(i == 0, x).otherwise(x - F.get("gids", i - 1))
    return p.select(*[c for c in p.columns if c != "gids"], F.transform("gids", step).alias("deltas"))


def undeltas(p: DataFrame) -> DataFrame:
    """The ids of deltas(): running sums, in runs of RUN and then over the runs, so that a long list costs little more than its length."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")
    grow = lambda acc, d: F.struct((acc["sum"] + d).alias("sum"), F.concat(acc["out"], F.array(acc["sum"] + d)).alias("out"))
    empty = F.struct(zero.alias("sum"), none.alias("out"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("deltas") - 1) / RUN).cast("int")), lambda r: F.aggregate(F.slice("deltas", r * RUN + 1, F.lit(RUN)), empty, grow))
    before = F.aggregate("runs", empty, lambda acc, r: F.struct((acc["sum"] + r["sum"]).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")))["out"]
    ids = F.flatten(F.zip_with("runs", "before", lambda r, b: F.transform(r["out"], lambda x: x + b)))
    return p.withColumn("runs", runs).withColumn("before", before).select(*[c for c in p.columns if c != "deltas"], ids.alias("gids"))


def bucket_count(n_docs: int, s: int) -> int:
    """Buckets of an index: a power of two, for about four million cells each, BUCKETS at least and 4 * s at most, so that no list makes one bucket large."""
    return max(BUCKETS, min(1 << max(0, math.ceil(math.log2(max(1, n_docs * s) / (1 << 22)))), 4 * s))


def build(docs: DataFrame, sk: DataFrame, params: SketchParams, n_ids: int | None = None) -> Index:
    n = docs.select("gid").distinct().count()
    return dealt_index(sk, params, n, n - sk.select("gid").distinct().count(), n_ids=n_ids)


def dealt_index(sk: DataFrame, params: SketchParams, n_docs: int, n_empty: int, order: DataFrame | None = None, n_ids: int | None = None) -> Index:
    buckets = bucket_count(n_docs, params.s)
    return Index(chunked_postings(sk, buckets=buckets), params, n_docs, n_empty, order, n_ids, buckets)


def _registered(spark: SparkSession, path: str, buckets: int, columns: list[str]) -> DataFrame:
    """The stored lists as a table that Spark knows to be bucketed: joined with another of as many buckets, it is not shuffled."""
    name = f"tessera_{uuid.uuid4().hex}"
    kinds = {"pos": "INT", "fp": "BIGINT", "chunk": "INT", "n": "INT", "gids": "ARRAY<BIGINT>"}
    at = path.replace("'", "\\'")
    listed = ", ".join(f"{c} {kinds[c]}" for c in columns)
    spark.sql(f"CREATE TABLE {name} ({listed}) USING parquet CLUSTERED BY (pos, fp) SORTED BY (pos, fp) INTO {buckets} BUCKETS LOCATION '{at}'")
    return spark.table(name)


def save(index: Index, path: str, codec: str = "zstd", level: int | None = None) -> None:
    """path/meta, path/postings (bucketed by position and fingerprint and sorted by them, so that a filter on the position skips row groups) and, if reordered, path/order."""
    spark = index.postings.sparkSession
    lists = index.postings if "chunk" in index.postings.columns else index.postings.withColumn("chunk", F.lit(0))
    buckets = bucket_count(index.n_docs, index.params.s)
    meta = asdict(index.params) | {"n_docs": index.n_docs, "n_empty": index.n_empty, "n_ids": index.n_docs if index.n_ids is None else index.n_ids, "has_order": index.order is not None, "buckets": buckets}
    spark.createDataFrame([meta]).coalesce(1).write.json(f"{path}/meta")
    lists = lists.select("pos", "fp", "chunk", "n", "gids")
    lists = lists if index.buckets == buckets else lists.repartition(buckets, "pos", "fp")
    writer = lists.write.format("parquet").option("compression", codec).option("path", f"{path}/postings").bucketBy(buckets, "pos", "fp").sortBy("pos", "fp")
    writer = writer if level is None else writer.option("parquet.compression.codec.zstd.level", level)
    name = f"tessera_{uuid.uuid4().hex}"
    writer.saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay: they are outside the warehouse
    if index.order is not None:
        index.order.write.parquet(f"{path}/order")


def load(spark: SparkSession, path: str) -> Index:
    """An index as stored, with its order if it has one; its postings are read when they are used."""
    m = spark.read.json(f"{path}/meta").first().asDict()
    params = SketchParams(**{k: m[k] for k in ("k", "ls", "w", "e", "mode", "densify")})
    order = spark.read.parquet(f"{path}/order") if m.get("has_order") else None
    stored = spark.read.parquet(f"{path}/postings")
    if m.get("buckets"):
        stored = _registered(spark, f"{path}/postings", m["buckets"], stored.columns)
    return Index(stored, params, m["n_docs"], m["n_empty"], order, m.get("n_ids"))


def read_positions(index: Index, first: int, last: int) -> DataFrame:
    """The postings of positions first to last; of a stored index, only the row groups that hold them are read."""
    return index.postings.where(F.col("pos").between(first, last))


def _pairs(left: DataFrame, right: DataFrame, half: bool) -> DataFrame:
    """(qid, rid) from rows with two lists q and r: all pairs of their ids."""
    met = left.join(right, ["pos", "fp"]).select("r", F.explode("q").alias("qid")).select("qid", F.explode("r").alias("rid"))
    return met.where("qid <= rid") if half else met


def list_hits(query: DataFrame, ref: DataFrame, half: bool = False, hot_lists: int = HOT_LISTS) -> DataFrame:
    """(qid, rid) for each position and fingerprint that two documents of stored postings share. half: pairs of one index, each once.

    Lists meet as lists: two bucketed tables are joined where they lie, without a shuffle. Lists of several chunks on either side, if there are no more
    than hot_lists (they are broadcast by their position and fingerprint), are left out there: their pairs of chunks are dealt over all tasks.
    """
    several = query.where("chunk = 1").select("pos", "fp")
    several = several if half else several.unionByName(ref.where("chunk = 1").select("pos", "fp")).distinct()
    q, r = query.select("pos", "fp", "chunk", F.col("gids").alias("q")), ref.select("pos", "fp", "chunk", F.col("gids").alias("r"))
    several = cut(several, "hot-lists")
    if not 0 < several.count() <= hot_lists:
        return _pairs(q.drop("chunk"), r.drop("chunk"), half)
    few = F.broadcast(several)
    cold = _pairs(q.join(few, ["pos", "fp"], "left_anti").drop("chunk"), r.join(few, ["pos", "fp"], "left_anti").drop("chunk"), half)
    i, j = q.join(few, ["pos", "fp"]).withColumnRenamed("chunk", "i"), r.join(few, ["pos", "fp"]).withColumnRenamed("chunk", "j")
    deals = i.select("pos", "fp", "i").join(j.select("pos", "fp", "j"), ["pos", "fp"])
    deals = deals.where("i <= j") if half else deals  # ids ascend over the chunks
    dealt = deals.join(i, ["pos", "fp", "i"]).join(j, ["pos", "fp", "j"]).repartition("pos", "fp", "i", "j")
    met = dealt.select("r", F.explode("q").alias("qid")).select("qid", F.explode("r").alias("rid"))
    return cold.unionByName(met.where("qid <= rid") if half else met)


def compare_stored(query: Index, ref: Index, threshold: float = 0.0) -> DataFrame:
    """(qid, rid, matches, score): compare() of two stored indexes, or of one with itself, from their posting lists.

    Where lists are short, they meet where they lie, and the pairs of their ids are counted. With a threshold, or where those would be more than WIDE for each cell,
    documents' rows are put together from the lists, one shuffle of their cells, and meet by keys or in blocks.
    """
    query.check(ref)
    s, same = ref.params.s, query is ref
    if min_matches(threshold, s) <= 1 and _meetings(query.postings, ref.postings, same) <= WIDE:
        found = list_hits(query.postings, ref.postings, same).groupBy("qid", "rid").agg(F.count("*").alias("matches"))
        if same:
            found = cut(found, "found")
            found = found.unionByName(found.where("qid <> rid").select(F.col("rid").alias("qid"), F.col("qid").alias("rid"), "matches"))
        return scored(found, s, threshold)
    q = cut(as_rows(query.sketch()), "rows")
    return compare(q, q if same else cut(as_rows(ref.sketch()), "rows"), s, threshold)


def _meetings(query: DataFrame, ref: DataFrame, half: bool) -> float:
    """Meetings of two tables' posting lists for each of their cells; of one table each once."""
    sizes = lambda p, name: p.groupBy("pos", "fp").agg(F.sum(F.col("n").cast("double")).alias(name))
    n = sizes(query, "a").join(sizes(ref, "b"), ["pos", "fp"], "full")
    met, cells = n.agg(F.sum(F.col("a") * F.col("b")), F.sum(F.coalesce("a", F.lit(0.0)) + (F.lit(0.0) if half else F.coalesce("b", F.lit(0.0))))).first()
    return (met or 0.0) / (2 if half else 1) / max(cells or 0.0, 1.0)
