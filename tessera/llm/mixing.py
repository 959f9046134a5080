"""Mixing sources to target weights.

A source's target is its share, by weight, of a word budget, at most `most` times its size; what is
over is shared again. A source is taken whole as often as its target allows; the rest of the target
is drawn by Efraimidis-Spirakis sampling: a document's key is -ln(u) / quality, u from a hash of its
id, and the documents with the smallest keys are taken until their words reach the rest.

No task sorts a source: keys are counted in fine intervals, the interval where the running sum passes the
rest is found from those counts, and only its documents are put in order. The last one taken is the source's edge:
with one row a source, every document can tell by itself how often it is taken, so texts are never moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, col, cut, read_table

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
#: Intervals of keys; a source's passing interval holds about one document in so many.
INTERVALS = 1 << 14
#: Sources whose plan, one row each, is broadcast at most; more are shuffled.
BROADCAST_SOURCES = 100_000


def words_in(text_col: str = "text"):
    """Number of words, null: 0, counted as word starts without building the words."""
    text = F.coalesce(col(text_col), F.lit(""))
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def letter_share(text_col: str = "text"):
    """A document's quality weight: the share of letters and white space in its text, 0.05 at least; 1 if it is null or empty."""
    text = F.coalesce(col(text_col), F.lit(""))
    n = F.length(text)
    odd = F.length(F.regexp_replace(text, r"[\p{L}\x20\x09-\x0D]+", ""))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.05), (n - odd) / n))


def likeness(text_col: str = "text"):
    """Half an md5 of the text: rows with one id, source and likeness are treated alike."""
    return F.substring(F.md5(F.coalesce(col(text_col), F.lit("")).cast("binary")), 1, 16)


def _uniform(*cols: Column):
    """A number in (0, 1) from the md5 of the columns' text: 48 bits, never 0."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("-")) for c in cols])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, source_size, n_docs), one row a source.

    Sources in code point order, null last, get the weights in turn. Sources whose share is above
    `most` times their size stop there; taken in order of rising limit over weight, the first that
    stays below its limit fixes the scale for itself and all that follow.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((turn - 1) % len(weights) + 1).cast("int"))
    df = sizes.withColumn("weight", weigh).withColumn("limit", F.col("source_size") * most)
    order = Window.orderBy((F.col("limit") / F.col("weight")), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("scale", (F.sum("source_size").over(all_rows) * share - before) / onward)
    df = df.withColumn("free", F.col("scale") * F.col("weight") <= F.col("limit"))
    scale = F.min(F.when(F.col("free"), F.struct(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source", "scale"))).over(all_rows)["scale"]
    target = F.when(F.col("limit") == 0, 0.0).otherwise(F.least("limit", F.coalesce(scale, F.lit(float("inf"))) * F.col("weight")))
    return df.withColumn("target", target).select("source", "source_size", "n_docs", "target")


def mix_key(quality: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Column:
    """(key, id, like): a row's place in its source's order. Keys come from a hash of id, source and text, so reruns agree."""
    q = quality if quality is not None else letter_share(text_col)
    like = likeness(text_col)
    key = -F.log(_uniform(col(id_col), col(source_col), like)) / F.greatest(F.coalesce(q.cast("double"), F.lit(1e-6)), F.lit(1e-6))
    return F.struct(key.alias("key"), col(id_col).alias("id"), like.alias("like"))


def _interval(key: Column) -> Column:
    return F.floor((1 - F.exp(-key)) * INTERVALS).cast("int")


def mix_plan(narrow: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target, epochs, edge), one row a source, from rows (source, size, place) with mix_key()'s places.

    epochs: how often the whole source is taken; edge: the place of the last row that is taken once more, null if there is none.
    """
    narrow = narrow.withColumn("interval", _interval(F.col("place.key")))
    steps = cut(narrow.groupBy("source", "interval").agg(F.sum("size").alias("words"), F.count("*").alias("rows")), "mix-steps")
    targets = source_targets(steps.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("rows").alias("n_docs")), share, most, weights)
    whole = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long")
    targets = cut(targets.withColumn("epochs", whole).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")

    # Where, in each source, the running sum of words passes the rest.
    running = F.sum("words").over(Window.partitionBy("source").orderBy("interval").rowsBetween(Window.unboundedPreceding, -1))
    t = targets.select(F.col("source").alias("s"), "rest")
    t = F.broadcast(t) if t.count() <= BROADCAST_SOURCES else t
    passing = (
        steps.withColumn("below", F.coalesce(running, F.lit(0)))
        .join(t, F.col("source").eqNullSafe(F.col("s")))
        .where((F.col("below") <= F.col("rest")) & (F.col("below") + F.col("words") > F.col("rest")))
        .groupBy(F.col("source").alias("s"))
        .agg(F.min("interval").alias("passing"), F.min_by("below", "interval").alias("below"), F.first("rest").alias("rest"))
    )
    passing = cut(passing, "mix-passing")
    few = F.broadcast(passing) if passing.count() <= BROADCAST_SOURCES else passing
    inside = narrow.join(few, F.col("source").eqNullSafe(F.col("s")) & (F.col("interval") == F.col("passing"))).select("source", "size", "place", "below", "rest")
    # Rows alike in all are one step of the order. What stands on the edge is taken if that brings the sum nearer to the rest.
    inside = inside.groupBy("source", "place", "below", "rest").agg(F.sum("size").alias("likes"))
    upto = F.col("below") + F.sum("likes").over(Window.partitionBy("source").orderBy("place"))
    edges = inside.withColumn("upto", upto).where(F.col("upto") - F.col("likes") / 2 <= F.col("rest")).groupBy(F.col("source").alias("e")).agg(F.max("place").alias("edge"))
    # Without a row inside, all of the intervals before the passing one are taken; without a passing one, none lacks.
    plan = targets.join(passing.select("s", "passing"), F.col("source").eqNullSafe(F.col("s")), "left").join(edges, F.col("source").eqNullSafe(F.col("e")), "left")
    return cut(plan.select("source", "source_size", "target", "epochs", F.coalesce("passing", F.lit(-1)).alias("passing"), "edge"), "mix-plan")


def _copies(plan: str, source_words: Column, place: Column) -> Column:
    """How often a row is taken, from its place and its source's row of the plan."""
    p = lambda c: F.col(f"{plan}.{c}")
    at = _interval(place["key"])
    extra = (at < p("passing")) | ((at == p("passing")) & F.coalesce(place <= p("edge"), F.lit(False)))
    return F.when(source_words == 0, F.lit(0).cast("long")).otherwise(p("epochs") + extra.cast("long"))


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS, quality: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, likeness, size, source_size, target, taken, copies): one row for each row of docs.

    `quality` is a Column over docs, by default letter_share(). Reruns agree: keys come from a hash of id,
    source and text. Rows alike in all three (repeated rows) are taken or left together. A null text has
    size 0 and takes nothing; a null source is a source of its own, in last place; null ids hash as one
    value. A quality that is null or not above 1e-6 counts as 1e-6. An empty table gives no rows. Other columns
    are not read.
    """
    narrow = docs.select(col(source_col).alias("source"), words_in(text_col).alias("size"), mix_key(quality, id_col, text_col, source_col).alias("place"))
    narrow = cut(narrow, "mix-keys")
    plan = mix_plan(narrow, share, most, weights)
    few = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    rows = narrow.alias("n").join(few.alias("p"), F.expr("n.source <=> p.source"))
    copies = _copies("p", F.col("size"), F.col("place"))
    return rows.select("place.id", "n.source", "place.like", "size", "source_size", "target", copies.alias("copies")).select(
        F.col("id").alias("doc_id"), "source", F.col("like").alias("likeness"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def mixed_documents(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS, quality: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as the mix takes it; a row that the mix leaves out goes. Columns as in docs, whatever their names.

    Nulls, repeated rows and empty tables are as for mix(). Texts stay where they are: the plan, one row a source, comes to them.
    """
    place, size = mix_key(quality, id_col, text_col, source_col), words_in(text_col)
    narrow = cut(docs.select(col(source_col).alias("source"), size.alias("size"), place.alias("place")), "mix-keys")
    plan = mix_plan(narrow, share, most, weights)
    few = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    kept = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[col(c).alias(k) for c, k in zip(docs.columns, kept, strict=True)], size.alias("size"), place.alias("place"))
    source = kept[docs.columns.index(source_col)]
    rows = rows.alias("n").join(few.alias("p"), F.col(f"n.{source}").eqNullSafe(F.col("p.source")))
    rows = rows.select(*[f"n.{k}" for k in kept], _copies("p", F.col("n.size"), F.col("n.place")).alias("copies")).where("copies > 0")
    return rows.select(*kept, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy").toDF(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed with the weights 5, 2, 1 to 150 % of all words."""
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


#: DuckDB SQL for op10_mixing. Sources are ordered by their UTF-8 bytes, as DuckDB compares text.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, substr(md5(coalesce(text, '')), 1, 16) AS likeness,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         length(coalesce(text, '')) AS n, length(regexp_replace(coalesce(text, ''), '[\p{L}\x20\x09-\x0D]+', '', 'g')) AS odd
  FROM documents),
k AS (
  SELECT *, -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || coalesce(source, '-') || '|' || likeness), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
            / CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE greatest(0.05::DOUBLE, (n - odd)::DOUBLE / n::DOUBLE) END AS key
  FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS lim FROM s),
c AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY lim / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale
  FROM w),
f AS (SELECT arg_min(scale, lim / weight) AS scale FROM c WHERE scale * weight <= lim),
t AS (SELECT c.source, c.source_size, CASE WHEN lim = 0 THEN 0.0::DOUBLE ELSE least(lim, coalesce((SELECT scale FROM f), 'inf'::DOUBLE) * weight) END AS target FROM c),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS epochs FROM t),
r AS (
  SELECT k.doc_id, k.source, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.likeness) AS upto,
         sum(k.size) OVER (PARTITION BY k.source, k.key, k.doc_id, k.likeness) AS likes
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, source,
       CASE WHEN size = 0 THEN 0 ELSE (epochs + CASE WHEN upto - likes / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END)::BIGINT END AS copies,
       size * CASE WHEN size = 0 THEN 0 ELSE (epochs + CASE WHEN upto - likes / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END)::BIGINT END AS taken
FROM r
"""
