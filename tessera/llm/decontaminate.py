"""Benchmark decontamination.

A document's windows are as long, in words, as the benchmark items. A window that shares no shingle with an
item of its length has similarity 0 to all, so windows are laid where a shingle of the document
is a shingle of an item, and in line with it. Windows and items get 64-bit SimHash fingerprints of their
words. Fingerprints are cut into four blocks of 16 bits: two that differ in 15 bits at most differ in three at most
in one block, so each item's blocks are posted with every change of up to three bits, and a join on block values finds all
fingerprints within the radius. No radius follows from the similarity, so windows that hold one of an item's rarest
shingles, of which a similar one can't lack all, are candidates too. The weighted similarity
of the whole shingle sets decides.
All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, cut, read_table

#: Words of a shingle; the least similarity; a shingle's weight is how often it occurs.
SHINGLE, THRESHOLD = 5, 80
#: Bits by which fingerprints may differ, blocks they are cut into, and bits by which one of the blocks differs at most.
RADIUS, BLOCKS = 15, 4
BLOCK_BITS, BLOCK_RADIUS = 64 // BLOCKS, RADIUS // BLOCKS
#: Rows of benchmark shingles, items, or ids that are broadcast at most; a larger table is shuffled.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(hashes: Column, k: int) -> Column:
    """Hashes of the k-word shingles of an array of word hashes; none if there are fewer words."""
    at = [lambda i, j=j: F.get(hashes, i + j) for j in range(k)]
    made = F.transform(F.sequence(F.lit(0), F.size(hashes) - k), lambda i: F.xxhash64(F.lit(k), *[f(i) for f in at]))
    return F.when(F.size(hashes) >= k, made).otherwise(F.array().cast("array<bigint>"))


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def fingerprint(hashes: Column) -> Column:
    """SimHash: bit b is set if more of the hashes have it than have not."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    vote = lambda b: lambda acc, h: acc + F.when(F.call_function("shiftrightunsigned", h, b).bitwiseAND(one) == 1, 1).otherwise(-1)
    bit = lambda b: F.when(F.aggregate(hashes, F.lit(0), vote(b)) > 0, F.call_function("shiftleft", one, b)).otherwise(none)
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), none, lambda acc, x: acc.bitwiseOR(x))


def _blocks(f: str) -> Column:
    """(block number, its bits) of a fingerprint."""
    mask = F.lit((1 << BLOCK_BITS) - 1).cast("long")
    return F.array(*[F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(F.col(f), b * BLOCK_BITS).bitwiseAND(mask).alias("bits")) for b in range(BLOCKS)])


def _changes() -> Column:
    """All masks of a block with at most BLOCK_RADIUS bits."""
    return F.filter(F.sequence(F.lit(0).cast("long"), F.lit((1 << BLOCK_BITS) - 1).cast("long")), lambda m: F.bit_count(m) <= BLOCK_RADIUS)


def within_radius(windows: DataFrame, items: DataFrame) -> DataFrame:
    """windows (length, f, ..) with the items (item_id, length, fingerprint) of their length whose fingerprint differs in at most RADIUS bits: the multi-index join. An item has some 2,800 postings."""
    left = windows.withColumn("b", F.explode(_blocks("f"))).select(*windows.columns, "b.block", "b.bits")
    posted = items.select("item_id", "length", F.col("fingerprint").alias("g"), F.explode(_blocks("fingerprint")).alias("b"))
    posted = posted.select("item_id", "length", "g", F.col("b.block").alias("block"), F.explode(F.transform(_changes(), lambda m: m.bitwiseXOR(F.col("b.bits")))).alias("bits"))
    # Merged: the size of exploded rows is not estimated, so Spark would broadcast them whatever their number.
    found = left.join(posted.hint("merge"), ["length", "block", "bits"])
    return found.where(F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= RADIUS).select(*windows.columns, "item_id").distinct()


def shared_weight(a: Column, b: Column) -> Column:
    """Sum over shingles of the smaller of their counts in a and b."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))


def _shingles_of_item(k: Column, hashes: Column) -> Column:
    out = _shingles(hashes, SHINGLE)
    for s in range(1, SHINGLE):
        out = F.when(k == s, _shingles(hashes, s)).otherwise(out)
    return out


def benchmark_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, length, shingles, fingerprint). An item of fewer than five words has one shingle, its whole sequence. Items without words are left out."""
    h = benchmark.select(col(id_col).alias("item_id"), _hashed(words_of(col(text_col))).alias("hashes"))
    h = h.withColumn("length", F.size("hashes")).where("length > 0")
    return h.select("item_id", "length", _shingles_of_item(F.col("length"), F.col("hashes")).alias("shingles"), fingerprint(F.col("hashes")).alias("fingerprint"))


def rare_shingles(items: DataFrame, threshold: int) -> DataFrame:
    """(item_id, length, h): an item's rarest shingles, so many that a window of the threshold's similarity has one of them.

    Such a window shares a weight of threshold percent of the item's at least, so it lacks fewer of the item's
    shingles than are listed here. Rare: in few items of that length.
    """
    each = items.select("item_id", "length", "shingles", F.posexplode("shingles").alias("offset", "h"))
    often = items.select("length", F.explode(F.array_distinct("shingles")).alias("h")).groupBy("length", "h").agg(F.count("*").alias("items"))
    ranked = each.join(often, ["length", "h"]).groupBy("item_id", "length", "shingles").agg(F.array_sort(F.collect_list(F.struct("items", "h", "offset"))).alias("r"))
    n = F.size("shingles")
    most = n - F.ceil(n * threshold / 100).cast("int") + 1
    return ranked.select("item_id", "length", F.explode(F.slice("r", F.lit(1), F.greatest(F.lit(1), most))).alias("e")).select("item_id", "length", "e.h").distinct()


def contaminations(docs: DataFrame, benchmark: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, text_hash, item_id, contaminated, similarity, start, length): one row for each document and item that match.

    contaminated is true throughout; start and length are the window's first word and number of words,
    those of the most similar window, the first of equals. A match has 100 * shared >= threshold * all weight. A
    null or empty text, or item, matches nothing; a document shorter than an item is one window. Null
    and repeated ids keep their rows apart by text; equal rows are one. Empty tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    items = cut(benchmark_items(benchmark, item_col), "items")
    seeds = items.select("length", F.posexplode("shingles").alias("offset", "h")).groupBy("h", "length", "offset").agg(F.lit(1).alias("one")).drop("one")
    seeds = cut(seeds, "item-shingles")
    n_seeds, n_items = seeds.count(), items.count()
    short = [r[0] for r in items.where(F.col("length") < SHINGLE).select("length").distinct().collect()]

    base = docs.select(col(id_col).cast("long").alias("doc_id"), F.xxhash64(col(text_col)).alias("text_hash"), col(text_col).alias("text"))
    h = base.where("text IS NOT NULL").select("doc_id", "text_hash", _hashed(words_of(F.col("text"))).alias("hashes"))
    # Each shingle array stands in one Generate, so that it is made once for a document.
    parts = [h.select("doc_id", "text_hash", F.size("hashes").alias("n"), F.posexplode(_shingles(F.col("hashes"), k)).alias("pos", "h")) for k in (SHINGLE, *short)]
    all_shingles = parts[0]
    for p in parts[1:]:
        all_shingles = all_shingles.unionByName(p)
    small, few_items = n_seeds <= BROADCAST_ROWS, n_items <= BROADCAST_ROWS // 100
    hits = all_shingles.join(F.broadcast(seeds) if small else seeds, "h")
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("offset"), F.col("n") - F.col("length"))).alias("start")
    windows = cut(hits.select("doc_id", "text_hash", "length", start).distinct(), "windows")

    ids = windows.select("doc_id", "text_hash").distinct()
    ids = cut(ids.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")), "window-documents")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))
    few = ids.count() <= BROADCAST_ROWS
    texts = base.join(F.broadcast(ids) if few else ids, same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    texts = texts.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), _hashed(words_of(F.col("text"))).alias("hashes"))
    laid = windows.join(texts, same).select("doc_id", "text_hash", "start", "length", F.slice("hashes", F.col("start") + 1, F.col("length")).alias("hashes"))
    laid = laid.select("doc_id", "text_hash", "start", "length", _shingles_of_item(F.col("length"), F.col("hashes")).alias("w"), fingerprint(F.col("hashes")).alias("f"))
    laid = cut(laid, "fingerprints")

    near = within_radius(laid.select("doc_id", "text_hash", "start", "length", "f"), items).drop("f")
    held = laid.select("doc_id", "text_hash", "start", "length", F.explode(F.array_distinct("w")).alias("h"))
    rare = rare_shingles(items, threshold)
    by_rare = held.join(F.broadcast(rare) if small and few_items else rare, ["length", "h"]).select("doc_id", "text_hash", "start", "length", "item_id")
    near = near.unionByName(by_rare).distinct()

    weights = items.select(F.col("item_id").alias("i"), F.col("shingles").alias("v"))
    pairs = near.join(F.broadcast(weights) if few_items else weights, F.col("item_id").eqNullSafe(F.col("i"))).alias("p")
    on = F.expr("p.doc_id <=> l.doc_id AND p.text_hash = l.text_hash AND p.start = l.start AND p.length = l.length")
    both = pairs.join(laid.alias("l"), on).select("p.doc_id", "p.text_hash", "p.item_id", "p.start", "p.length", "w", "v")
    both = both.withColumn("shared", shared_weight(F.col("w"), F.col("v"))).withColumn("all", F.size("w") + F.size("v") - F.col("shared"))
    sure = both.where(F.col("shared") * 100 >= F.col("all") * threshold).withColumn("similarity", F.col("shared") / F.col("all"))
    best = sure.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"), "length")).alias("m"))
    return best.select("doc_id", "text_hash", "item_id", F.lit(True).alias("contaminated"), F.col("m.similarity").alias("similarity"), (-F.col("m.before")).alias("start"), F.col("m.length").alias("length"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that match no item. Columns as in docs, whatever their names.

    Rows with a null or empty text match nothing and stay; repeated rows stay or go together; rows that repeat an id are judged each by its
    own text, null ids too. Empty tables are as for contaminations().
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    found = cut(contaminations(docs, benchmark, **options).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).distinct(), "contaminated")
    few = found.count() <= BROADCAST_ROWS
    kept = [f"c{i}" for i in range(len(docs.columns))]
    doc, text = (F.col(kept[docs.columns.index(c)]) for c in (id_col, text_col))
    rows = docs.toDF(*kept)
    return rows.join(F.broadcast(found) if few else found, doc.cast("long").eqNullSafe(F.col("d")) & (F.xxhash64(text) == F.col("t")), "left_anti").toDF(*docs.columns)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("text_hash")


#: DuckDB SQL for op7_decontamination: the same windows, without fingerprints.
ORACLE = r"""
WITH it AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i5 AS (SELECT item_id, len(w) AS length, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) AS v FROM it WHERE len(w) >= 5),
d5 AS (SELECT doc_id, len(w) AS n, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) AS s FROM dw WHERE len(w) >= 5),
isd AS (SELECT DISTINCT length, unnest(v) AS h, unnest(range(0, len(v))) AS o FROM i5),
ds AS (SELECT doc_id, n, unnest(s) AS h, unnest(range(0, len(s))) AS pos FROM d5),
win AS (SELECT DISTINCT doc_id, length, greatest(0, least(pos - o, n - length)) AS start FROM ds JOIN isd USING (h)),
ws AS (SELECT win.doc_id, win.length, win.start, s[win.start + 1 : win.start + win.length - 4] AS w FROM win JOIN d5 USING (doc_id)),
a AS (SELECT doc_id, length, start, x, count(*) AS c FROM (SELECT doc_id, length, start, unnest(w) AS x FROM ws) GROUP BY ALL),
b AS (SELECT item_id, length, x, count(*) AS c FROM (SELECT item_id, length, unnest(v) AS x FROM i5) GROUP BY ALL),
m AS (SELECT doc_id, item_id, a.length, start, sum(least(a.c, b.c)) AS shared FROM a JOIN b ON a.x = b.x AND a.length = b.length GROUP BY ALL),
q AS (SELECT m.doc_id, m.item_id, m.length, m.start, m.shared, len(ws.w) + len(i5.v) - m.shared AS total
      FROM m JOIN ws ON m.doc_id = ws.doc_id AND m.length = ws.length AND m.start = ws.start JOIN i5 ON m.item_id = i5.item_id)
SELECT doc_id, item_id, true AS contaminated, shared::DOUBLE / total::DOUBLE AS similarity, CAST(start AS INTEGER) AS start, CAST(length AS INTEGER) AS length
FROM q WHERE shared * 100 >= total * 80
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared::DOUBLE / total::DOUBLE DESC, start, length DESC) = 1
"""
