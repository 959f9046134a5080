"""Prefix trie of conversations, by partition refinement.

Conversations equal throughout count as one, with their number. All start in one class, the root. A round takes one turn: the active
conversations' next turns split each class into the classes of those that continue alike, which are the trie's nodes of that depth. A class's name is
a digest of its parent's name and the turn, so splitting needs no join between conversations. A class of a single
distinct conversation is retired: it can't split any more, and its remaining turns are a unary chain, made for all retired ones together at the end.
Rounds end when all classes are retired. Then numbers of leaves and saved bytes are folded back, deepest nodes first.

Only ids, digests and sizes of turns move; texts are read once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, crc_table, cut, fresh_path, looked_up, placed, read_table

#: In the rebuilt table, a conversation begins as the one at the last multiple of EVERY, for fewer than HEADS turns.
EVERY, HEADS = 5, 9
#: Ids, and turns, that are joined or summed up together.
BLOCK = 4096
NOTHING = hashlib.sha256(b"").hexdigest()
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_key(role: Column, text: Column) -> Column:
    """A digest of role and text."""
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)


def ordered_turns(convs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, total, key, bytes): every turn with its place from 1 in its conversation and the conversation's number of turns.

    Turns ascend, null first, ties by their key; repeated rows are turns of their own. A null role or text counts as empty; rows without a
    conversation id belong to none and are left out. Other columns are not read.
    """
    role, text = (F.coalesce(col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = convs.select(col(id_col).cast("long").alias("conv"), col(turn_col).cast("long").alias("turn"), turn_key(role, text).alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    rows = cut(rows.where("conv IS NOT NULL"), "turns").withColumn("row", F.monotonically_increasing_id())
    found = placed(rows, "conv", "turn", "key", "row", index="at", total="total")
    return cut(found.select("conv", (F.col("at") + 1).alias("place"), "total", "key", "bytes"), "ordered")


def rebuilt(turns: DataFrame, every: int = EVERY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(turns (conv, place, key, bytes), conversations (conv, total)), rebuilt from ordered_turns().

    Conversation c starts with the first h turns of conversation c - c % every (all if it has fewer, none if there is no such one), h = crc32 of c modulo `heads`;
    then come its own turns after its first h.
    """
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("long")
    convs = turns.where("place = 1").select("conv", "total", h.alias("h"), (F.col("conv") - F.col("conv") % every).alias("base"))
    bases = turns.where("place = 1").select(F.col("conv").alias("base"), F.col("total").alias("has"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("has", F.lit(0).cast("long"))))
    convs = cut(convs.select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("total") - F.col("h"), F.lit(0))).cast("long").alias("total")), "rebuilt")
    first = turns.where(F.col("place") < heads).select(F.col("conv").alias("base"), "place", "key", "bytes")
    first = first.join(convs.select("base", "conv", "taken"), "base").where("place <= taken").select("conv", "place", "key", "bytes")
    own = looked_up(turns.where(F.col("place") > h), cut(convs.where("taken < h").select("conv", "taken"), "short"), ["conv"], "left")
    own = own.select("conv", (F.col("place") - h + F.coalesce("taken", h)).alias("place"), "key", "bytes")
    return cut(first.unionByName(own), "rebuilt-turns"), convs.select("conv", "total")


def whole_conversations(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, rep, total, n): rep is the least of the n conversations that are equal throughout.

    A conversation's signature is its number of turns and two XORs of 64-bit hashes of place and turn, which a hot conversation's rows make in partial sums.
    """
    signs = [F.bit_xor(F.xxhash64(F.lit(seed), F.col("place"), F.col("key"))).alias(f"x{seed}") for seed in (1, 2)]
    signed = convs.join(turns.groupBy("conv").agg(*signs), "conv", "left").select("conv", "total", *[F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("x1", "x2")])
    signed = cut(signed, "signatures")
    same = ["total", "x1", "x2"]
    return cut(looked_up(signed, cut(signed.groupBy(*same).agg(F.min("conv").alias("rep"), F.count("*").alias("n")), "copies"), same).select("conv", "rep", "total", "n"), "whole")


def _id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, ends_sha256) from rows (rep, block, ids) in that order."""
    rep, digest = None, None
    for batch in batches:
        out = []
        for r, _, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if r == rep:
                digest.update(b"," + ids.encode())
            else:
                if rep is not None:
                    out.append((rep, digest.hexdigest()))
                rep, digest = r, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], ["rep", "ends_sha256"])
    if rep is not None:
        yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([digest.hexdigest()])], ["rep", "ends_sha256"])


def id_digests(whole: DataFrame) -> DataFrame:
    """(rep, ends_sha256): SHA-256 of the ids of equal conversations, ascending, comma-joined.

    Ids are joined in blocks by many tasks. The hash itself has no parts: one task reads a group's blocks, one at a time.
    """
    alone = whole.where("n = 1").select("rep", F.sha2(F.col("rep").cast("string").cast("binary"), 256).alias("ends_sha256"))
    many = placed(whole.where("n > 1").select("rep", "conv"), "rep", "conv", total="of")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",")
    blocks = many.groupBy("rep", F.floor(F.col("idx") / BLOCK).alias("block")).agg(ids.alias("ids"))
    return alone.unionByName(blocks.repartition("rep").sortWithinPartitions("rep", "block").mapInArrow(_id_digests, "rep long, ends_sha256 string"))


def _suffix_sums(tails: DataFrame) -> DataFrame:
    """tails with `onward`, the bytes of a conversation's turns from each one on: inside blocks of turns and over the blocks."""
    blocks = tails.withColumn("block", F.floor(F.col("place") / BLOCK))
    sums = blocks.groupBy("conv", "block").agg(F.sum("bytes").alias("b"))
    later = F.coalesce(F.sum("b").over(Window.partitionBy("conv").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("bytes").over(Window.partitionBy("conv", "block").orderBy(F.desc("place")))
    return blocks.withColumn("within", within).join(sums.select("conv", "block", later.alias("later")), ["conv", "block"]).select(*tails.columns, (F.col("within") + F.col("later")).alias("onward"))


def _refined(turns: DataFrame, whole: DataFrame, path: str) -> int:
    """Writes path/0, path/1, ...: the nodes (class, node, depth, head, n, bytes, kinds, total, ender) of each depth; returns the last depth.

    kinds: distinct conversations in the node; ender: the one that ends there.
    """
    spark = whole.sparkSession
    root = F.lit("")
    active = whole.where("conv = rep").select("conv", root.alias("class"), "n", "total")
    ender = F.max(F.when(F.col("total") == F.col("depth"), F.col("conv"))).alias("ender")
    numbers = [F.min("conv").alias("head"), F.sum("n").alias("n"), F.max("bytes").alias("bytes"), F.count("*").alias("kinds"), F.max("total").alias("total"), ender]
    start = active.withColumns({"node": root, "depth": F.lit(0).cast("long"), "bytes": F.lit(0).cast("long")})
    start.groupBy("class", "node", "depth").agg(*numbers).write.parquet(f"{path}/0")
    depth = 0
    while True:
        depth += 1
        going = active.where(F.col("total") >= depth)
        step = turns.where(F.col("place") == depth).select("conv", "key", "bytes").join(going, "conv")
        step = cut(step.select("conv", "class", F.sha2(F.concat("class", "key").cast("binary"), 256).alias("node"), F.lit(depth).cast("long").alias("depth"), "bytes", "n", "total"), "turn")
        step.groupBy("class", "node", "depth").agg(*numbers).write.parquet(f"{path}/{depth}")
        made = spark.read.parquet(f"{path}/{depth}")
        if not made.where("kinds > 1").take(1):
            return depth
        alone = made.where("kinds = 1").select(F.col("head").alias("conv"))
        active = step.join(alone, "conv", "left_anti").select("conv", F.col("node").alias("class"), "n", "total")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie over turns (conv, place, key, bytes) and conversations (conv, total), both written tables; see COLUMNS.

    conv_id: the node's least conversation; parent_conv_id: its parent's, null for the root; n_convs; n_children; n_leaves: childless nodes in its subtree,
    itself included; saved_tokens: over the subtree, (n_convs - 1) times the bytes of each node's last text; ends_sha256: see id_digests(), of those
    that end at the node. Conversations without turns end at the root. An empty table has no nodes.
    """
    spark = turns.sparkSession
    whole = whole_conversations(turns, convs)
    ends = cut(id_digests(whole), "ends")
    path, folds = fresh_path(spark, "trie"), fresh_path(spark, "trie-folds")
    last = _refined(turns, whole, path)
    nodes = [spark.read.parquet(f"{path}/{d}") for d in range(last + 1)]
    shared = [nodes[0], *[x.where("kinds > 1") for x in nodes[1:]]]

    # Unary chains of the retired classes.
    retired = cut(spark.read.parquet(*[f"{path}/{d}" for d in range(1, last + 1)]).where("kinds = 1").select(F.col("head").alias("conv"), "class", F.col("depth").alias("since"), "n", "total"), "retired")
    chain = looked_up(turns.select("conv", "place", "bytes"), retired.drop("class"), ["conv"]).where("place >= since")
    saving = _suffix_sums(chain.where("n > 1")).withColumn("saved", (F.col("n") - 1) * F.col("onward")).drop("onward")
    chain = cut(chain.where("n = 1").withColumn("saved", F.lit(0).cast("long")).unionByName(saving), "chains")
    begun = retired.join(chain.where("place = since").select("conv", "saved"), "conv").select("class", "conv", "since", "saved")

    # Shared nodes, deepest first, with the heads of the classes above.
    begun = cut(begun.select("class", F.col("since").alias("depth"), F.lit(1).cast("long").alias("leaves"), "saved", "conv"), "begun")
    below = None
    for d in range(last, -1, -1):
        kids = begun.where(F.col("depth") == d + 1).select("class", "leaves", "saved")
        kids = kids if below is None else kids.unionByName(below.select("class", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
        kids = kids.groupBy(F.col("class").alias("node")).agg(F.count("*").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        folded = shared[d].join(kids, "node", "left").select(
            "class", "node", "depth", F.col("head").alias("conv_id"), F.col("n").alias("n_convs"), F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("bytes") + F.coalesce("saved", F.lit(0))).cast("long").alias("saved_tokens"), "ender",
        )
        folded.write.parquet(f"{folds}/{d}")
        below = spark.read.parquet(f"{folds}/{d}")
    tops = spark.read.parquet(*[f"{folds}/{d}" for d in range(last + 1)])
    heads = cut(tops.select(F.col("node").alias("class"), F.col("conv_id").alias("parent_conv_id")), "heads")
    upper = looked_up(tops.where("depth > 0"), heads, ["class"]).unionByName(tops.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    at_end = upper.where("ender IS NOT NULL").join(ends.withColumnRenamed("rep", "ender"), "ender").select(*COLUMNS)
    upper = at_end.unionByName(upper.where("ender IS NULL").select(*COLUMNS[:-1], F.lit(NOTHING).alias("ends_sha256")))
    parents = looked_up(begun.select("class", "conv"), heads, ["class"]).select("conv", "parent_conv_id")
    one = F.lit(1).cast("long")
    row = lambda parent, ends_at, children: [F.col("conv").alias("conv_id"), F.col("place").alias("depth"), parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), children.cast("long").alias("n_children"), one.alias("n_leaves"), F.col("saved").alias("saved_tokens"), ends_at]
    chain = chain.withColumn("children", (F.col("place") < F.col("total")).cast("long"))
    # Two rows of a chain need a join: its first, for its parent, and its last, for those that end there.
    edge = chain.where("place = since OR place = total").join(parents, "conv").join(ends.withColumnRenamed("rep", "conv"), "conv")
    parent = F.when(F.col("place") == F.col("since"), F.col("parent_conv_id")).otherwise(F.col("conv"))
    edge = edge.select(*row(parent, F.when(F.col("children") == 0, F.col("ends_sha256")).otherwise(NOTHING).alias("ends_sha256"), F.col("children")))
    inner = chain.where("place > since AND place < total").select(*row(F.col("conv"), F.lit(NOTHING).alias("ends_sha256"), F.col("children")))
    return upper.unionByName(edge).unionByName(inner)


def conversation_trie(convs: DataFrame, **names: str) -> DataFrame:
    """prefix_trie() of a table of conversations as they are; names: see ordered_turns(), which tells what nulls, ties and repeated rows do."""
    turns = ordered_turns(convs, **names)
    return prefix_trie(turns.drop("total"), turns.where("place = 1").select("conv", "total"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt so that they share beginnings."""
    return prefix_trie(*rebuilt(ordered_turns(read_table(spark, sf_dir, "conversations"))))


#: DuckDB SQL for op11_prefix_trie: nodes are distinct prefixes; a node's subtree are the nodes whose least conversation passes it.
ORACLE = f"""
WITH o AS (
  SELECT conv_id AS c, k, octet_length(encode(text)) AS bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS p
  FROM (SELECT conv_id, turn, text, sha256(length(role) || ':' || role || text) AS k FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))),
t AS (
  SELECT c, count(*) AS total, c - c % {EVERY} AS base,
         xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(CAST(c AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS BIGINT)),
             lambda a, x: xor(a >> 8, list_extract({crc_table()}::BIGINT[], (xor(a, x) & 255) + 1))), 4294967295::BIGINT) % {HEADS} AS h
  FROM o GROUP BY c),
x AS (SELECT t.c, t.base, t.h, least(t.h, coalesce(b.total, 0)) AS taken FROM t LEFT JOIN t b ON b.c = t.base),
r AS (
  SELECT x.c, o.p AS place, o.k, o.bytes FROM x JOIN o ON o.c = x.base AND o.p <= x.taken
  UNION ALL SELECT x.c, o.p - x.h + x.taken, o.k, o.bytes FROM x JOIN o ON o.c = x.c AND o.p > x.h),
m AS (
  SELECT c, 0 AS place, '' AS id, NULL AS above, 0 AS bytes FROM x
  UNION ALL SELECT c, place, sha256(string_agg(k, '') OVER w), CASE WHEN place = 1 THEN '' ELSE sha256(string_agg(k, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) END, bytes
  FROM r WINDOW w AS (PARTITION BY c ORDER BY place)),
l AS (SELECT c, max(place) AS total FROM m GROUP BY c),
n AS (
  SELECT place, id, any_value(above) AS above, min(m.c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
         sha256(coalesce(string_agg(CASE WHEN place = total THEN CAST(m.c AS VARCHAR) END, ',' ORDER BY m.c), '')) AS ends_sha256
  FROM m JOIN l ON l.c = m.c GROUP BY place, id),
k AS (SELECT above, place - 1 AS place, count(*) AS kids FROM n WHERE above IS NOT NULL GROUP BY above, place),
f AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k ON k.above = n.id AND k.place = n.place),
s AS (SELECT m.place, m.id, sum((f.n_convs - 1) * f.bytes) AS saved, count(*) FILTER (f.kids = 0) AS leaves FROM f JOIN m ON m.c = f.conv_id AND m.place <= f.place GROUP BY m.place, m.id)
SELECT f.conv_id, CAST(f.place AS BIGINT) AS depth, a.conv_id AS parent_conv_id, f.n_convs, CAST(f.kids AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s ON s.place = f.place AND s.id = f.id LEFT JOIN n a ON a.id = f.above AND a.place = f.place - 1
"""
