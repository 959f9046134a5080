"""Merkle manifest of a dataset: a tree of hashes for each source, and one over the sources.

A leaf is the hash of a row. Leaves are range-sorted and numbered, so each partition holds runs of consecutive leaves. Over
a run a stack of peaks is kept, one for each level: whenever a level holds a whole block of `fanout` nodes, the carry
makes their parent, a node record, and pushes it a level up. The last block of a level may be shorter; it is hashed as it is,
without padding. Blocks that begin or end in another run cannot be finished there: their nodes are left as open edges, and
these few are merged level by level over all runs. Proofs come top down: a block's row knows the way from it to the
root, and hands it on to its nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, crc_table, cut, placed, read_table

FANOUT = 16
#: Characters of a hash.
HEX = 64
NODES = "key string, level int, idx long, n long, hash string, kids string, open boolean"
#: What a proof holds at one level: the siblings before and after the node, hashes in a row.
STEP = "array<struct<before:string,after:string>>"


@dataclass
class Forest:
    """A tree for each key. leaves (key, idx, n, ...), nodes (key, level, idx, n, hash, kids) above the leaves, roots (key, root, depth)."""

    leaves: DataFrame
    nodes: DataFrame
    roots: DataFrame
    depth: int
    fanout: int


def field(c: Column) -> Column:
    """A value as a leaf's input: - if it is null, else its UTF-8 bytes' number, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def group_key(c: Column) -> Column:
    """Text that is never null and sorts as c does: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def _width(n: int, level: int, fanout: int) -> int:
    return -(-n // fanout**level)


def _stacked(fanout: int):
    """The stack of peaks over rows (key, idx, n, hash), in any number of runs of consecutive leaves; see NODES for what it emits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        peaks: list[list[str]] = []  # for each level, hashes of consecutive nodes without a parent yet
        first: list[int] = []  # and the place of the first of them
        key, n, last = None, 0, -1
        out: list[tuple] = []

        def left_open(level: int) -> None:
            out.extend((key, level, first[level] + i, n, h, None, True) for i, h in enumerate(peaks[level]))
            peaks[level] = []

        def push(level: int, idx: int, h: str) -> None:
            width = _width(n, level, fanout)
            while width > 1:  # a level of one node is the root
                if level == len(peaks):
                    peaks.append([])
                    first.append(0)
                if not peaks[level]:
                    first[level] = idx
                peaks[level].append(h)
                if (idx + 1) % fanout and idx + 1 < width:
                    return
                if first[level] % fanout:
                    return left_open(level)
                kids = "".join(peaks[level])
                peaks[level] = []
                level, idx, h, width = level + 1, idx // fanout, hashlib.sha256(kids.encode()).hexdigest(), -(-width // fanout)
                out.append((key, level, idx, n, h, kids, False))

        def emitted() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "level", "idx", "n", "hash", "kids", "open"])
            out.clear()
            return made

        for batch in batches:
            for k, idx, size, h in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k != key or idx != last + 1:
                    for level in range(len(peaks)):
                        left_open(level)
                    key, n = k, size
                last = idx
                push(0, idx, h)
            yield emitted()
        for level in range(len(peaks)):
            left_open(level)
        yield emitted()

    return run


def forest(leaves: DataFrame, fanout: int = FANOUT) -> Forest:
    """The trees over leaves (key, idx, n, hash, ...): idx counts from 0 to n - 1 in each key, which is never null."""
    if fanout < 2:
        raise ValueError("fanout must be at least 2")
    runs = leaves.select("key", "idx", "n", "hash").sortWithinPartitions("key", "idx").mapInArrow(_stacked(fanout), NODES)
    runs = cut(runs, "peaks")
    largest = leaves.agg(F.max("n")).first()[0] or 0
    depth = 0
    while _width(largest, depth, fanout) > 1:
        depth += 1
    nodes, made = runs.where("NOT open").drop("open"), None
    for level in range(depth):
        edges = runs.where(F.col("open") & (F.col("level") == level)).select("key", "n", "idx", "hash")
        if made is not None:
            wider = F.col("n") > fanout**level  # else it is a root
            edges = edges.unionByName(made.where(wider).select("key", "n", "idx", "hash"))
        block = F.floor(F.col("idx") / fanout).cast("long")
        kids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"]), "")  # at most `fanout`
        parents = edges.groupBy("key", "n", block.alias("block")).agg(kids.alias("kids"))
        made = parents.select("key", F.lit(level + 1).alias("level"), F.col("block").alias("idx"), "n", F.sha2(F.col("kids").cast("binary"), 256).alias("hash"), "kids")
        made = cut(made, "merged")
        nodes = nodes.unionByName(made)
    top = nodes.where((F.col("idx") == 0) & (F.col("n") <= F.pow(F.lit(float(fanout)), F.col("level")))).select("key", F.col("hash").alias("root"), F.col("level").alias("depth"))
    alone = leaves.where("n = 1").select("key", F.col("hash").alias("root"), F.lit(0).alias("depth"))
    return Forest(leaves, nodes, top.unionByName(alone), depth, fanout)


def _step(fanout: int, kids: Column, at: Column) -> Column:
    place = (at % fanout).cast("int")
    return F.array(F.struct(F.substring(kids, F.lit(1), place * HEX).alias("before"), F.substring(kids, (place + 1) * HEX + 1, F.lit(fanout * HEX)).alias("after")))


def proofs(f: Forest, above: DataFrame | None = None) -> DataFrame:
    """The leaves with `subroot`, their tree's root, and `proof`, a step for each level from the leaf to the top.

    above (key, proof): what follows behind each tree's root; None: nothing.
    """
    roots = f.roots.withColumn("proof", F.array().cast(STEP)) if above is None else f.roots.join(above, "key")
    roots = cut(roots.select("key", "root", "depth", "proof"), "roots")
    at = lambda level: roots.where(F.col("depth") == level).select("key", F.lit(0).cast("long").alias("idx"), "root", "proof")
    known = at(f.depth)
    for level in range(f.depth, 0, -1):
        blocks = f.nodes.where(F.col("level") == level).select("key", "idx", "kids").join(known, ["key", "idx"])
        if level == 1:
            known = blocks.select("key", "idx", "root", "proof", "kids")
            break
        rows = blocks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), (F.length("kids") / HEX - 1).cast("long"))).alias("place"))
        known = rows.select("key", (F.col("idx") * f.fanout + F.col("place")).alias("idx"), "root", F.concat(_step(f.fanout, F.col("kids"), F.col("place")), "proof").alias("proof")).unionByName(at(level - 1))
    if f.depth:
        known = known.unionByName(at(0).withColumn("kids", F.lit("")))
    else:
        known = known.withColumn("kids", F.lit(""))
    block = known.select(F.col("key").alias("k"), F.col("idx").alias("block"), F.col("root").alias("subroot"), "proof", "kids")
    rows = f.leaves.join(block, (F.col("key") == F.col("k")) & (F.floor(F.col("idx") / f.fanout).cast("long") == F.col("block")))
    whole = F.when(F.col("kids") == "", F.col("proof")).otherwise(F.concat(_step(f.fanout, F.col("kids"), F.col("idx")), "proof"))
    return rows.select(*f.leaves.columns, "subroot", whole.alias("proof"))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of a proof give."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]).cast("binary"), 256))


def proof_hash(proof: Column) -> Column:
    """Hash of a proof's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", id_col: str = "doc_id", fanout: int = FANOUT, changed: Column | None = None) -> DataFrame:
    """(doc_id, leaf, changed_leaf, subroot, root, proof): every row of docs as a leaf, with the way from it to the dataset's root.

    `changed`: a text (over docs) to set in place of the last field in changed_leaf; None: the field itself. Leaves ascend by id in each group, null
    ids first, and equal ids by hash; rows equal in all fields are leaves of their own. Groups ascend by their UTF-8 bytes, null first. Any field
    may be null. An empty table gives no rows. Columns other than the named ones are not read.
    """
    values = [col(c) for c in fields]
    leaf = leaf_hash(*values)
    other = leaf if changed is None else leaf_hash(*values[:-1], changed)
    rows = cut(docs.select(group_key(col(group)).alias("key"), col(id_col).alias("doc_id"), leaf.alias("hash"), other.alias("changed_leaf")), "leaves")
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # deals rows that are equal in all over partitions
    trees = forest(cut(placed(rows, "key", "doc_id", "hash", "row"), "leaves"), fanout)
    tops = trees.roots.select(F.lit("").alias("key"), F.col("key").alias("group"), F.col("root").alias("hash"))
    over = forest(cut(placed(tops, "key", "group"), "groups"), fanout)
    root = over.roots.first()
    above = proofs(over).select(F.col("group").alias("key"), "proof")
    found = proofs(trees, cut(above, "above"))
    return found.select("doc_id", F.col("hash").alias("leaf"), "changed_leaf", "subroot", F.lit(root["root"] if root else None).cast("string").alias("root"), "proof")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof, and what the proof says where texts were tampered with: lower-cased where 5 divides the id's crc32."""
    docs = read_table(spark, sf_dir, "documents")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = manifest(docs, changed=F.when(hit, lower).otherwise(F.col("text")))
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("proof")).alias("proof_sha256"), folded(F.col("changed_leaf"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels_sql(tag: str, rows: str, levels: int) -> str:
    """CTEs of a tree for each key over rows (key, idx, n, h): {tag}0, {tag}1, ... its levels, {tag}k0, ... their blocks and {tag}r (key, h) the roots."""
    out = [f"{tag}0 AS ({rows})"]
    for i in range(levels):
        out.append(f"{tag}k{i} AS (SELECT key, idx // {FANOUT} AS block, n, list(h ORDER BY idx) AS kids FROM {tag}{i} WHERE n > 1 GROUP BY key, idx // {FANOUT}, n)")
        out.append(f"{tag}{i + 1} AS (SELECT key, block AS idx, (n + {FANOUT - 1}) // {FANOUT} AS n, sha256(array_to_string(kids, '')) AS h FROM {tag}k{i})")
    roots = " UNION ALL ".join(f"SELECT key, h FROM {tag}{i} WHERE n = 1" for i in range(levels + 1))
    return ", ".join([*out, f"{tag}r AS ({roots})"])


def _folds_sql(name: str, start: str, tag: str, levels: int) -> str:
    """CTEs {name}0 (= start: doc_id, key, idx, orig, given, text, ...), {name}1, ... that fold the leaves up the levels; the last is {name}{levels}."""
    out = [f"{name}0 AS ({start})"]
    for i in range(levels):
        place = f"((idx // {FANOUT**i}) % {FANOUT})"
        before, after = f"array_to_string(kids[1:{place}], '')", f"array_to_string(kids[{place} + 2:], '')"
        up = lambda h: f"CASE WHEN kids IS NULL THEN {h} ELSE sha256({before} || {h} || {after}) END AS {h}"  # noqa: B023, E731
        out.append(
            f"{name}{i + 1} AS (SELECT doc_id, leaf, f.key, idx, sub, {up('given')}, CASE WHEN kids IS NULL THEN text ELSE text || {before} || {after} END AS text"
            f" FROM {name}{i} f LEFT JOIN {tag}k{i} b ON f.key = b.key AND b.block = f.idx // {FANOUT ** (i + 1)})"
        )
    return ", ".join(out)


def _oracle() -> str:
    put = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    head = " || ".join(put(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = f"""xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS BIGINT)),
        lambda c, x: xor(c >> 8, list_extract({crc_table()}::BIGINT[], (xor(c, x) & 255) + 1))), 4294967295::BIGINT)"""
    deep, wide = 6, 3
    return f"""
WITH d AS (SELECT *, coalesce({crc} % 5 = 0, false) AS hit FROM documents),
e AS (SELECT doc_id, coalesce('=' || source, '') AS key, sha256({head} || {put('text')}) AS leaf, CASE WHEN hit THEN sha256({head} || {put(lower)}) ELSE sha256({head} || {put('text')}) END AS given FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n FROM e),
{_levels_sql('x', 'SELECT key, idx, n, leaf AS h FROM o', deep)},
t AS (SELECT key AS name, row_number() OVER (ORDER BY encode(key)) - 1 AS idx, h FROM xr),
{_levels_sql('y', "SELECT 'all' AS key, idx, (SELECT count(*) FROM t) AS n, h FROM t", wide)},
{_folds_sql('f', "SELECT doc_id, leaf, key, idx, CAST(NULL AS VARCHAR) AS sub, given, '' AS text FROM o", 'x', deep)},
{_folds_sql('g', f"SELECT doc_id, leaf, 'all' AS key, t.idx AS idx, t.h AS sub, given, text FROM f{deep} JOIN t ON name = f{deep}.key", 'y', wide)}
SELECT doc_id, leaf, sub AS subroot, h AS root, sha256(text) AS proof_sha256, given AS folded_root, given = h AS verified FROM g{wide}, (SELECT h FROM yr)
"""


#: DuckDB SQL for op12_merkle_manifest: levels and folds written out, for up to 16 million leaves a source and 4,096 sources.
ORACLE = _oracle()
