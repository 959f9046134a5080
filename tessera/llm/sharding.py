"""Sharding by fixed virtual slots.

A record's id and text hash to one of thousands of virtual slots, for good. Bytes are summed for each slot; a
map, stored with a version, says which shard holds a slot. The first map gives the slots, largest
first, to the shard that holds least; adding shards edits the map by moving single slots and writes
the next version. Everything that touches records is DataFrame code; only the slot totals, at most
`slots` rows, reach the driver.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, crc_table, cut, fresh_path, placed, read_table

SLOTS = 6144
SHARDS = 24


@dataclass
class SlotMap:
    """Which shard holds each virtual slot. `totals` has (bytes, rows) by slot, as of this version."""

    shards: int
    shard_of: list[int]
    totals: list[tuple[int, int]] = field(default_factory=list)
    version: int = 1

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += self.totals[slot][0]
        return out

    def rows(self) -> list[tuple[int, int, int, int, int, int]]:
        """(slot, shard, bytes, rows, base, version); base: rows of the shard in its lower slots."""
        base, out = [0] * self.shards, []
        for slot, shard in enumerate(self.shard_of):
            size, n = self.totals[slot]
            out.append((slot, shard, size, n, base[shard], self.version))
            base[shard] += n
        return out


def first_map(totals: list[tuple[int, int]], shards: int) -> SlotMap:
    """Slots in order of falling bytes, each to the shard with the fewest bytes so far; ties to the lower number."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    heap = [(0, shard) for shard in range(shards)]
    shard_of = [0] * len(totals)
    for slot in sorted(range(len(totals)), key=lambda s: (-totals[s][0], s)):
        size, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (size + totals[slot][0], shard))
    return SlotMap(shards, shard_of, list(totals))


def rebalanced(old: SlotMap, shards: int) -> SlotMap:
    """The next version, for at least as many shards: slots move into the new shards only.

    Each move takes, from the fullest old shard, its largest slot that the emptiest new shard still
    has room for under the mean; no other record moves.
    """
    if shards < old.shards:
        raise ValueError("a map is edited for more shards, not for fewer")
    new = SlotMap(shards, list(old.shard_of), list(old.totals), old.version + 1)
    if shards == old.shards:
        return new
    loads = new.loads()
    mean = sum(loads) / shards
    held: dict[int, list[int]] = {s: [] for s in range(shards)}
    for slot in sorted(range(len(new.shard_of)), key=lambda s: new.totals[s][0]):
        held[new.shard_of[slot]].append(slot)
    old_heap = [(-loads[s], s) for s in range(old.shards)]
    new_heap = [(0, s) for s in range(old.shards, shards)]
    heapq.heapify(old_heap)
    heapq.heapify(new_heap)
    while old_heap and new_heap:
        load, giver = heapq.heappop(old_heap)
        if -load <= mean:
            break
        filled, taker = heapq.heappop(new_heap)
        at = next((i for i in range(len(held[giver]) - 1, -1, -1) if 0 < new.totals[held[giver][i]][0] <= mean - filled), None)
        if at is None:
            heapq.heappush(new_heap, (filled, taker))  # this shard has no slot that fits; the others may have
            continue
        slot = held[giver].pop(at)
        new.shard_of[slot] = taker
        heapq.heappush(old_heap, (load + new.totals[slot][0], giver))
        heapq.heappush(new_heap, (filled + new.totals[slot][0], taker))
    return new


def save_map(spark: SparkSession, slot_map: SlotMap, path: str) -> DataFrame:
    """Writes the map below path/version=N, one row a slot, and returns it as read back."""
    kind = "virtual_slot int, shard int, slot_bytes long, slot_rows long, base long, map_version int"
    spark.createDataFrame(slot_map.rows(), kind).coalesce(1).write.parquet(f"{path}/version={slot_map.version}")
    return spark.read.schema(kind).parquet(f"{path}/version={slot_map.version}")


def load_map(spark: SparkSession, path: str, version: int, shards: int) -> SlotMap:
    rows = sorted(spark.read.parquet(f"{path}/version={version}").collect(), key=lambda r: r["virtual_slot"])
    return SlotMap(shards, [r["shard"] for r in rows], [(r["slot_bytes"], r["slot_rows"]) for r in rows], version)


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(col(text_col).cast("binary"), F.lit(b""))
    return docs.select(col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"))


def _slot(slots: int, *cols: Column) -> Column:
    """A slot from 48 bits of the md5 of the columns' text."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("-")) for c in cols])
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long"), F.lit(slots)).cast("int")


def slotted(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot): size is UTF-8 bytes plus 8; a null text has no bytes and crc32 0.

    The slot is a hash of id and text, so equal texts of different ids are spread over the slots. Rows equal in both share a slot, however many they are: no row's
    slot depends on other rows.
    """
    return cut(_narrow(docs, id_col, text_col).withColumn("virtual_slot", _slot(slots, F.col("doc_id"), F.col("text_crc32"))), "slotted")


def slot_totals(narrow: DataFrame, slots: int = SLOTS) -> list[tuple[int, int]]:
    """(bytes, rows) of each slot, from partial sums: at most `slots` rows come to the driver."""
    totals = [(0, 0)] * slots
    for r in narrow.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        totals[r["virtual_slot"]] = (r["b"], r["n"])
    return totals


def assign_shards(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> DataFrame:
    """Every row of docs with its shard and its place there, by the `bytes` law: shard sizes come out near equal.

    Returns doc_id, size, text_crc32, law, shard, slot (the row's place in its shard, from 0 without
    gaps), grown_shard (null: the law is not `key`), virtual_slot, map_version. Equal texts of different ids are no group here: they are
    spread like any others, so a text that many rows share fills no shard. Repeated rows (id and text) are kept in one shard,
    each with its own place; places are counted by a range sort, so a slot of any size is many tasks' work. A null id hashes like any other value, so its text decides its slot. An empty
    table gives no rows. Columns other than the two named ones are neither read nor returned.
    """
    spark = docs.sparkSession
    narrow = slotted(docs, slots, id_col, text_col)
    held = save_map(spark, first_map(slot_totals(narrow, slots), shards), map_path or fresh_path(spark, "slot-map"))
    counted = narrow.withColumn("row", F.monotonically_increasing_id())
    return (
        placed(counted, "virtual_slot", "doc_id", "text_crc32", "size", "row", index="place", total="of")
        .join(F.broadcast(held), "virtual_slot")  # `slots` rows, by construction
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("base") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
        )
    )


def write_shards(docs: DataFrame, slot_map: DataFrame, path: str, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes whole records below path/shard=N by a stored map. Work is dealt by virtual slot, so no task holds a shard.

    Columns of docs keep their names, but for one called shard, which the folder's number replaces.
    """
    text = F.coalesce(col(text_col).cast("binary"), F.lit(b""))
    names = [f"c{i}" for i in range(len(docs.columns))]
    keyed = docs.select(*[col(c).alias(n) for c, n in zip(docs.columns, names, strict=True) if c.lower() != "shard"], _slot(slots, col(id_col), F.crc32(text)).alias("virtual_slot"))
    placed = keyed.join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot").repartition("virtual_slot")  # `slots` rows, by construction
    placed.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True) if c.lower() != "shard"], "shard").write.partitionBy("shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(read_table(spark, sf_dir, "documents"))


#: DuckDB SQL for op1_sharding, with crc32 byte by byte and the first map slot by slot: the largest to the shard that holds least.
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
         xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)),
             lambda c, x: xor(c >> 8, list_extract({crc_table()}::BIGINT[], (xor(c, x) & 255) + 1))), 4294967295::BIGINT) AS text_crc32
  FROM documents),
v AS (SELECT *, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || text_crc32), 1, 12) AS BIGINT) % {SLOTS} AS INTEGER) AS virtual_slot FROM d),
o AS (SELECT virtual_slot, sum(size)::BIGINT AS b, row_number() OVER (ORDER BY sum(size) DESC, virtual_slot) AS k FROM v GROUP BY virtual_slot),
g AS (
  SELECT CAST(0 AS BIGINT) AS k, list_transform(range({SHARDS}), lambda i: 0::BIGINT) AS loads, -1 AS virtual_slot, 0 AS shard
  UNION ALL
  SELECT k, list_transform(range({SHARDS}), lambda i: loads[i + 1] + CASE WHEN i = least_one THEN b ELSE 0 END), virtual_slot, CAST(least_one AS INTEGER)
  FROM (SELECT o.k, o.b, o.virtual_slot, loads, list_position(loads, list_min(loads)) - 1 AS least_one FROM g JOIN o ON o.k = g.k + 1))
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
       CAST(NULL AS INTEGER) AS grown_shard, virtual_slot, 1 AS map_version
FROM v JOIN g USING (virtual_slot)
"""
