"""Near-duplicate documents by SetSketch registers.

A document's set of word shingles gets registers: truncated logarithms of minima, to a base near 1, so registers of a
union are the larger ones and similar sets agree in many. Documents that agree in a whole band of
registers share a bucket. Postings are shuffled once, by bucket; a bucket streams by in order of its members and ties each
to its least one, so none is ever held. Ties whose joint likelihood estimate is far too low are cut. Members of a bucket
that were cut form a bucket of their own, and what is left after some rounds meets block by block, so that all likely
pairs of a bucket are tied, if by way of others. What is tied forms clusters. A cluster's documents are dealt into blocks of
a few hundred, in which all meet each other and some heads of the cluster: registers rule most pairs out, the full
shingle sets decide on the rest. Where that leaves a cluster in parts, only what is outside its largest part meets
everything else, again in blocks. Only links come out of a task, never pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from .common import col, cut, giving_back, read_table

#: 480 registers in 60 bands of 8. At a similarity of 0.8 a register agrees with probability 0.81:
#: all bands differ for six pairs in a million. Unrelated documents, at 0.02, share a band once in 10^12 pairs.
BANDS, ROWS = 60, 8
REGISTERS = BANDS * ROWS
#: SetSketch's base and rate, and its largest register value; sets of up to 1e9 members fit.
BASE, RATE, TOP = 1.1, 20.0, 255
#: A pair is ruled out if its estimate is this much below the threshold: five standard errors of 480 registers, or,
#: for the ties of buckets, six of the first 64, enough to cut chance meetings only.
MARGIN, LOOSE, JUDGED = 0.10, 0.30, 64
#: Rounds of ties to the least member; what the last one cuts meets pair by pair.
STARS = 2
#: Documents of a cluster, or of a bucket, that meet at once, and heads of a cluster that meet all its blocks.
BLOCK, HEADS = 256, 8
#: Rows about ids, some hundred bytes each, that are broadcast at most; beyond, the texts are shuffled to them.
BROADCAST_IDS = 500_000
#: Bytes of text, and texts at most, that are hashed at once.
_WORK, _ROWS = 1 << 19, 2048

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S32 = (np.uint64(x) for x in (30, 27, 31, 32))


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> _S30)) * _MIX1
    x = (x ^ (x >> _S27)) * _MIX2
    return x ^ (x >> _S31)


class Hasher:
    """64-bit hashes of word shingles, for many texts at once, and the registers of a set of them."""

    def __init__(self, words: int = 2, registers: int = REGISTERS, seed: int = 1):
        self.words, self.powers, self.inverse = words, np.ones(1, np.uint64), np.ones(1, np.uint64)
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 31, registers, np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, registers, np.uint32)
        self.space = np.empty((1024, registers), np.uint32)

    def _room(self, n: int) -> None:
        if len(self.powers) < n:
            step = np.full(n, _P)
            step[0] = 1
            self.powers = np.cumprod(step)
            step[1:] = np.uint64(pow(int(_P), -1, 1 << 64))
            self.inverse = np.cumprod(step)

    def shingles(self, norms: list[bytes]) -> list[np.ndarray]:
        """For each text (words joined by one space) the sorted distinct hashes of its shingles.

        A text with fewer words than a shingle has its whole sequence as the only one; none if it is empty.
        """
        data = np.frombuffer(b"\n".join(norms), np.uint8)
        if not len(data):
            return [np.empty(0, np.uint64) for _ in norms]
        self._room(len(data) + 1)
        visible = data > 32
        visible |= ~((data == 32) | (data == 10))
        edge = np.diff(visible.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=total[1:])
        word = _mixed((total[end] - total[start]) * self.inverse[start] ^ (end - start).astype(np.uint64) * _MIX2)
        begins = np.cumsum([0, *(len(x) + 1 for x in norms)])
        at = np.searchsorted(start, begins)
        n, k = np.diff(at), self.words
        if len(word) >= k:
            gram = word[: len(word) - k + 1].copy()
            for j in range(1, k):
                gram = gram * _P + word[j : len(word) - k + 1 + j]
            gram = _mixed(gram)
        out = []
        for i, m in enumerate(n):
            if m >= k:
                h = np.sort(gram[at[i] : at[i + 1] - k + 1])
                out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
            elif m:
                h = np.array([m], np.uint64)
                for j in range(at[i], at[i + 1]):
                    h = h * _P + word[j : j + 1]
                out.append(_mixed(h ^ _MIX1))
            else:
                out.append(np.empty(0, np.uint64))
        return out

    def registers(self, hashes: np.ndarray) -> np.ndarray:
        """SetSketch registers of a set: floor(1 - log_b x) of the least of its exponential variates, for each register."""
        h = (hashes >> _S32).astype(np.uint32)[:, None]
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(h), len(self.space)):
            part = h[i : i + len(self.space)]
            room = self.space[: len(part)]
            np.multiply(part, self.a, out=room)
            room += self.b
            np.minimum(least, room.min(0), out=least)
        x = -np.log1p(-(least + 0.5) / 2**32) / RATE
        return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint8)


def estimate(equal: np.ndarray, more: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Joint maximum likelihood estimate of the Jaccard similarity of sets of n_u and n_v members.

    equal: registers that agree; more: registers in which u's is larger. The likelihood is the
    SetSketch one, with p(x) = -log_b(1 - x (b - 1) / b), and is largest at one point, found by golden sections.
    """
    equal, more, n_u, n_v = (np.asarray(x, float) for x in (equal, more, n_u, n_v))
    less = registers - equal - more
    u = n_u / (n_u + n_v)
    v = 1 - u
    most = np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-12, 1))

    low, high, g = np.zeros_like(most), most.copy(), 0.6180339887498949
    for _ in range(24):
        a, b = high - g * (high - low), low + g * (high - low)
        left = likelihood(a) > likelihood(b)
        high, low = np.where(left, b, high), np.where(left, low, a)
    return (low + high) / 2


def _norm(text: str | None) -> bytes:
    """A-Z lower-cased, words joined by one space. bytes.lower and bytes.split know ASCII letters and white space only."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def _sets(texts: pa.Array, hasher: Hasher) -> Iterator[tuple[int, int, list[bytes | None], list[np.ndarray]]]:
    """(from, to, keys, shingle hashes) for slices of texts of some bytes; key: a digest of the word sequence, None if it is empty."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    lo = 0
    while lo < len(sizes):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo : lo + _ROWS]) + 0, _WORK)))
        norms = [_norm(t.as_py()) for t in texts.slice(lo, hi - lo)]
        keys = [hashlib.blake2b(x, digest_size=16).digest() if x else None for x in norms]
        yield lo, lo + len(norms), keys, hasher.shingles(norms)
        lo += len(norms)


def signatures(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, n, registers) of every row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(words)
        for batch in batches:
            for lo, hi, keys, sets in _sets(batch.column(1), hasher):
                regs = [hasher.registers(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(regs, pa.binary())], ["doc_id", "key", "n", "registers"])

    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).mapInArrow(giving_back(make), "doc_id long, key binary, n long, registers binary")


def _judged(ties: DataFrame, least: float) -> DataFrame:
    """(a, b, bands, ok) of the ties (a, b, bands, n_a, n_b, r_a, r_b): ok if the estimate is at least `least`."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            r = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (5, 6)]
            n = [np.asarray(batch.column(c)) for c in (3, 4)]
            ok = estimate((r[0] == r[1]).sum(1), (r[0] > r[1]).sum(1), *n, registers=JUDGED) >= least
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ok)], ["a", "b", "bands", "ok"])

    return ties.select("a", "b", "bands", "n_a", "n_b", "r_a", "r_b").mapInArrow(giving_back(judge), "a long, b long, bands long, ok boolean")


def _stars(posts: DataFrame) -> DataFrame:
    """(a, b, band) for each posting (bucket, node, band) but the first of its bucket: a is the bucket's least node.

    The postings are shuffled once and stream by in order of bucket and node, so that a bucket of any size is held nowhere. A bucket
    has at most one row a document, of one band: even if all documents are in it, it is a sixtieth of the postings.
    """

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, least = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, node = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            begins = np.concatenate(([last is None or bucket[0] != last], bucket[1:] != bucket[:-1]))
            at = np.maximum.accumulate(np.where(begins, np.arange(len(bucket)), -1))
            a = np.where(at >= 0, node[at], least if least is not None else node[0])
            last, least = bucket[-1], a[-1]
            mask = pa.array(node != a)
            yield pa.RecordBatch.from_arrays([pa.array(a), batch.column(1), batch.column(2)], ["a", "b", "band"]).filter(mask)

    parts = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = posts.select("bucket", "node", "band").repartition(parts, "bucket").sortWithinPartitions("bucket", "node")
    return dealt.mapInArrow(giving_back(tie), "a long, b long, band int")


def _ties(reps: DataFrame, threshold: int) -> DataFrame:
    """(a, b): ties between rows of reps (node, n, registers). Two that share a band and may be similar are tied, if by way of others."""
    side = lambda end: reps.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.substring("registers", 1, JUDGED).alias(f"r_{end}"))
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("registers"), i * ROWS + 1, F.lit(ROWS))))
    posts, kept = reps.select("node", F.posexplode(bands).alias("band", "bucket")), None
    for _ in range(STARS):
        ties = _stars(posts).groupBy("a", "b").agg(F.expr("bit_or(shiftleft(1L, band))").alias("bands"))
        judged = cut(_judged(cut(ties, "ties").join(side("a"), "a").join(side("b"), "b"), threshold / 100 - LOOSE), "judged")
        found = judged.where("ok").select("a", "b")
        kept = found if kept is None else kept.unionByName(found)
        at = F.explode(F.filter(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.col("bands").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0))
        # Those that a bucket's least member does not hold are a bucket of their own.
        posts = judged.where("NOT ok").select("a", at.alias("band"), F.col("b").alias("node")).withColumn("bucket", F.xxhash64("a", "band"))
    left = posts.join(posts.groupBy("bucket").agg(F.count("*").alias("many")).where("many > 1"), "bucket")
    left = cut(left.select("bucket", "node", F.ceil(F.col("many") / BLOCK).cast("int").alias("chunks")), "cut")
    if not left.take(1):
        return kept
    blocks = _dealt(left.join(reps.select("node", "n", "registers"), "node"))
    return kept.unionByName(_block_links(blocks, threshold, "bucket"))


def _similar(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    place = np.searchsorted(b, a)
    place[place == len(b)] = 0
    both = int((b[place] == a).sum())
    return 100 * both >= threshold * (len(a) + len(b) - both)


def _links_in_block(rep: np.ndarray, side: np.ndarray, group: np.ndarray, n: np.ndarray, regs: np.ndarray, sets: list[np.ndarray] | None, threshold: int, alone: bool) -> list[tuple[int, int]]:
    """Links that join what is similar in a block. alone: members meet each other; else side 0 meets side 1.

    Rows of one group are joined already; what links join is not compared again, so the links are enough for the
    components, no more. 100 * intersection >= threshold * union decides, on whole sets; without sets,
    all that registers do not rule out is linked.
    """
    group, links = np.unique(group, return_inverse=True)[1], []
    regs16 = regs.astype(np.int16)
    for i in range(len(rep)):
        other = group != group[i]
        other &= np.arange(len(rep)) > i if alone else side != side[i]
        if not alone and side[i]:
            continue
        other &= np.minimum(n, n[i]) * 100 >= threshold * np.maximum(n, n[i])
        at = np.flatnonzero(other)
        if not len(at):
            continue
        gap = regs16[at] - regs16[i]
        # A quick bound first, then the likelihood.
        equal = (gap == 0).sum(1)
        some = equal >= (threshold / 100 - 2 * MARGIN) * REGISTERS
        at, gap, equal = at[some], gap[some], equal[some]
        if not len(at):
            continue
        at = at[estimate(equal, (gap < 0).sum(1), np.full(len(at), n[i]), n[at]) >= threshold / 100 - MARGIN]
        for k in at:
            if group[k] == group[i]:
                continue
            if sets is None or _similar(sets[i], sets[k], threshold):
                links.append((int(rep[i]), int(rep[k])))
                group[group == group[k]] = group[i]
    return links


def _block_links(blocks: DataFrame, threshold: int, name: str) -> DataFrame:
    """(a, b): the links of every block (name, i, j); i = j: its members meet each other. A block's rows come together and are held, no more. Without hashes, registers decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def solve(t: pa.Table) -> list[tuple[int, int]]:
            regs = np.frombuffer(b"".join(t["registers"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
            sets = [np.frombuffer(x, np.uint64) for x in t["hashes"].to_pylist()] if "hashes" in t.column_names else None
            return _links_in_block(*(np.asarray(t[c]) for c in ("node", "side", "joined", "n")), regs, sets, threshold, t["i"][0].as_py() == t["j"][0].as_py())

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

        def split(t: pa.Table) -> list[int]:
            keys = [np.asarray(t[c]) for c in (name, "i", "j")]
            return [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist(), t.num_rows]

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, t]) if held is not None else t
            if not held.num_rows:
                continue
            ends = split(held)
            found = [x for a, b in zip(ends[:-2], ends[1:-1], strict=True) for x in solve(held.slice(a, b - a))]
            held = held.slice(ends[-2])
            if found:
                yield out(found)
        if held is not None and held.num_rows and (found := solve(held)):
            yield out(found)

    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.repartition(parts, name, "i", "j").sortWithinPartitions(name, "i", "j", "node")
    return dealt.mapInArrow(giving_back(run), "a long, b long")


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (bucket, node, chunks, n, registers), dealt into pairs (i, j) of their bucket's chunks; each goes to as many pairs as there are chunks."""
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
    return dealt.select("bucket", "i", "j", (F.col("chunk") != F.col("i")).cast("int").alias("side"), "node", F.col("node").alias("joined"), "n", "registers")


def linked(docs: DataFrame, words: int = 2, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, key): one row for each row of docs.

    A document's set has the shingles of so many `words`; with fewer words, the whole sequence is the
    only one. Documents are linked if 100 * intersection >= threshold * union; component_id is the least id
    that links reach. A null, empty or blank text has an empty set and no links. A row without id cannot be
    named in a link: its component_id is null and kept is true. Rows that repeat an id are one document:
    what any of its texts is linked with. An empty table gives no rows; other columns are not read.
    """
    sigs = cut(signatures(docs, words, id_col, text_col), "signatures")
    named = sigs.where("key IS NOT NULL AND doc_id IS NOT NULL")
    # Equal word sequences are one class; its least id stands for it.
    classes = named.groupBy("key").agg(F.min("doc_id").alias("rep"))
    reps = named.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    # An id may stand for several texts; each has a number of its own.
    reps = cut(reps.withColumn("node", F.monotonically_increasing_id()), "representatives")
    clusters = cut(components(_ties(reps, threshold), "clusters"), "clusters")
    few = F.broadcast(clusters) if clusters.count() <= BROADCAST_IDS else clusters
    members = reps.select("node", "rep", "key").join(few.withColumnRenamed("node", "member"), F.col("member") == F.col("node"))
    members = cut(members.select("rep", "key", F.col("component").alias("cluster")), "members")
    repeated = cut(named.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("key").alias("k"), F.max("key").alias("z")).where("rows > 1"), "repeated")
    links = _cluster_links(docs, members, words, threshold, id_col, text_col, bool(repeated.take(1)))

    # Texts of one id are one document too.
    twice = named.join(repeated.where("k <> z").select("doc_id"), "doc_id").join(classes, "key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    reached = components(links.unionByName(twice), "links")

    classes = classes.join(reached, F.col("rep") == F.col("node"), "left").select(F.col("key").alias("k"), F.coalesce("component", "rep").alias("component"))
    out = sigs.join(classes, F.col("key") == F.col("k"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "key")


def _cluster_links(docs: DataFrame, members: DataFrame, words: int, threshold: int, id_col: str, text_col: str, repeats: bool) -> DataFrame:
    """(a, b): links enough to join what is similar in each cluster of members (rep, key, cluster).

    First every member meets its block and the heads of its cluster. Then members outside the largest part of what that joined
    meet all members in blocks: none do if one part is left, as in a family of copies.
    """
    sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"), *[F.min(F.struct(F.xxhash64("rep", F.lit(h)).alias("h"), "rep", "key")).alias(f"h{h}") for h in range(HEADS)])
    sizes = cut(sizes.select(F.col("cluster").alias("c"), "chunks", F.array(*[f"h{h}" for h in range(HEADS)]).alias("heads")), "sizes")
    few = F.broadcast(sizes) if sizes.count() <= BROADCAST_IDS // 10 else sizes
    chunk = F.pmod(F.xxhash64("rep", "key"), F.col("chunks")).cast("int")
    head = F.exists("heads", lambda h: (h["rep"] == F.col("rep")) & (h["key"] == F.col("key")))
    dealt = members.join(few, F.col("cluster") == F.col("c")).select("rep", "key", "cluster", "chunks", chunk.alias("chunk"), head.alias("head"))
    dealt = cut(dealt, "dealt")
    at = F.when(F.col("head"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    own = F.transform(at, lambda x: F.struct(x.alias("i"), x.alias("j"), F.lit(0).alias("side")))
    first = cut(_block_links(_hashed(docs, dealt.select("rep", "key", "cluster", F.col("rep").alias("joined"), own.alias("blocks")), words, id_col, text_col, repeats), threshold, "cluster"), "links")

    large = dealt.where("chunks > 1")
    if not large.take(1):
        return first
    joined = components(first, "parts")
    large = cut(large.join(joined, F.col("rep") == F.col("node"), "left").select("rep", "key", "cluster", "chunks", "chunk", F.coalesce("component", "rep").alias("joined")), "large")
    most = large.groupBy("cluster", "joined").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "joined")).alias("m"), F.sum("n").alias("all"))
    most = cut(most.select(F.col("cluster").alias("c"), F.col("m.joined").alias("largest"), F.ceil((F.col("all") - F.col("m.n")) / BLOCK).cast("int").alias("left")).where("left > 0"), "largest")
    if not most.take(1):
        return first
    rest = large.join(most, F.col("cluster") == F.col("c"))
    block = lambda i, c, side: F.struct(i.alias("i"), (F.col("left") + c).alias("j"), F.lit(side).alias("side"))
    lefts = F.sequence(F.lit(0), F.col("left") - 1)
    all_of = F.transform(lefts, lambda i: block(i, F.col("chunk"), 1))
    own = F.pmod(F.xxhash64("key", "rep"), F.col("left")).cast("int")
    outside = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: block(own, c, 0))
    blocks = F.concat(all_of, F.when(F.col("joined") != F.col("largest"), outside).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>")))
    second = _hashed(docs, cut(rest.select("rep", "key", "cluster", "joined", blocks.alias("blocks")), "rest"), words, id_col, text_col, repeats)
    return first.unionByName(_block_links(second, threshold, "cluster"))


def _hashed(docs: DataFrame, assigned: DataFrame, words: int, id_col: str, text_col: str, repeats: bool) -> DataFrame:
    """(cluster, joined, i, j, side, node, n, registers, hashes): the assigned (rep, key, cluster, joined, blocks) texts' shingles, once for each of their blocks.

    repeats: rows of docs may repeat an id; of equal ones, one is taken.
    """
    assigned = F.broadcast(assigned) if assigned.count() <= BROADCAST_IDS else assigned
    wanted = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).join(assigned, F.col("doc_id") == F.col("rep"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(words)
        for batch in batches:
            for lo, hi, keys, sets in _sets(batch.column(0), hasher):
                here = batch.slice(lo, hi - lo)
                made = [pa.array([len(s) for s in sets], pa.int64()), pa.array([hasher.registers(s).tobytes() if len(s) else None for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                same = pa.array([k == x for k, x in zip(keys, here.column(2).to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([*here.columns[1:], *made], ["rep", "key", "cluster", "joined", "blocks", "n", "registers", "hashes"]).filter(same)

    made = wanted.select("text", "rep", "key", "cluster", "joined", "blocks").mapInArrow(giving_back(make), "rep long, key binary, cluster long, joined long, blocks array<struct<i:int,j:int,side:int>>, n long, registers binary, hashes binary")
    made = made.dropDuplicates(["rep", "key"]) if repeats else made
    return made.select("cluster", "joined", F.explode("blocks").alias("b"), F.col("rep").alias("node"), "n", "registers", "hashes").select("cluster", "joined", "b.*", "node", "n", "registers", "hashes")


def deduplicated(docs: DataFrame, words: int = 2, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stand for their component: the one of least id. Of rows that repeat that id, one stays.

    Rows without id stay; null, empty and blank texts are linked with nothing, so the first row of such an id stays. Columns as in docs,
    whatever their names. An empty table gives no rows.
    """
    found = cut(linked(docs, words, threshold, id_col, text_col).where("doc_id IS NOT NULL").select("doc_id", "kept"), "kept")
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows, own = docs.toDF(*names), names[docs.columns.index(id_col)]
    same = F.col(own).cast("long") == F.col("i")

    def few(ids: DataFrame) -> DataFrame:
        ids = cut(ids.select(F.col("doc_id").alias("i")).distinct(), "ids")
        return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    kept = rows.join(few(found.where("NOT kept")), same, "left_anti")
    again = found.where("kept").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1")
    if again.take(1):
        again = few(again)
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([own]))
    return kept.toDF(*docs.columns)


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(read_table(spark, sf_dir, "documents")).drop("key")


#: DuckDB SQL for op2_near_dup: classes of equal sets, candidates that share one of their rarest shingles (two similar sets can't lack all), whole sets compared.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) ELSE w END AS g FROM d),
cl AS (SELECT g, min(doc_id) AS rep, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
e AS (SELECT rep, n, unnest(g) AS x FROM cl),
f AS (SELECT x, count(*) AS c FROM e GROUP BY x),
r AS (SELECT rep, n, x, row_number() OVER (PARTITION BY rep ORDER BY c, x) AS k FROM e JOIN f USING (x)),
p AS (SELECT rep, n, x FROM r WHERE k <= n - (80 * n + 99) // 100 + 1),
ca AS (SELECT DISTINCT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
l AS (SELECT a, b FROM ca JOIN e ea ON ea.rep = a JOIN e eb ON eb.rep = b AND eb.x = ea.x GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))),
bo AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
re AS (SELECT rep AS node, rep AS root FROM cl UNION SELECT bo.b, re.root FROM re JOIN bo ON bo.a = re.node),
co AS (SELECT node, min(root) AS component FROM re GROUP BY node)
SELECT doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept
FROM s LEFT JOIN cl ON s.g = cl.g LEFT JOIN co ON cl.rep = co.node
"""
