"""Prefix trie, Merkle manifest and packing against plain versions, with nulls, ties, repeated rows, long texts, empty tables and clashing columns."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle, packing, prefix_trie
from tessera.llm.registry import ORACLES, QUERIES

TURNS = "conv_id long, turn long, role string, text string, total int, place int, node string"
TALKS = [
    (1, 0, "user", "hi"), (1, 1, "bot", "hello"), (2, 0, "user", "hi"), (2, 1, "bot", "hello"), (2, 2, "user", "bye"), (3, 0, "user", "hi"), (3, 1, "bot", "hello"), (3, 2, "user", "bye"), (4, 0, "user", "hö"),
    (5, None, None, None), (5, 3, "user", "hi"), (5, 3, "user", "hi"), (6, 2, "", ""), (6, 3, "user", "hi"), (None, 0, "user", "lost"), (7, 0, "user", "x" * 300_000), (8, 0, "u", "ser"), (9, 0, "us", "er"),
]


def plain_trie(talks):
    """talks: conv -> list of (role, text). Rows as prefix_trie.COLUMNS."""
    nodes = collections.defaultdict(list)
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    out = []
    for seq, members in nodes.items():
        below = [s for s in nodes if s[: len(seq)] == seq]
        saved = sum((len(nodes[s]) - 1) * (len(s[-1][1].encode()) if s else 0) for s in below)
        ends = ",".join(str(c) for c in sorted(members) if len(talks[c]) == len(seq))
        kids = sum(len(s) == len(seq) + 1 for s in below)
        leaves = sum(not any(len(t) == len(s) + 1 and t[: len(s)] == s for t in nodes) for s in below)
        out.append((min(members), len(seq), min(nodes[seq[:-1]]) if seq else None, len(members), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found_trie(df):
    return sorted((tuple(r[c] for c in prefix_trie.COLUMNS) for r in df.collect()), key=str)


def talks_of(rows):
    out = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in out.items()}


@pytest.fixture(scope="module")
def talks(spark):
    return spark.createDataFrame([(*r, 1, 2, "n") for r in TALKS], TURNS)


def test_trie(spark, talks):
    assert found_trie(prefix_trie.conversation_trie(talks)) == plain_trie(talks_of(TALKS))
    assert prefix_trie.conversation_trie(talks.limit(0)).count() == 0
    assert found_trie(prefix_trie.conversation_trie(talks.where("conv_id = 4"))) == plain_trie({4: [("user", "hö")]})


def test_rebuilt_trie_with_many_copies(spark):
    rng = np.random.default_rng(6)
    rows = []
    for c in range(60):
        for t in range(int(rng.integers(1, 12))):
            rows.append((c, t, "r", "same" if c % 3 == 0 else f"t{rng.integers(3)}"))
    df = spark.createDataFrame([(*r, 1, 2, "n") for r in rows], TURNS)
    base = talks_of(rows)
    new = {}
    for c, own in base.items():
        h = zlib.crc32(str(c).encode()) % 9
        new[c] = base.get(c - c % 5, [])[:h] + own[h:]
    assert found_trie(prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.ordered_turns(df)))) == plain_trie(new)
    # Turnless conversations and absent bases.
    short = [r for r in rows if r[0] in (1, 2, 3, 4, 8, 13) and r[1] < 2]
    base = talks_of(short)
    new = {c: base.get(c - c % 5, [])[: (h := zlib.crc32(str(c).encode()) % 9)] + own[h:] for c, own in base.items()}
    df = spark.createDataFrame([(*r, 1, 2, "n") for r in short], TURNS)
    assert found_trie(prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.ordered_turns(df)))) == plain_trie(new)


def test_ids_are_hashed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    whole = spark.range(50).select(F.col("id").alias("conv"), F.lit(0).cast("long").alias("rep"), F.lit(1).cast("long").alias("total"), F.lit(50).cast("long").alias("n"))
    assert prefix_trie.id_digests(whole).first()["ends_sha256"] == hashlib.sha256(",".join(map(str, range(50))).encode()).hexdigest()


DOCS = "doc_id long, source string, lang string, n_chars long, text string, key string, idx int, hash string"


def plain_merkle(rows, fanout=16):
    put = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def tree(hashes):
        proofs, groups = [""] * len(hashes), [[i] for i in range(len(hashes))]
        while len(hashes) > 1:
            up, together = [], []
            for lo in range(0, len(hashes), fanout):
                run = hashes[lo : lo + fanout]
                for k, g in enumerate(groups[lo : lo + fanout]):
                    for i in g:
                        proofs[i] += "".join(run[:k] + run[k + 1 :])
                up.append(sha("".join(run)))
                together.append([i for g in groups[lo : lo + fanout] for i in g])
            hashes, groups = up, together
        return hashes[0], proofs

    by = collections.defaultdict(list)
    for doc, source, lang, n, text in rows:
        by[source].append(((doc is not None, doc or 0), sha("".join(map(put, (doc, source, lang, n, text)))), doc))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: tree([h for _, h, _ in sorted(by[s], key=lambda x: x[:2])]) for s in names}
    root, above = tree([subs[s][0] for s in names])
    out = []
    for s, proof in zip(names, above, strict=True):
        for (_, h, doc), p in zip(sorted(by[s], key=lambda x: x[:2]), subs[s][1], strict=True):
            out.append((doc, h, subs[s][0], root, sha(p + proof)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("sizes", "fanout"), [((1,), 16), ((2, 1), 16), ((16, 17, 1, 257), 16), ((9, 28, 3), 3)])
def test_merkle(spark, sizes, fanout):
    names = [None, "b", "ä", "a"]
    rows = [(i * 4 + k if i else None, names[k], None if i % 3 else "en", i if i % 2 else None, None if i % 5 == 4 else f"Tëxt {i}") for k, n in enumerate(sizes) for i in range(n)]
    rows += [rows[-1]] * 2
    df = spark.createDataFrame([(*r, "k", 1, "h") for r in rows], DOCS).repartition(7)
    got = merkle.manifest(df, fanout=fanout).withColumn("proof_sha256", merkle.proof_hash(F.col("proof"))).withColumn("back", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in got), key=str) == plain_merkle(rows, fanout)
    assert all(r["back"] == r["root"] for r in got)


def test_merkle_edges(spark):
    none = spark.createDataFrame([], DOCS)
    assert merkle.manifest(none).count() == 0
    docs = spark.createDataFrame([(i, "s", "en", 1, "ABC" if i % 2 else "abc", "k", 1, "h") for i in range(40)], DOCS)
    rows = merkle.manifest(docs, changed=F.lower("text")).withColumn("back", merkle.folded(F.col("changed_leaf"), F.col("proof"))).collect()
    assert {r["doc_id"] for r in rows if r["back"] != r["root"]} == {i for i in range(40) if i % 2}
    with pytest.raises(ValueError):
        merkle.forest(none.select("key", "idx", "n_chars", "hash"), 1)


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_best_fit_over_counts():
    rng = np.random.default_rng(2)
    for _ in range(150):
        capacity = int(rng.choice([1, 7, 16, 100]))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(0, 200))).tolist()
        counts = collections.Counter(lengths)
        steps, n = packing.best_fit(dict(counts), capacity)
        assert n == plain_best_fit(lengths, capacity)
        held, ranks = collections.defaultdict(list), collections.Counter()
        by = collections.defaultdict(list)
        for length, first, per, sequence, offset in steps:
            by[length].append((first, per, sequence, offset))
        for length in lengths:
            first, per, sequence, offset = max(x for x in by[length] if x[0] <= ranks[length])
            nth = ranks[length] - first
            held[sequence + nth // per].append((offset + nth % per * length, length))
            ranks[length] += 1
        for places in held.values():
            places.sort()
            assert [p for p, _ in places] == [0, *np.cumsum([x for _, x in places])[:-1]] and sum(x for _, x in places) <= capacity
        assert len(held) == n
    with pytest.raises(ValueError):
        packing.best_fit({9: 1}, 8)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary_path())


def test_word_encoder_equals_the_tokenizer(tokenizer, sf, spark):
    encoder = packing.WordEndEncoder(packing.vocabulary_path())
    rng = np.random.default_rng(8)
    letters = list("abcABCéÉİıßΣςñ\u0301'’`.,;:!?$&*%#()<>|0123456789½Ⅷ \n\t\x0b\x1c\x85\xa0\u2003\u0958\ufeff日本ㄱ각🙂")
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 60)))) for _ in range(3000)]
    texts += ["<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "don't I'LL 's x's. İ: İ.", "", " ", "a" * 3000 + " b" * 200_000, *[r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r["text"]]]
    assert encoder.wordwise
    for text, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(encoder.encode(text), encoder.type).tolist() == e.ids


def test_packing(spark, tokenizer):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "word " * 9000), (5, "one two"), (5, "one two"), (None, "no id"), *[(i, "ab " * (i % 37)) for i in range(10, 200)]]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, sequence_id string, length int, part int")
    for capacity in (4096, 50, 1):
        got = packing.packed_documents(docs.repartition(3), capacity, ids=True)
        found = got.collect()
        want = collections.Counter()
        for i, t in rows:
            ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
            for k, lo in enumerate(range(0, len(ids), capacity)):
                part = np.array(ids[lo : lo + capacity], "<u4")
                want[(i, k, lo, len(part), zlib.crc32(part.tobytes()))] += 1
        assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
        assert len({r["sequence_id"] for r in found}) == plain_best_fit([r["length"] for r in found], capacity)
        by = collections.defaultdict(list)
        for r in found:
            by[r["sequence_id"]].append((r["offset"], bytes(r["ids"])))
        for s in packing.sequences(got).collect():
            assert bytes(s["ids"]) == b"".join(x for _, x in sorted(by[s["sequence_id"]])) and s["n_tokens"] * 4 == len(s["ids"]) <= capacity * 4
            assert list(s["offsets"]) == [0, *np.cumsum([len(x) // 4 for _, x in sorted(by[s["sequence_id"]])])[:-1]]
    assert packing.packed_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_merkle_manifest"])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, found = QUERIES[name](spark, sf), con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, found.fetchall()))
