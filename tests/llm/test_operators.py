"""The ten operators on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import collections
import hashlib
import re
import sys
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, decontaminate, html_text, language, mixing, near_dup, neighbours, pii, quality, sharding, tokens
from tessera.llm.decontaminate import contaminations, decontaminated
from tessera.llm.registry import ORACLES, QUERIES

BASE = " ".join(f"w{i}" for i in range(120))
NEAR = BASE.replace("w60", "x60")
ROWS = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n", None, None, 0), (4, BASE, "en", "a", 1), (5, BASE.upper(), "en", "b", 1), (6, NEAR, "en", None, 1),
    (7, "single", "de", "c", 1), (8, "single", "de", "c", 1), (8, "single", "de", "c", 1), (None, "no id here", "fr", "a", 1), (9, "x " * 30_000 + "end", "es", "b", 1), (10, "12 34 !?", "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, size int"  # size clashes with a computed name


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(spark, docs, none):
    got = sharding.assign_shards(docs, 3, 64).collect()
    assert len(got) == len(ROWS) and sharding.assign_shards(none).count() == 0
    for shard in range(3):
        here = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert here == list(range(len(here)))
    by = {r["doc_id"]: r for r in got}
    assert (by[1]["size"], by[1]["text_crc32"]) == (8, 0) and by[4]["text_crc32"] == zlib.crc32(BASE.encode()) and {r["law"] for r in got} == {"bytes"}
    totals = [(int(x), 1) for x in np.random.default_rng(0).integers(1, 99, 4000)]
    first = sharding.first_map(totals, 24)
    assert max(first.loads()) - min(first.loads()) < 100
    grown = sharding.rebalanced(first, 25)
    moved = [(a, b) for a, b in zip(first.shard_of, grown.shard_of, strict=True) if a != b]
    assert moved and all(b == 24 for _, b in moved) and grown.version == 2 and max(grown.loads()) - min(grown.loads()) < 200


def test_sharding_against_a_plain_version(spark, sf):
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op1_sharding"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(rows)
    loads, places, slots, held = collections.Counter(), collections.defaultdict(list), collections.Counter(), {}
    for r in got:
        b = rows[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(b) + 8, zlib.crc32(b), "bytes", None)
        loads[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
        slots[r["virtual_slot"]] += r["size"]
        assert held.setdefault(r["virtual_slot"], r["shard"]) == r["shard"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(places) <= set(range(24))
    # Slots, largest first, each to the shard that holds least.
    plain = [0] * 24
    for n in sorted(slots.values(), reverse=True):
        plain[plain.index(min(plain))] += n
    assert sorted(loads.values()) == sorted(x for x in plain if x)


def test_sharding_spreads_equal_texts_and_rows(spark, tmp_path):
    same = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("one text").alias("text"))
    assert same.count() == 400 and len({r["shard"] for r in sharding.assign_shards(same, 4, 64).collect()}) == 4


def test_sharding_rules_agree_and_growth_moves_nothing(spark, tmp_path):
    rows = lambda n: spark.range(n + 500).select(F.when(F.col("id") < n, 7).otherwise(F.col("id")).cast("long").alias("doc_id"), F.when(F.col("id") < n, F.lit("one row")).otherwise(F.col("id").cast("string")).alias("text"))
    held = {}
    for n in (3000, 3001):
        narrow = sharding.slotted(rows(n), 64)
        got = {(r["doc_id"], r["virtual_slot"]) for r in narrow.select("doc_id", "virtual_slot").distinct().collect()}
        assert len(got) == 501 + (3500 - 3001 - 499)
        held[n] = dict(got)
    assert all(held[3001][k] == v for k, v in held[3000].items() if k in held[3001])
    shards = sharding.assign_shards(rows(3000), 4, 64, map_path=str(tmp_path / "map")).collect()
    for shard in range(4):
        assert sorted(r["slot"] for r in shards if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in shards)))
    sharding.write_shards(rows(3000), spark.read.parquet(str(tmp_path / "map/version=1")), str(tmp_path / "out"), 64)
    written = collections.Counter((r["doc_id"], r["shard"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert written == collections.Counter((r["doc_id"], r["shard"]) for r in shards)


def test_stored_maps_and_written_shards(spark, docs, tmp_path):
    path = str(tmp_path)
    totals = sharding.slot_totals(sharding.slotted(docs, 16), 16)
    first = sharding.first_map(totals, 2)
    kept = sharding.save_map(spark, first, f"{path}/map")
    assert sharding.load_map(spark, f"{path}/map", 1, 2) == first
    second = sharding.rebalanced(first, 3)
    sharding.save_map(spark, second, f"{path}/map")
    assert sharding.load_map(spark, f"{path}/map", 2, 3) == second and kept.count() == 16
    sharding.write_shards(docs, kept, f"{path}/shards", 16)
    back = spark.read.parquet(f"{path}/shards")
    assert back.count() == len(ROWS) and set(back.columns) == {*docs.columns, "shard"}
    want = {(r["doc_id"], r["text_crc32"]): first.shard_of[r["virtual_slot"]] for r in sharding.slotted(docs, 16).collect()}
    assert all(want[r["doc_id"], zlib.crc32((r["text"] or "").encode())] == r["shard"] for r in back.collect())


def words(t):
    return (t or "").encode().lower().split()


def brute_components(rows, k, threshold=80):
    sets = collections.defaultdict(list)
    for d, t in rows:
        w = words(t)
        sets[d].append(set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set())
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(100 * len(x & y) >= threshold * len(x | y) for x in sets[a] for y in sets[b] if x and y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {d: find(d) for d in ids}


def test_near_dup(spark, docs, none, sf):
    got = near_dup.linked(docs).collect()
    assert len(got) == len(ROWS) and near_dup.linked(none).count() == 0
    expected = brute_components([(r[0], r[1]) for r in ROWS if r[0] is not None], 2)
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None} == set(expected.items())
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]
    kept = near_dup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == sorted([*{v for v in expected.values()}, 0])
    real = spark.read.parquet(f"{sf}/documents.parquet")
    whole = brute_components([(r["doc_id"], r["text"]) for r in real.select("doc_id", "text").collect()], 2)
    assert {r["doc_id"]: r["component_id"] for r in QUERIES["op2_near_dup"](spark, sf).collect()} == whole


def test_near_dup_in_blocks(spark, monkeypatch):
    """Families larger than a block, and clusters that fall into parts."""
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    monkeypatch.setattr(near_dup, "HEADS", 2)
    rng = np.random.default_rng(8)
    word = lambda: f"w{rng.integers(1 << 40):x}"
    rows = []
    for family in range(4):
        base = [word() for _ in range(120)]
        for i in range(20):
            text = list(base)
            for k in range(int(rng.integers(0, 30))):
                text[(7 * k + i) % 120] = word()
            rows.append((len(rows), " ".join(text)))
    rows.append((1000, " ".join([*base[:60], *(word() for _ in range(60))])))
    got = {r["doc_id"]: r["component_id"] for r in near_dup.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows, 2)


def test_near_dup_hubs_stream(spark):
    posts = spark.createDataFrame([(b, n, b % 60) for b in range(5) for n in range(b, 4000, b + 1)], "bucket long, node long, band int")
    want = {(b, n) for b in range(5) for n in range(b, 4000, b + 1) if n != b}
    assert {(r["a"], r["b"]) for r in near_dup._stars(posts).collect() if r["a"] == r["band"]} == want
    assert near_dup._stars(posts.limit(0)).count() == 0


def test_joint_estimate():
    rng = np.random.default_rng(3)
    h = near_dup.Hasher()
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    for shared in (200, 800, 960):
        a, b = pool[:1000], np.concatenate([pool[:shared], pool[1000 : 2000 - shared]])
        u, v = h.registers(a), h.registers(b)
        e = near_dup.estimate([(u == v).sum()], [(u > v).sum()], [1000], [1000])[0]
        assert abs(e - shared / (2000 - shared)) < 0.08
    assert np.array_equal(h.registers(pool[:500]), np.maximum(h.registers(pool[:200]), h.registers(pool[200:500])))  # mergeable


def test_tokens(spark, docs, none):
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path()
    plain, fast = Tokenizer.from_file(path), tokens.WordwiseEncoder(path)
    odd = ["", " ", "  ", " a", "a ", "a  b", "x\n y", "x \n\n  y z", "don't  it's <|endoftext|> ok", "é  b  c", "a\tb c", "12 345 6.7,8", "\n", "a b\n", "e.f, g.\nH i.", "日本 語。 x", "\x1c a", "\nx a\nb", "a.\nb,\nc a\n\nb c.\n"]
    odd += ["".join(np.random.default_rng(i).choice(["a", "don't", "x.", "\n", " ", " ", "\t", "1", "é", "$$", "'s", "<|endoftext|>"], 9)) for i in range(2000)]
    for text, packed in zip(odd, fast.encode(odd), strict=True):
        assert np.frombuffer(packed, fast.type).tolist() == plain.encode(text, add_special_tokens=False).ids, text
    kept = tokens.WordwiseEncoder(path)
    kept.encode(["short " + "x" * 500, "y" * 100])
    assert max(len(w) for w in kept.known if w) <= tokens.LONG and kept.held > 0
    import public_tokenizers

    other = public_tokenizers.path("word_bpe_49k.json")
    whole, foreign = Tokenizer.from_file(other), tokens.WordwiseEncoder(other)
    assert not foreign.wordwise and [np.frombuffer(x, foreign.type).tolist() for x in foreign.encode(["Ab  c. d", ""])] == [whole.encode(t, add_special_tokens=False).ids for t in ("Ab  c. d", "")]
    for job, known in (("first", False), ("first", True), ("second", False)):
        held = tokens.worker_encoder(path, job)
        assert bool(held.known) == known
        assert np.frombuffer(held.encode(["one, two."])[0], held.type).tolist() == plain.encode("one, two.", add_special_tokens=False).ids
    got = tokens.tokenized(docs, parts=3).collect()
    start = 0
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert len(got) == len(order) and tokens.tokenized(none).count() == 0
    for r, (d, t, *_) in zip(sorted(got, key=lambda r: r["start"]), order, strict=True):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_tokens_cost_a_word_once():
    """A word with marks after it, after a line end or first in a text is no new word, and words of letters or marks never go to the library one by one."""
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path()
    plain, fast, alone = Tokenizer.from_file(path), tokens.WordwiseEncoder(path), []
    each = fast._each
    fast._each = lambda pieces: alone.extend(pieces) or each(pieces)
    words = [f"{a}{b}{c}" for a in ("th", "Üb", "été", "жиз") for b in ("rown", "ñaqu", "tion", "ß", "ou") for c in ("ing", "er", "é", "нь", "x")]
    texts = [f"{w} {w}{m} {w},{m}\n{w}{m}\n{v} {m} {w}" for w, v in zip(words, reversed(words), strict=True) for m in tokens.MARKS]
    for texts in (texts, ["x1 " + texts[0]]):
        for text, packed in zip(texts, fast.encode(texts), strict=True):
            assert np.frombuffer(packed, fast.type).tolist() == plain.encode(text, add_special_tokens=False).ids, text
    assert len(fast.known) <= 2 * len(words) + 3 * len(tokens.MARKS) + 2, len(fast.known)
    assert all(any(c.isdigit() for c in w) for w in alone), alone


def test_tokens_at_every_kind_of_character():
    """Every character that may be white space, a letter or neither beside the places where words are cut, and texts that begin or end there."""
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path()
    plain, fast = Tokenizer.from_file(path), tokens.WordwiseEncoder(path)
    chars = [chr(c) for c in (*range(1, 0x500), *range(0x1670, 0x1690), *range(0x1800, 0x1820), *range(0x2000, 0x2070), *range(0x2FF0, 0x3010), 0xFEFF, 0x1F600)]
    forms = ["ab {} cd", "ab{}. cd", "ab\n{}x", "ab {}", "{}\nab,{}", "a{} b", ".{},b", "{}", "<|endoftext|>{} <|endoftext|>"]
    texts = [f.replace("{}", c) for f in forms for c in chars]
    for some in (texts, [""], ["", ""], ["", "a", ""], []):
        arrow = pa.array([None, *some, "z"], pa.string()).slice(1, len(some))
        for text, packed, again in zip(some, fast.encode(some), fast.encode(arrow), strict=True):
            assert np.frombuffer(packed, fast.type).tolist() == plain.encode(text, add_special_tokens=False).ids and packed == again, repr(text)
    whole = pa.array(["a b", None, "x" * 50, "", "c"] * 9, pa.string())
    assert [w for g in tokens._groups(whole.slice(2, 40)) for w in g.to_pylist()] == whole.to_pylist()[2:42]


def test_idle_workers_keep_no_words(spark, docs, monkeypatch):
    """Python workers outlive a query: what they remember for it goes, and what they read next is the same."""
    monkeypatch.setattr(tokens, "KEPT_S", 0.2, raising=False)

    def look(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"kept": pa.array([len(vars(sys.modules["_token_encoders"])) if "_token_encoders" in sys.modules else 0] * b.num_rows, pa.int64())})

    first = sorted(map(str, tokens.tokenized(docs, parts=3).collect()))
    for _ in range(20):
        time.sleep(0.5)
        kept = [r["kept"] for r in spark.range(32, numPartitions=16).mapInArrow(look, "kept long").collect()]
        if not any(kept):
            break
    assert len(kept) == 32 and not any(kept)
    assert sorted(map(str, tokens.tokenized(docs, parts=3).collect())) == first


def test_tasks_give_back_at_their_end(monkeypatch):
    told = []
    monkeypatch.setattr(common, "give_back", lambda: told.append("given"))
    assert list(common.giving_back(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3] and told == ["given"]


def test_mixing(spark, docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and mixing.mix(none).count() == 0
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)


def test_mixed_rows_are_those_of_the_mix(spark, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(real).collect() if r["copies"]}
    assert want == {r["doc_id"]: r["count"] for r in mixing.mixed_documents(real).groupBy("doc_id").count().collect()}


def test_mixing_hits_targets(spark, sf):
    by = collections.defaultdict(lambda: [0.0, 0, 0])
    for r in QUERIES["op10_mixing"](spark, sf).collect():
        s = by[r["source"]]
        s[0], s[1], s[2] = r["target"], s[1] + r["taken"], max(s[2], r["size"])
    assert all(abs(t - taken) <= most for t, taken, most in by.values())


def test_near_dup_behind_other_members_of_a_bucket(spark):
    rng, hasher = np.random.default_rng(5), near_dup.Hasher()
    words = [f"w{rng.integers(1 << 40):x}" for _ in range(400)]
    pair = [" ".join(words), " ".join([*words[:365], *(f"x{i}" for i in range(35))])]
    b, c = (hasher.registers(h).reshape(near_dup.BANDS, -1) for h in hasher.shingles([x.encode() for x in pair]))
    grams = [f"{u} {v}" for u, v in zip(words[:365], words[1:365], strict=False)]
    each = np.array([hasher.registers(h) for h in hasher.shingles([g.encode() for g in grams])]).reshape(len(grams), near_dup.BANDS, -1)
    rows = []
    # In each band that the pair shares, four texts of lower id, of a few of its shingles, have the same registers.
    for band in np.flatnonzero((b == c).all(1)):
        need = [grams[int(np.argmax(each[:, band, r] == b[band, r]))] for r in range(near_dup.ROWS)]
        end = len(rows) + 4
        while len(rows) < end:
            text = " ".join(rng.permutation([*need, *(f"y{rng.integers(1 << 40):x}" for _ in range(2))]))
            if (hasher.registers(hasher.shingles([text.encode()])[0]).reshape(near_dup.BANDS, -1)[band] == b[band]).all():
                rows.append((len(rows), text))
    assert len(rows) >= 8
    df = spark.createDataFrame([*rows, (9000, pair[0]), (9001, pair[1])], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dup.linked(df).collect()}
    assert got[9001] == got[9000] == 9000
    ties = near_dup._ties(near_dup.signatures(df, 2, "doc_id", "text").withColumnRenamed("doc_id", "node"), 80)
    assert {tuple(sorted(r)) for r in ties.where("b >= 9000").collect()} == {(9000, 9001)}


def test_near_dup_each_text_of_an_id(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{rng.integers(1 << 40):x}" for _ in range(200)) for _ in range(3)]
    rows = [(1, x) for x in texts] + [(2 + i, f"{x} more") for i, x in enumerate(texts)]
    got = near_dup.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {1}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    cols = [d[0] for d in found.description]
    key = lambda rows: sorted(repr([float(f"{v:.9g}") if isinstance(v, float) else v for v in r]) for r in rows)
    assert key(QUERIES[name](spark, sf).select(*cols).collect()) == key(found.fetchall())


def test_language(spark, docs, none, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.learn_languages(real)
    truth = {r["doc_id"]: r["lang"] for r in real.collect()}
    got = [r for r in language.identify(real, model).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got]) > 0.95
    small = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert all(small[d]["lang_pred"] == "und" and small[d]["score"] == 0 for d in (1, 2, 3, 10)) and language.identify(none, model).count() == 0
    assert language.identify(none, language.learn_languages(none)).count() == 0
    unknown = language.learn_languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in language.identify(docs, unknown).collect()} == {("und", 0.0, True)}


def test_language_against_plain_sums(spark, sf):
    """A text's scores are the softmax of the mean of its n-grams' rows, n-gram by n-gram."""
    rng = np.random.default_rng(0)
    model = language.LanguageModel(["x", "y", "z"], rng.standard_normal((1 << language.BUCKET_BITS, 3)).astype(np.float32), rng.standard_normal(3), 0.7, 0.0)
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(20).collect() if r["text"]] + ["ab", "é"]
    got = model.scores([language._bytes(t) for t in texts])
    for t, p in zip(texts, got, strict=True):
        data = language._PLAIN[np.frombuffer(language._bytes(t), np.uint8)]
        rows = [model.table[language._grams(data[i : i + n], n)[0]] for n in language.ORDERS for i in range(len(data) - n + 1)]
        z = (np.sum(rows, axis=0, dtype=float) / len(rows) + model.bias) / 0.7
        assert np.allclose(p, np.exp(z - z.max()) / np.exp(z - z.max()).sum(), atol=1e-5)


def test_quality(spark, docs, none, sf):
    real, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.learn_quality(real, labels)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = [r for r in quality.score_quality(real, model).collect() if r["doc_id"] in truth and r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in got]) > 0.85
    assert all((a["score"] - b["score"]) * (a["saving"] - b["saving"]) >= 0 for a in got for b in got)  # the score is a function of the difference
    assert quality.score_quality(docs, model).count() == len(ROWS) and quality.score_quality(none, model).count() == 0
    assert quality.good_documents(docs, labels).columns == docs.columns
    one = quality.fit_quality(["some text"] * 9, [1] * 9)
    assert one.probabilities([0.0])[0] > 0.9 and quality.score_quality(docs, quality.fit_quality([], [])).select("score").distinct().collect()[0][0] == 0.5
    assert quality.learn_quality(none, labels).weight == 0


def test_quality_against_plain_sizes(spark, sf):
    import zstandard

    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    model = quality.fit_quality(texts, [i % 2 for i in range(len(texts))])
    measure = quality.Measure(model.good, model.bad)
    for t in ["", "é" * 3000, *texts[:30]]:
        b, total = t.encode(), 0
        for i in range(0, len(b), quality.PIECE):
            sizes = [len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(b[i : i + quality.PIECE])) for d in (model.bad, model.good)]
            total += sizes[0] - sizes[1]
        assert measure.difference(t) == total / max(1, len(b))


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    x[50:90] = x[0]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (None, [1.0] * 16), (1060, [1.0, None] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in neighbours.search(df, df.where("vec_id % 20 = 0")).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 600, 20))
    hits = 0
    y = x.astype(float)
    for q, found in got.items():
        s = (y * y[q]).sum(1)
        best = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:20]
        hits += len(set(best) & {v for _, v, _ in found})
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21))
    assert hits / (20 * len(got)) >= 0.9
    assert [v for _, v, _ in sorted(got[0])] == list(range(50, 70))
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0


def recall(df, n):
    got = collections.defaultdict(set)
    for r in neighbours.search(df, df.where("vec_id % 20 = 0")).collect():
        got[r["query_id"]].add(r["vec_id"])
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    right = []
    for q, found in got.items():
        others = [(-float((x * rows[q]).sum()), i) for i, x in rows.items() if i != q and len(x) == len(rows[q])]
        best = {i for _, i in sorted(others)[:20]}
        right.append(len(best & found) / len(best))
    assert len(got) == n
    return np.mean(right)


@pytest.mark.parametrize("norms", ["unit", "uniform", "lognormal"])
def test_neighbours_recall(spark, norms):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x *= {"unit": np.ones(4000), "uniform": rng.uniform(0.2, 1, 4000), "lognormal": rng.lognormal(0, 0.8, 4000)}[norms][:, None]
    assert recall(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), 200) >= 0.9


def test_neighbours_of_several_lengths(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SIZES", 1)
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8 if i % 3 else 12).tolist()) for i in range(900)]
    assert recall(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 45) >= 0.9
    lone = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in neighbours.search(lone, lone).orderBy("query_id").collect()] == [(0, 1, 1, 5.0), (1, 1, 0, 5.0)]


def test_html(spark):
    page = '<html><head><title>t</title><script>x="<p>no</p>"</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav><div class="ad">Buy now!</div><article><h1>A  title &amp; more</h1><p>First\n paragraph, of some length.<p><b>Second one, unclosed and long enough.</article><div class="comments"><p>nice post</p></div><footer>&copy; me</footer>'
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (None, "v", ""), (1, "u", page)], "page_id long, url string, html string")
    got = html_text.extract(df).collect()
    text = "A title & more\nFirst paragraph, of some length.\nSecond one, unclosed and long enough."
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "", 0), (1, text, len(text)), (1, text, len(text)), (2, "", 0)]
    assert html_text.extract(df.limit(0)).count() == 0
    rng, right = np.random.default_rng(5), []
    for _ in range(60):
        p = html_text.made_page(rng)
        gold = [t.replace("\x01", "") for _, t in html_text.parse(p)[1] if "\x01" in t]
        right.append(html_text.main_text(p.replace("\x01", "")) == "\n".join(gold))
    assert np.mean(right) > 0.9


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ('<p>a</p><svg class="i"/><p>b</p><p>c</p><svg><text>L</text></svg><p>d</p>', ["a", "b", "c", "d"]),
        ("<p>a</p><object data=x><p>b</p><p>c</p>", ["a", "b", "c"]),
        ("<div><object>w</object></div><p>c</p><video><p>none</p></video><p>d", ["c", "d"]),
        ("<p>a</p><!--><p>b</p><!---><p>c</p><!-- x --!><p>d</p><!-- never ends <p>e</p>", ["a", "b", "c", "d"]),
        ('<p>a <a href="x>link</a> b</p><p>c</p>', ["a link b", "c"]),
        ('<p>a <a href="x>link</a> <a href="y">b</a></p><p title="u>v">c</p>', ["a link b", "c"]),
        ("<svg><svg><text>in</text></svg><text>label</text></svg><p>x</p>", ["x"]),
        ('<svg><path d="a"/><p>out</p>', ["out"]),
        ("<title>t</title><textarea>open <p>x</p>", ["open", "x"]),
        ('<p>x</p><script>var a="<p>";</script><p>y<style>p{}', ["x", "y"]),
        ("a < b and 3<4 <? y ?> z", ["a < b and 3<4 z"]),
    ],
)
def test_html_loses_no_text(page, blocks):
    assert [t for _, t in html_text.parse(page)[1]] == blocks


def test_html_in_linear_time():
    import time

    for piece in ('<a href="x>y</a>\'<b c=\'>', "<a ", '<a "', "<p \"> ' ", "<object>", "<svg>", "<title>", "<!--", '<a href="x>'):
        began = time.perf_counter()
        html_text.parse(piece * 40_000)
        assert time.perf_counter() - began < 5


def test_html_choice_against_all_choices():
    """The kept nodes have the largest total log-odds of all choices in which no kept node has a dropped ancestor."""
    import itertools

    rng = np.random.default_rng(2)
    page = "<body><div>a<section>b<p>c</p></section><ul><li>d<li>e</ul></div><aside>f<p>g</p></aside></body>"

    class Odds:
        def log_odds(self, x):
            return self.values[: len(x)]

    for _ in range(60):
        odds = Odds()
        odds.values = rng.standard_normal(20)
        root, blocks = html_text.parse(page)
        nodes, parent, _ = html_text.features(root)
        free = [i for i, n in enumerate(nodes) if n.tag not in ("html", "body")]
        best = max(
            (c for k in range(len(free) + 1) for c in itertools.combinations(free, k) if all(parent[i] in c or nodes[parent[i]].tag in ("html", "body") for i in c)),
            key=lambda c: sum(odds.values[list(c)]) if c else 0.0,
        )
        want = "\n".join(t for n, t in blocks if nodes.index(n) in best)
        assert html_text.main_texts([page], odds) == [want]


def test_html_wide_articles():
    trees = html_text.trained()
    body = "".join(f"<p>Sentence number {i}, which is here, has a few words and an end.</p>" for i in range(300))
    page = f'<html><body><nav><ul>{"<li><a href=x>Home</a></li>" * 80}</ul></nav><article><h1>Title of it</h1>{body}</article><footer>end</footer></body></html>'
    assert html_text.main_text(page, trees).count("\n") == 300


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20, 60))), (2, None), (3, ""), (4, "zz yy")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in contaminations(docs, bench).collect()}
    assert set(got) == {(4, 1), (5, 1), (6, 1)} and got[4, 1]["similarity"] == 1 and got[4, 1]["start"] == 20
    assert contaminations(none, bench).count() == 0 and contaminations(docs, bench.limit(0)).count() == 0
    assert decontaminated(docs, bench).columns == docs.columns and decontaminated(docs, bench).count() == len(ROWS) - 3
    short = spark.createDataFrame([(1, "see Zz, yy!"), (2, "zz and yy")], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in contaminations(short, bench).collect()] == [(1, 4)]


def test_decontamination_at_the_threshold(spark):
    rng = np.random.default_rng(7)
    items = [[f"w{rng.integers(1 << 40):x}" for _ in range(40)] for _ in range(600)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join([*w[:36], *(f"x{i}y{j}" for j in range(4))])) for i, w in enumerate(items)], "doc_id long, text string")
    got = contaminations(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["similarity"]) for r in got} == {(i, i, 0.8) for i in range(600)}


def test_all_fingerprints_within_the_radius(spark):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 63, 30)
    flip = lambda x, n: int(x) ^ sum(1 << int(b) for b in rng.choice(63, n, replace=False))
    windows = [(i * 100 + n, 9, flip(x, n)) for i, x in enumerate(base) for n in range(25)]
    w, items = spark.createDataFrame(windows, "w long, length int, f long"), spark.createDataFrame([(i, 9, int(x)) for i, x in enumerate(base)], "item_id long, length int, fingerprint long")
    got = {(r["w"], r["item_id"]) for r in decontaminate.within_radius(w, items).collect()}
    assert got == {(a, i) for a, _, f in windows for i, x in enumerate(base) if (f ^ int(x)).bit_count() <= decontaminate.RADIUS}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def strict(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0
    return 8 <= len(d) <= 15 if kind == "phone" else True


def test_personal_data(spark, sf):
    odd = [None, "", "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 300.1.1.1 0000255.1.1.1", "+1 (017) 555-7713 +12 34", "4111 1111 1111 1111 and 4111-1111-1111-1112", "é ñ@x.com 日本 me@a-b.co.uk.", "9" * 20000, "a@" + "b." * 9000 + "c"]
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    df = real.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    for r in pii.personal_data(df).collect():
        found = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, texts[r["doc_id"]]) if strict(k, m[0])]
        written = [f"{k}:{a}:{b}" for k, a, b in found]
        assert r["base_sha256"] == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(x[0] == k for x in found) for k in pii.BASE_KINDS]
        spans = r["spans"].split(",") if r["spans"] else []
        assert (r["n_spans"], r["n_added"]) == (len(spans), len(spans) - len(written))
        assert set(written) <= set(r["spans"].split(",")) | {""}
    assert pii.personal_data(df.limit(0)).count() == 0


def test_personal_data_added_spans(spark):
    rng = np.random.default_rng(12)
    key = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    luhn = lambda s: s + next(str(d) for d in range(10) if strict("card", s + str(d)))
    rows, secrets = [], {}
    for i in range(60):
        value = f"AKIA{''.join(rng.choice(list('ABCDEFGHJKMNPQRSTVWXYZ23456789'), 16))}" if i % 3 == 0 else key(40)
        lead = ["access_key ", 'token = "', "password="][i % 3]
        rows.append((i, f"some words {lead}{value}\" and more words"))
        secrets[i] = f"secret:{rows[-1][1].index(value)}:{rows[-1][1].index(value) + len(value)}"
        rows.append((100 + i, f"Internationalisierungsmassnahme number {rng.integers(1000)} path/to_some/file-name-of-2024-x end " + ("order 1234567890123456 " if i % 2 else "")))
        rows.append((200 + i, f"pay with card {luhn('4' + ''.join(map(str, rng.integers(0, 10, 14))))} now"))
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]["spans"] == s and got[i]["n_added"] == 1 for i, s in secrets.items())
    assert all(got[100 + i]["n_spans"] == 0 and got[200 + i]["n_card"] == got[200 + i]["n_spans"] == 1 for i in range(60))


def test_places_of_very_many_finds(spark):
    text = " ".join(f"u{i}@x.org" for i in range(1000))
    r = pii.personal_data(spark.createDataFrame([(1, text), (2, "é" + text)], "doc_id long, text string")).orderBy("doc_id").collect()
    for shift, row in enumerate(r):
        assert row["spans"] == ",".join(f"email:{m.start() + shift}:{m.end() + shift}" for m in re.finditer(PATTERNS["email"], text))


def test_votes():
    counts = [(3, (1, 1, 1, 1, 1), 8, 50), (3, (1, 1, 1, 1, 0), 8, 80), (3, (-1, 1, 1, 1, 1), 8, 10), (3, (-1, -1, -1, -1, 0), 8, 200)]
    *w, size = (model := pii.fit_votes(counts)[3])[1]
    z = lambda v: model[0] + size / 2 + sum(a * b for a, b in zip(w, v, strict=True))
    assert z((1, 1, 1, 1, 1)) > z((-1, 1, 1, 1, 1)) > z((-1, -1, -1, -1, 0)) and z((-1, -1, -1, -1, 0)) < 0
    # A labeler that contradicts the others at random is believed less.
    noisy = [(3, (1, 1, 1, 1, x), 8, 50) for x in (-1, 1)] + [(3, (-1, -1, -1, -1, x), 8, 50) for x in (-1, 1)]
    assert abs(pii.fit_votes(noisy)[3][1][4]) < pii.fit_votes(noisy)[3][1][0]


CLASHES = ["a.b", "__id", "__n", "__copies", "__d", "copies", "size", "place", "c0", "node", "text_hash", "i", "rows"]


def test_every_query_on_empty_tables(spark, sf, tmp_path):
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_every_query_beside_clashing_columns(spark, sf, tmp_path):
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        df = spark.read.parquet(f"{sf}/{t}.parquet")
        df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(CLASHES)]).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, query in QUERIES.items():
        assert sorted(map(str, query(spark, str(tmp_path)).collect())) == sorted(map(str, query(spark, sf).collect())), name


PROSE = "<p>" + "The county kept its records in a stone house, and they were read often. " * 3 + "</p>"


def test_html_article_headers_and_innocent_names():
    keep = lambda page: html_text.main_text(f"<html><body>{page}</body></html>").split("\n")
    line = PROSE[3:-4].strip()
    assert keep(f"<article><header><h1>Title here</h1></header>{PROSE}{PROSE}</article>") == ["Title here", line, line]
    menu = "<nav class=menu><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
    assert keep(f"<article><header><h1>Title</h1>{menu}</header>{PROSE}{PROSE}</article>") == ["Title", line, line]
    assert keep(f"<header><h1>Site</h1>{menu}</header><article><h1>Title</h1>{PROSE}{PROSE}</article>") == ["Title", line, line]
    for bad in ("social", "nav", "share", "comment", "form", "family"):
        section = f'<section class="{bad}-history"><h2>Social history</h2>{PROSE}{PROSE}</section>'
        assert keep(f"{menu}<article><h1>Title</h1>{PROSE}{section}{PROSE}</article><footer>&copy; x</footer>") == ["Title", line, "Social history", line, line, line]


def test_language_of_long_texts_in_slices(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(3)
    model = language.LanguageModel(["x", "y", "z"], rng.standard_normal((1 << language.BUCKET_BITS, 3)).astype(np.float32), rng.standard_normal(3), 0.7, 0.0)
    texts = [bytes(rng.integers(60, 200, int(n), np.uint8)) for n in (0, 1, 3, 900, 4000, 4001, 12_345)]
    whole = model.scores(texts)
    monkeypatch.setattr(language, "SLICE", 400)
    assert np.allclose(model.scores(texts), whole, rtol=1e-9)
    monkeypatch.undo()
    long = "Der Text ist lang, und das Wort ist kurz. " * ((64 << 20) // 42)
    tracemalloc.start()
    model.scores([language._bytes(long)])
    assert tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()


def test_token_ids_come_back(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.vocabulary_path())
    parts = tokens.with_bases(tokens.write_token_files(docs, f"file://{tmp_path}/a", parts=3))
    got = collections.Counter((r["doc_id"], tuple(r["ids"])) for r in tokens.token_ids(parts).collect())
    assert got == collections.Counter((d, (*plain.encode(t or "", add_special_tokens=False).ids, tokens.END_ID)) for d, t, *_ in ROWS)
    assert tokens.token_ids(tokens.with_bases(tokens.write_token_files(none, f"file://{tmp_path}/b"))).count() == 0
