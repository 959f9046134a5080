import gzip
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.functions import u64
from tessera.functions.kmers import kmer_hashes, many_kmer_hashes
from tessera.operators import compare as C
from tessera.operators import prune, reorder
from tessera.operators.sketch import SketchParams, bucket_minima, densify, empty_cells, empty_documents, fingerprints, mean_size, sketch
from tessera.sources import fastx
from tessera.sources import index as I  # noqa: E741
from tessera.operators.components import components
from tessera.sources.results import read_lines, read_sparse, write_lines
from tessera.sources.sequences import read_file_list, read_records
from tessera.sources.work import numbered

SEQS = [
    "GATTACAGATTACCAGTTGACCATGCAAGT", "ACTTGCATGGTCAACTGGTAATCTGTAATC", "gattacagattaccagttgaccatgcaagt", "GATTACAGATTACCANGTTGACCATGCAAGT",
    "ACGT", "GATTACAGATTACCAGTTGTCCATGCAAGT", "NNNNACGTANNN",
]
P = SketchParams(k=5, ls=3, w=8)
CELLS = {
    0: [124, 175, 250, 108, 123, 205, 51, 172], 3: [124, 175, 250, 72, 123, 205, 51, 172],
    5: [239, 175, 250, 108, 123, 205, 123, 207], 6: [None, None, None, None, None, None, 106, None],
}
LINES = [
    "query_0\t0:1.0000,1:1.0000,2:1.0000,3:0.8750,5:0.6250", "query_1\t0:1.0000,1:1.0000,2:1.0000,3:0.8750,5:0.6250", "query_2\t0:1.0000,1:1.0000,2:1.0000,3:0.8750,5:0.6250",
    "query_3\t3:1.0000,0:0.8750,1:0.8750,2:0.8750,5:0.5000", "query_4\t", "query_5\t5:1.0000,0:0.6250,1:0.6250,2:0.6250,3:0.5000", "query_6\t6:0.1250",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(SEQS)), "gid long, seq string")


@pytest.fixture(scope="module")
def sk(docs):
    return sketch(docs, P).cache()


def lines(df):
    return [r["line"] for r in df.orderBy("qid").collect()]


def test_fixture_sketch(sk):
    got = {}
    for r in sk.collect():
        got.setdefault(r["gid"], [None] * 8)[r["pos"]] = r["fp"]
    assert got == {0: CELLS[0], 1: CELLS[0], 2: CELLS[0], 3: CELLS[3], 5: CELLS[5], 6: CELLS[6]}


def test_fixture_lines(docs, sk):
    assert lines(C.sparse_lines(C.compare(sk, sk, 8), docs)) == LINES
    high = lines(C.sparse_lines(C.compare(sk, sk, 8, 0.9), docs))
    assert high[0] == "query_0\t0:1.0000,1:1.0000,2:1.0000" and high[3] == "query_3\t3:1.0000" and high[4] == "query_4\t" and high[6] == "query_6\t"
    m = lines(C.matrix_lines(C.compare(sk, sk, 8), docs, docs))
    assert m[6] == "query_6\t" + ",".join(["0.0000"] * 6 + ["0.1250"])
    assert C.compare(sk, sk, 8).count() == 26


def test_self_comparison_and_thresholds(sk):
    found = {(r["qid"], r["rid"]): r["matches"] for r in C.compare_self(sk, 8).collect()}
    assert (0, 0) not in found and found[0, 3] == found[3, 0] == 7
    assert C.compare_self(sk, 8, -1).count() == len(found) and C.compare(sk, sk, 8, 1.5).count() == 0
    for t in (0.1, 0.5, 0.9, 1.0):
        a, b = C.compare(sk, sk, 8, t), C.prefix_compare(sk, sk, 8, t)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    cut, s = C.first_positions(sk, 8, 3)
    assert s == 3 and cut.agg(F.max("pos")).first()[0] == 2 and C.first_positions(sk, 8, 0)[1] == 8


def test_empty_documents_and_cells(docs, sk):
    assert [r["gid"] for r in empty_documents(docs, sk).collect()] == [4]
    n = {r["gid"]: r["n_empty"] for r in empty_cells(docs, sk, P).collect()}
    assert (n[0], n[4], n[6]) == (0, 8, 7)


def test_empty_table(spark):
    none = spark.createDataFrame([], "gid long, seq string")
    s = sketch(none, P)
    assert s.count() == 0 and C.compare(s, s, 8).count() == 0 and mean_size(none).first()["e"] == 5_000_000
    nulls = spark.createDataFrame([(None, "ACGTACGT"), (1, None), (2, "")], "gid long, seq string")
    assert sketch(nulls, P).count() == 0


def test_pooled_records(spark):
    rows = [(0, "GATTACAGATT"), (0, "CCATGCAAGTT"), (1, "GATTACAGATTNCCATGCAAGTT")]
    got = sketch(spark.createDataFrame(rows, "gid long, seq string"), P).collect()
    by = {g: sorted((r["pos"], r["h"]) for r in got if r["gid"] == g) for g in (0, 1)}
    assert by[0] == by[1]


def plain_densify(v):
    s = len(v)
    step = 0
    mix = lambda x: int(u64.np_fmix64(np.array([x], np.uint64))[0])
    star = lambda x: int(u64.np_xorshift_star(np.array([x], np.uint64))[0])
    while any(x is not None for x in v) and any(x is None for x in v):
        proposed = [(((mix(x) + step * star(x)) % (1 << 64)) % s, x) for x in v if x is not None]
        proposed = [(p, x) for p, x in proposed if v[p] is None]
        if not proposed:
            break
        for p, x in proposed:
            if v[p] is None:
                v[p] = x
        step += 1
    return v


def test_densification_against_plain_rule():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 20, 200):
        cells, filled = bucket_minima(rng.integers(0, 1 << 63, n).astype(np.uint64), 5)
        c, f = densify(cells, filled)
        expected = plain_densify([int(x) if ok else None for x, ok in zip(cells, filled, strict=True)])
        assert [int(x) if ok else None for x, ok in zip(c, f, strict=True)] == expected


def test_perfect_fingerprints():
    h = np.array([0x10000000000, 0x4000000000000, 0x40000000000000, 0x400000000000000, 0x1000000000000000, 0xFFFFFFFFFFFFFFFF], np.uint64)
    for e, ls, w, expected in ((5_000_000, 16, 16, [0, 304, 4707, 45826, 65059, -1]), (100_000, 10, 16, [0, 389, 5964, 51457, 65415, -1]), (100_000, 10, 8, [0, 1, 23, 201, 255, -1])):
        assert fingerprints(h, np.ones(6, bool), SketchParams(5, ls, w, e, "perfect")).tolist() == expected


def test_four_decimals_round_ties_to_even(spark):
    df = spark.createDataFrame([(32 / 1024,), (96 / 1024,), (1.0,)], "x double")
    assert [r[0] for r in df.select(C.decimals4(F.col("x"))).collect()] == ["0.0312", "0.0938", "1.0000"]


def test_log_mass(spark):
    rows = [(1, 1, 0.5, 0.0), (1, 10, 0.5, -4.449306121), (1, 21, 0.5, -10.282444106), (5, 40, 0.5, -13.288286635), (10, 1024, 0.1, 0.0), (300, 1024, 0.5, -91.471529425)]
    df = spark.createDataFrame(rows, "k int, n int, p double, x double")
    assert all(math.isclose(a, b, abs_tol=1e-8) for a, b in df.select(prune.log_mass(F.col("k"), F.col("n"), F.col("p")), "x").collect())


def test_pruning_fold(spark):
    cases = [(range(0, 64, 2), 32), (range(32, 64), None), (range(16, 64), None), ([0, 30, *range(31, 64)], None)]
    hits = spark.createDataFrame([(0, i, p) for i, (at, _) in enumerate(cases) for p in at], "qid long, rid long, pos int")
    got = {r["rid"]: r["matches"] for r in prune.pruned_counts(hits, 64, 0.5).collect()}
    assert got == {i: n for i, (_, n) in enumerate(cases) if n}
    rng = np.random.default_rng(5)
    many = {i: sorted(rng.choice(300, int(n), False).tolist()) for i, n in enumerate(rng.integers(1, 299, 40))}
    hits = spark.createDataFrame([(0, i, p) for i, at in many.items() for p in at], "qid long, rid long, pos int")
    assert {r["rid"]: r["matches"] for r in prune.pruned_counts(hits, 300, 0.1, 0.0).collect()} == {i: len(at) for i, at in many.items() if len(at) >= 30}


@pytest.mark.parametrize(("n", "pairs", "expected"), [(6, [(0, 1, 0.9), (1, 2, 0.6), (3, 4, 0.9)], [1, 0, 4, 3, 2, 5]), (4, [], [3, 2, 1, 0]), (5, [(0, 2, 0.8), (0, 1, 0.8), (2, 3, 0.5)], [0, 1, 2, 3, 4])])
def test_greedy_order(spark, n, pairs, expected):
    docs = spark.range(n).withColumnRenamed("id", "gid")
    both = [(a, b, s) for a, b, s in pairs] + [(b, a, s) for a, b, s in pairs]
    e = reorder.edges(spark.createDataFrame(both, "qid long, rid long, score double"), 0.1)
    assert [r["old_gid"] for r in reorder.greedy_order(docs, e).orderBy("new_gid").collect()] == expected
    with pytest.raises(ValueError):
        reorder.greedy_order(docs, e, -1)


def test_index_round_trip_and_check(spark, docs, sk, tmp_path):
    i = I.build(docs, sk, P)
    I.save(i, str(tmp_path / "i"))
    back = I.load(spark, str(tmp_path / "i"))
    assert (back.params, back.n_docs, back.n_empty) == (P, 7, 1)
    key = lambda df: sorted(map(tuple, df.select("gid", "pos", "fp").collect()))
    assert key(back.sketch()) == key(sk)
    p = I.postings(sk)
    assert sorted(map(str, I.undeltas(I.deltas(p)).collect())) == sorted(map(str, p.collect()))
    for other in (SketchParams(6, 3, 8), SketchParams(5, 4, 8), SketchParams(5, 3, 9), SketchParams(5, 3, 8, mode="perfect")):
        with pytest.raises(ValueError):
            i.check(I.Index(p, other, 7, 1))
    with pytest.raises(ValueError):
        SketchParams(ls=40)


def test_sequence_files(spark, tmp_path):
    import zstandard

    fasta = b">a x>y\r\nACGT\r\nAC\r\n\r\n>b\r\nGG\r\n"
    (tmp_path / "a.fa").write_bytes(fasta)
    (tmp_path / "b").write_bytes(gzip.compress(fasta[:17]) + gzip.compress(fasta[17:]))
    (tmp_path / "c").write_bytes(zstandard.compress(b"@r\nACGT\n+\n>@>@\n@s\nTT\n+\n@@\n"))
    (tmp_path / "e.fa").write_bytes(b"")
    for name in ("a.fa", "b"):
        assert [tuple(r) for r in read_records(spark, str(tmp_path / name)).orderBy("gid").collect()] == [(0, "a", "ACGTAC"), (1, "b", "GG")]
    assert [r["seq"] for r in read_records(spark, str(tmp_path / "c")).orderBy("gid").collect()] == ["ACGT", "TT"]
    assert read_records(spark, str(tmp_path / "e.fa")).count() == 0
    (tmp_path / "many").mkdir()
    for i, n in enumerate((2, 0, 1500)):
        (tmp_path / "many" / f"{i}.fa").write_text("".join(f">{i}x{j}\nACGT\n" for j in range(n)))
    got = [tuple(r) for r in read_records(spark, str(tmp_path / "many")).select("gid", "name").orderBy("gid").collect()]
    assert got == list(enumerate([f"0x{j}" for j in range(2)] + [f"2x{j}" for j in range(1500)]))
    (tmp_path / "list").write_text(f"{tmp_path}/a.fa\n\n{tmp_path}/missing\n{tmp_path}/c\n")
    assert sorted(map(tuple, read_file_list(spark, str(tmp_path / "list")).collect())) == [(0, 0, "ACGTAC"), (0, 1, "GG"), (3, 0, "ACGT"), (3, 1, "TT")]


def blocked(data, size):
    """Block-gzip: members with their size in an extra field."""
    import struct
    import zlib

    out = b""
    for lo in range(0, len(data), size):
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflate.compress(data[lo : lo + size]) + deflate.flush()
        head = b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<H", 6) + b"BC\x02\x00" + struct.pack("<H", len(body) + 25)
        out += head + body + struct.pack("<II", zlib.crc32(data[lo : lo + size]), len(data[lo : lo + size]))
    return out


def test_ranges_of_one_file(spark, tmp_path):
    import zstandard

    rng = np.random.default_rng(12)
    fasta = [(f"r{i}", "".join(rng.choice(list("ACGT>@+"[:4]), int(rng.integers(0, 300))))) for i in range(400)]
    wrapped = "".join(f">{n} more\n" + "".join(q[lo : lo + 60] + "\n" for lo in range(0, len(q), 60)) for n, q in fasta).encode()
    reads = [(n, q or "A") for n, q in fasta]
    fastq = "".join(f"@{n} x\r\n{q}\r\n+\r\n{''.join(rng.choice(list('@+>I'), len(q)))}\r\n" for n, q in reads).encode()
    for name, data, want in (("a", wrapped, fasta), ("q", fastq, reads)):
        for kind, content in (("plain", data), ("gz", gzip.compress(data[:999]) + gzip.compress(data[999:])), ("zst", zstandard.compress(data)), ("bgz", blocked(data, 700))):
            path = tmp_path / f"{name}.{kind}"
            path.write_bytes(content)
            for step in (37, 1000, 1 << 26):
                parts = fastx.FastxReader({"path": str(path), "rangebytes": step}).partitions()
                assert (len(parts) > 1) == (kind in ("plain", "bgz") and step < len(content))
                got = [r for p in parts[:: 1 if step > 37 else 1] for b in fastx.FastxReader({"path": str(path)}).read(p) for r in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
                assert got == want, (name, kind, step)
            assert list(fastx.content_records(content)) == want
    got = [(r["name"], r["seq"]) for r in read_records(spark, str(tmp_path / "a.plain"), 5000).orderBy("gid").collect()]
    assert got == fasta
    for broken in (b"ACGT\n", b"@r\nACGT\nACGT\n", gzip.compress(b">a\nACGT\n")[:-9]):
        with pytest.raises((ValueError, EOFError)):
            list(fastx.content_records(broken))


def test_long_streams_are_read_in_blocks(tmp_path):
    import tracemalloc

    with gzip.open(tmp_path / "long.gz", "wb", 1) as f:
        for i in range(400):
            f.write(b">r%d\n" % i + b"ACGTTGCA" * 25_000 + b"\n")
    (part,) = fastx.FastxReader({"path": str(tmp_path / "long.gz")}).partitions()
    tracemalloc.start()
    assert sum(b.num_rows for b in fastx.FastxReader({"path": part.path}).read(part)) == 400
    assert tracemalloc.get_traced_memory()[1] < 30 << 20  # of 80 MB
    tracemalloc.stop()


def test_results_read_again(spark, docs, sk, tmp_path):
    hits = C.compare(sk, sk, 8)
    for level in (0, 1, 9):
        write_lines(C.sparse_lines(hits, docs), str(tmp_path / f"r{level}"), level)
        assert sorted(map(tuple, read_sparse(spark, str(tmp_path / f"r{level}")).collect())) == sorted((r["qid"], r["rid"], round(r["score"], 4)) for r in hits.collect())
    with pytest.raises(FileExistsError):
        write_lines(C.sparse_lines(hits, docs), str(tmp_path / "r1"), 1)


def test_a_failed_result_leaves_nothing(spark, tmp_path):
    from tessera.sources.results import COMMITTED

    rows = spark.range(0, 400, 1, 4).select(F.col("id").alias("qid"), F.col("id").cast("string").alias("line"))
    with pytest.raises(Exception, match="no such row"):
        write_lines(rows.withColumn("line", F.when(F.col("qid") == 399, F.raise_error(F.lit("no such row"))).otherwise(F.col("line"))), str(tmp_path / "bad"), 3)
    assert not (tmp_path / "bad").exists() or not list((tmp_path / "bad").iterdir())
    write_lines(rows, str(tmp_path / "good"), 3)
    names = (tmp_path / "good" / COMMITTED).read_text().split()
    assert sorted(x.name for x in (tmp_path / "good").iterdir() if not x.name.startswith("_") and x.suffix != ".crc") == names
    assert sorted(int(r["value"]) for r in read_lines(spark, str(tmp_path / "good")).collect()) == list(range(400))


def test_matrix_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "COLUMNS", 3)
    ids = spark.range(10).select((F.col("id") * 5).alias("gid"))
    hits = spark.createDataFrame([(0, 45, 9, 0.9), (0, 5, 2, 0.2), (10, 10, 1, 0.10005)], "qid long, rid long, matches long, score double")
    got = {(r["qid"], r["rid"]): r["score"] for r in C.matrix(hits, ids, ids, 0.15).collect()}
    assert len(got) == 100 and {k: v for k, v in got.items() if v} == {(0, 45): 0.9, (0, 5): 0.2}
    table = lines(C.matrix_lines(hits, ids, ids))
    assert len(table) == 10 and table[0] == "query_0\t0.0000,0.2000,0.0000,0.0000,0.0000,0.0000,0.0000,0.0000,0.0000,0.9000" and table[2].startswith("query_10\t0.0000,0.0000,0.1001,")
    assert "CartesianProduct" not in (plan := C.matrix(hits, ids, ids)._jdf.queryExecution().executedPlan().toString()) and "BroadcastNestedLoopJoin" not in plan
    assert C.matrix(hits.limit(0), ids, ids.limit(0)).count() == 0


def test_result_files_are_in_query_order(spark, tmp_path):
    lines = spark.range(5000).select(F.col("id").alias("qid"), F.concat(F.lit("query_"), F.col("id")).alias("line")).orderBy(F.rand(1))
    for level in (0, 3):
        write_lines(lines, str(tmp_path / f"o{level}"), level)
        parts = sorted(p for p in (tmp_path / f"o{level}").iterdir() if p.name.startswith("part-") and not p.name.endswith(".crc"))
        import zstandard

        read = lambda p: zstandard.ZstdDecompressor().stream_reader(p.read_bytes()).read().decode() if p.suffix == ".zst" else p.read_text()
        assert "".join(map(read, parts)).split() == [f"query_{i}" for i in range(5000)]


def test_lists_in_parts_and_mean_size(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nACGTACGTAC\n>y\nACGTACGTAC\n")
    (tmp_path / "empty.fa").write_text("")
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists" / "1").write_text(f"{tmp_path}/a.fa\n{tmp_path}/empty.fa\n")
    (tmp_path / "lists" / "2").write_text(f"{tmp_path}/a.fa\n/nowhere/x\n")
    docs = read_file_list(spark, str(tmp_path / "lists"))
    assert sorted((r["gid"], r["rec"]) for r in docs.collect()) == [(0, 0), (0, 1), (2, 0), (2, 1)]
    assert mean_size(docs, drop_empty=True).first()["e"] == 20
    rows = spark.createDataFrame([(0, "ACGT"), (1, ""), (2, None), (None, "ACGTACGT")], "gid long, seq string")
    assert mean_size(rows).first()["e"] == 1 and mean_size(rows, drop_empty=True).first()["e"] == 4


def test_default_command_line(spark, tmp_path):
    (tmp_path / "x.fa").write_text("".join(f">{i}\n{s}\n" for i, s in enumerate(SEQS)))
    said = []
    cli.main(["sketch", "--input-fasta", str(tmp_path / "x.fa"), "-o", str(tmp_path / "i"), "-k", "5", "-s", "3", "-w", "8", "--reorder-similarity", "--no-compress", "--threads", "2"], spark, said.append)
    assert any("1 documents have no sketch" in x for x in said) and any(x.startswith("first of the new order: ") for x in said)
    back = I.load(spark, str(tmp_path / "i"))
    order = {r["new_gid"]: r["old_gid"] for r in back.order.collect()}
    assert sorted(order.values()) == [0, 1, 2, 3, 5, 6]
    cli.main(["compare", "--ref-sketch", str(tmp_path / "i"), "-o", str(tmp_path / "o"), "--print-stats"], spark, said.append)
    got = {r["value"].split("\t")[0]: r["value"].split("\t")[1] for r in read_lines(spark, str(tmp_path / "o")).collect()}
    new = {old: n for n, old in order.items()}
    assert {x.split(":")[0] for x in got[f"query_{new[0]}"].split(",")} == {str(new[i]) for i in (1, 2, 3, 5)}
    assert any(x.startswith("ref: s 8") for x in said) and said[-1] == "20 scores"


def test_pruning_flags(spark, tmp_path):
    (tmp_path / "x.fa").write_text("".join(f">{i}\n{s}\n" for i, s in enumerate(SEQS)))
    size = ["-k", "5", "-s", "3", "-w", "8", "--ref-fasta", str(tmp_path / "x.fa"), "--threshold", "0.6"]
    for name, more in (("whole", []), ("pruned", ["--prob-threshold-heuristic"]), ("off", ["--prob-threshold-heuristic", "--prob-threshold-probability", "0"])):
        cli.main(["compare", *size, *more, "-o", str(tmp_path / name)], spark, lambda x: None)
    read = lambda name: {(r["qid"], r["rid"]): r["score"] for r in read_sparse(spark, str(tmp_path / name)).collect()}
    assert read("whole") == read("off") and set(read("pruned")) <= set(read("whole")) and read("pruned")


def test_totals(sk, docs):
    hits = C.compare(sk, sk, 8, 0.6)
    n = hits.count()
    assert {r["mode"]: r["total"] for r in C.totals(hits, docs, docs, 0.6).collect()} == {"sparse": n, "matrix": n}
    assert {r["mode"]: r["total"] for r in C.totals(C.compare(sk, sk, 8), docs, docs).collect()} == {"sparse": 26, "matrix": 49}


def test_many_kmers_at_once():
    seqs = [None, "", "ACG", *SEQS, "acgtNACGTTTAGC" * 9, "日本ACGTACGT"]
    for k in (1, 3, 5, 31):
        owner, h = many_kmer_hashes(seqs, k)
        for i, s in enumerate(seqs):
            assert (h[owner == i] == kmer_hashes(s, k)).all()


def test_densify_many_at_once():
    rng = np.random.default_rng(4)
    rows = [bucket_minima(rng.integers(0, 1 << 63, n).astype(np.uint64), 6) for n in (0, 1, 3, 30, 500, 2)]
    c, f = densify(np.array([x[0] for x in rows]), np.array([x[1] for x in rows]))
    for i, row in enumerate(rows):
        a, b = densify(*row)
        assert (b == f[i]).all() and (a[b] == c[i][b]).all()


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(e).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components(e.limit(0)).count() == 0


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    assert sorted(map(tuple, numbered(df, F.desc("x"), name="n").collect())) == [(i, 999 - i) for i in range(1000)]
    assert numbered(df.limit(0), "x", name="n").count() == 0


def test_walks_of_components_make_the_whole_walk(spark):
    rng = np.random.default_rng(9)
    n = 120
    pairs = {tuple(sorted(map(int, rng.integers(0, n, 2)))): float(rng.integers(5, 10)) / 10 for _ in range(90)}
    both = [(a, b, s) for (a, b), s in pairs.items() if a != b] + [(b, a, s) for (a, b), s in pairs.items() if a != b]
    e = reorder.edges(spark.createDataFrame(both, "qid long, rid long, score double"), 0.1)
    near, weight = {}, dict.fromkeys(range(n), 0)
    for a, b, s in both:
        near.setdefault(a, []).append((-s, b))
        weight[a] += 2 * round(s * 10000)
    seen, at, expected = set(), None, []
    while len(expected) < n:
        at = at if at is not None else max((w, i) for i, w in weight.items() if i not in seen)[1]
        seen.add(at)
        expected.append(at)
        at = next((b for _, b in sorted(near.get(at, [])) if b not in seen), None)
    docs = spark.range(n).withColumnRenamed("id", "gid")
    assert [r["old_gid"] for r in reorder.greedy_order(docs, e).orderBy("new_gid").collect()] == expected


def test_chunked_postings(spark, sk):
    whole = I.postings(sk)
    parts = I.chunked_postings(sk, 2)
    assert parts.agg(F.max("n")).first()[0] == 2
    glued = parts.groupBy("pos", "fp").agg(F.array_sort(F.flatten(F.collect_list("gids"))).alias("gids"))
    assert sorted(map(str, glued.collect())) == sorted(map(str, whole.select("pos", "fp", "gids").collect()))
    long = spark.createDataFrame([(0, 0, 1000, sorted(np.random.default_rng(1).choice(9999, 1000, False).tolist()))], "pos int, fp long, n int, gids array<long>")
    assert I.undeltas(I.deltas(long)).collect() == long.collect()
    assert {r["pos"] for r in I.read_positions(I.Index(whole, P, 7, 1), 2, 4).collect()} <= {2, 3, 4}


def test_chunks_are_cut_over_batches(spark):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    rows = sorted({(int(p), int(f), int(g)) for p, f, g in rng.integers(0, [3, 2, 400], (900, 3))})
    for width in (1, 7, 64, 900):
        cols = lambda part: [pa.array([r[i] for r in part], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.int64()))]
        batches = [pa.RecordBatch.from_arrays(cols(rows[lo : lo + width]), ["pos", "fp", "gid"]) for lo in range(0, len(rows), width)]
        got = [r for b in I._chunks(16)(iter(batches)) for r in b.to_pylist()]
        assert [(r["pos"], r["fp"], g) for r in got for g in r["gids"]] == rows and all(r["n"] == len(r["gids"]) <= 16 for r in got)
        for key in {r[:2] for r in rows}:
            mine = [r for r in got if (r["pos"], r["fp"]) == key]
            assert [r["chunk"] for r in mine] == list(range(len(mine))) and all(r["n"] == 16 for r in mine[:-1])
    assert list(I._chunks(16)(iter([]))) == []


def made_sketch(spark, n=80, s=64, seed=3):
    """Sketches that are noisy copies of a few, some shorter, with one cell that all documents hold."""
    rng = np.random.default_rng(seed)
    base, rows = rng.integers(1, 9, (4, s)), []
    for gid in range(n):
        fp = np.where(rng.random(s) < rng.choice([0, 0.1, 0.3, 0.6]), rng.integers(1, 9, s), base[gid % 4])
        fp[5] = 0
        rows += [(gid, pos, int(x)) for pos, x in enumerate(fp) if pos == 5 or rng.random() < (0.5 if gid % 7 == 0 else 1)]
    return spark.createDataFrame(rows, "gid long, pos int, fp long"), rows


def plain_counts(rows):
    cells = {}
    for gid, pos, fp in rows:
        cells.setdefault(gid, set()).add((pos, fp))
    return {(a, b): n for a in cells for b in cells if (n := len(cells[a] & cells[b]))}


def test_comparisons_agree_with_plain_counts(spark, tmp_path):
    sk, rows = made_sketch(spark)
    want = plain_counts(rows)
    stored = {}
    for size in (4096, 16):  # with chunks of 16 every list is hot
        I.save(I.Index(I.chunked_postings(sk, size), P, 80, 0), str(tmp_path / f"i{size}"))
        stored[size] = I.load(spark, str(tmp_path / f"i{size}"))
        stored[size].params = SketchParams(5, 6, 8)
    got = lambda df: {(r["qid"], r["rid"]): r["matches"] for r in df.collect()}
    for threshold in (0.0, 0.3, 0.8, 1.0):
        least = C.min_matches(threshold, 64)
        expected = {k: n for k, n in want.items() if n >= least}
        assert got(C.compare(C.as_rows(sk), C.as_rows(sk), 64, threshold)) == expected
        assert got(C.compare(sk, sk, 64, threshold)) == expected
        for index in stored.values():
            found = I.compare_stored(index, index, threshold).collect()
            assert {(r["qid"], r["rid"]): r["matches"] for r in found} == expected and len(found) == len(expected)


def test_stored_lists_meet_without_a_shuffle(spark, tmp_path):
    sk, _ = made_sketch(spark, 30)
    I.save(I.Index(I.chunked_postings(sk), P, 30, 0), str(tmp_path / "i"))
    index = I.load(spark, str(tmp_path / "i"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    plan = I.list_hits(index.postings, index.postings)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_a_cell_of_all_documents_is_dealt(spark):
    n, most = 4000, 250
    a = spark.range(n).select(F.lit(7).cast("long").alias("cell"), F.col("id").alias("qid"))
    b = a.select("cell", F.col("qid").alias("rid"))
    met = C.meetings(a, b, [(7, n)], most)
    assert met.count() == n * n and met.select("qid", "rid").distinct().count() == n * n
    sizes = sorted(r["count"] for r in met.groupBy(F.pmod(F.xxhash64("qid"), F.lit(16)), F.pmod(F.xxhash64("rid"), F.lit(16))).count().collect())
    assert len(sizes) == 256 and sizes[-1] <= 3 * sizes[128]
    # A sample tells which cells those are.
    rows = spark.range(n).select(F.col("id").alias("gid"), F.array(F.lit(7).cast("long"), F.col("id") + 100).alias("cells"))
    cell, about = C.frequent_cells(rows)[0]
    assert cell == 7 and n * 0.8 < about < n * 1.2


def test_walk_on_classes(spark):
    sk, rows = made_sketch(spark, 60, 32, 8)
    copies = [(100 + 7 * k + gid, pos, fp) for gid, pos, fp in rows if gid < 6 for k in range(gid + 1)]
    sk = sk.unionByName(spark.createDataFrame(copies, "gid long, pos int, fp long"))
    docs = spark.range(160).withColumnRenamed("id", "gid")
    order = lambda df: [r["old_gid"] for r in df.orderBy("new_gid").collect()]
    for least in (0.3, 0.7):
        whole = order(reorder.greedy_order(docs, reorder.edges(C.compare_self(sk, 32, least), least)))
        c = C.classes(sk)
        hits = C.compare_self(C.as_rows(C.representatives(sk, c)), 32, least)
        assert order(reorder.class_order(docs, c, hits, 32, least)) == whole and sorted(whole) == list(range(160))
    many = spark.range(20_000).select(F.col("id").alias("gid"), F.array(F.lit(3).cast("long"), F.lit(9).cast("long")).alias("cells"))
    got = order(reorder.class_order(many, C.classes(many), spark.createDataFrame([], "qid long, rid long, score double"), 2, 0.5))
    assert got == [19_999, *range(19_999)]


def test_command_line(spark, tmp_path):
    (tmp_path / "x.fa").write_text("".join(f">{i}\n{s}\n" for i, s in enumerate(SEQS)))
    cli.main(["sketch", "--input-fasta", str(tmp_path / "x.fa"), "-o", str(tmp_path / "i"), "-k", "5", "-s", "3", "-w", "8"], spark)
    cli.main(["compare", "--ref-sketch", str(tmp_path / "i"), "--query-fasta", str(tmp_path / "x.fa"), "-k", "5", "-s", "3", "-w", "8", "-o", str(tmp_path / "o"), "--zstd-level", "0"], spark)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "o")).orderBy("value").collect()] == LINES
    with pytest.raises(ValueError):
        cli.main(["compare", "--ref-sketch", str(tmp_path / "i"), "--query-fasta", str(tmp_path / "x.fa"), "-k", "6", "-s", "3", "-w", "8", "-o", str(tmp_path / "p")], spark)


def test_command_line_keeps_ids_behind_missing_files(spark, tmp_path):
    for i in (0, 3):
        (tmp_path / f"{i}.fa").write_text(f">x\n{SEQS[0]}\n")
    (tmp_path / "list").write_text(f"{tmp_path}/0.fa\n\n{tmp_path}/missing\n{tmp_path}/3.fa\n")
    size = ["-k", "5", "-s", "3", "-w", "8"]
    cli.main(["sketch", "--input-fof", str(tmp_path / "list"), "-o", str(tmp_path / "i"), *size], spark)
    for name, side, more in (("stored", ["--query-sketch", str(tmp_path / "i")], []), ("direct", ["--query-fof", str(tmp_path / "list")], []), ("matrix", ["--query-sketch", str(tmp_path / "i")], ["--matrix"])):
        cli.main(["compare", "--ref-sketch", str(tmp_path / "i"), *side, *size, *more, "-o", str(tmp_path / name), "--zstd-level", "0"], spark)
    read = lambda name: [r["value"] for r in spark.read.text(str(tmp_path / name)).orderBy("value").collect()]
    assert read("stored") == read("direct") == ["query_0\t0:1.0000,3:1.0000", "query_1\t", "query_2\t", "query_3\t0:1.0000,3:1.0000"]
    assert read("matrix")[3] == "query_3\t1.0000,0.0000,0.0000,1.0000" and len(read("matrix")) == 4
