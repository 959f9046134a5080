"""What the comparison writes and moves stays near the size of its tables, and is whole."""

import glob
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.kmers import kmer_hashes
from tessera.operators import blocks, groups, prune, reorder
from tessera.operators import compare as C
from tessera.operators.components import components
from tessera.operators.sketch import SketchParams, _digests
from tessera.plans import queries as Q
from tessera.sources import index as I  # noqa: E741
from tessera.sources import work


@pytest.fixture
def folder(monkeypatch, tmp_path):
    """A work folder of the test's own."""
    monkeypatch.setattr(work, "work_folder", lambda spark: f"file://{tmp_path}/work")
    return tmp_path / "work"


def strangers(spark, n, s=64, bits=12, seed=1):
    """Documents that are alike by chance alone, a copy of one and a near copy."""
    cells = np.random.default_rng(seed).integers(0, 1 << bits, (n, s))
    cells[1] = cells[0]
    cells[2] = np.where(np.arange(s) < s // 2, cells[0], cells[2])
    rows = [(i, [int(p) << 32 | int(x) for p, x in enumerate(r)]) for i, r in enumerate(cells)]
    return spark.createDataFrame(rows, "gid long, cells array<long>").repartition(4), cells


def counts(cells):
    n = (cells[:, None, :] == cells[None, :, :]).sum(2)
    return {(int(a), int(b)): int(n[a, b]) for a, b in zip(*np.nonzero(n), strict=True)}


def got(df):
    rows = df.collect()
    found = {(r["qid"], r["rid"]): r["matches"] for r in rows}
    assert len(found) == len(rows)
    return found


def written(spark, folder, name):
    found = glob.glob(f"{folder}/{name}-*")
    return sum(spark.read.parquet(f"file://{x}").count() for x in found) if found else None


def test_blocks_count_all_pairs(spark, monkeypatch):
    rows, cells = strangers(spark, 90, 8, 3)
    cells[10:40] = cells[5]  # many copies
    rows = spark.createDataFrame([(i, [p << 32 | int(x) for p, x in enumerate(r)]) for i, r in enumerate(cells)], "gid long, cells array<long>")
    want = counts(cells)
    few = rows.where("gid < 7")
    for size, hits, out, table in ((1 << 22, 1 << 21, 1 << 18, 1 << 24), (128, 5, 3, 0)):
        for name, value in (("CELLS", size), ("HITS", hits), ("OUT", out), ("TABLE", table)):
            monkeypatch.setattr(blocks, name, value)
        assert got(C.pair_counts(rows, rows)) == want
        assert got(C.pair_counts(few, rows)) == {k: n for k, n in want.items() if k[0] < 7}
        assert got(C.pair_counts(rows, few, 3)) == {k: n for k, n in want.items() if k[1] < 7 and n >= 3}


def test_pairs_are_not_shuffled(spark):
    rows, _ = strangers(spark, 3000)
    plan = C.pair_counts(rows, rows)._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(exchanges) == 1 and "hashpartitioning(i#" in exchanges[0]


def packed(x):
    return len(zlib.compress(np.asarray(x, np.int16).tobytes()))


def test_pairs_leave_list_by_list(spark):
    rows, cells = strangers(spark, 1000, 8, 5)
    found = C.pair_counts(rows, rows).toPandas()
    ordered = found.sort_values(["qid", "rid"])
    assert len(found) == (cells[:, None, :] == cells[None, :, :]).any(2).sum()
    assert packed(found["rid"]) < packed(ordered["rid"]) / 3  # a list's ids come again and again


def test_groups_of_blocks_have_a_task_each(spark):
    rows, _ = strangers(spark, 5000, 4, 6)
    parts = C.pair_counts(rows, rows).groupBy(F.spark_partition_id().alias("part")).count().collect()
    pq, pr = blocks.list_parts(5000, spark.sparkContext.defaultParallelism)
    assert len(parts) == pq * pr > 2 and max(r["count"] for r in parts) < 2 * min(r["count"] for r in parts)


@pytest.mark.parametrize(("s", "bits"), [(8, 3), (64, 2), (100, 4), (6, 17), (130, 4)])
def test_lists_of_any_width(spark, monkeypatch, s, bits):
    rng = np.random.default_rng(s)
    cells = rng.integers(0, 1 << bits, (120, s))
    cells[40:70] = cells[rng.integers(0, 5, 30)]
    cells[70:, : s // 2] = cells[3, : s // 2]
    held = rng.random((120, s)) < 0.9  # the others are holes
    held[40:60] = held[40]
    rows = spark.createDataFrame([(i, [p << 32 | int(x) for p, x in enumerate(r) if held[i, p]]) for i, r in enumerate(cells)], "gid long, cells array<long>")
    n = ((cells[:, None, :] == cells[None, :, :]) & held[:, None, :] & held[None, :, :]).sum(2)
    want = {(int(a), int(b)): int(n[a, b]) for a, b in zip(*np.nonzero(n), strict=True)}
    for ids, hits in ((blocks.IDS, blocks.HITS), (50, 100)):
        monkeypatch.setattr(blocks, "IDS", ids)
        monkeypatch.setattr(blocks, "HITS", hits)
        assert got(C.pair_counts(rows, rows)) == want
        assert got(C.pair_counts(rows, rows, half=True)) == {k: v for k, v in want.items() if k[0] <= k[1]}
        few = rows.where("gid % 3 = 0")
        assert got(C.pair_counts(few, rows)) == {k: v for k, v in want.items() if k[0] % 3 == 0}


def test_masses_are_made_once_for_each_number_of_matches(spark, sf):
    plan = Q.QUERIES["n5_log_mass"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    logs = [i for i, x in enumerate(lines) if "ln(" in x.lower() or "log(" in x.lower()]
    joined = next(i for i, x in enumerate(lines) if "BroadcastHashJoin" in x)
    assert logs and joined < min(logs) and not any("FlatMapGroupsInArrow" in x for x in lines[min(logs) :])


@pytest.mark.parametrize(("m", "s"), [(32, 64), (16, 64), (10, 20), (52, 64), (4, 64), (1, 8), (8, 8), (3, 7)])
def test_key_sets_lose_no_pair(m, s):
    rng = np.random.default_rng(0)
    for n in (1e2, 1e4, 1e7):
        sets, _ = C.key_sets(m, s, 12, n * n / 2, n)
        every = itertools.combinations(range(s), m) if s <= 8 else (rng.choice(s, m, replace=False) for _ in range(300))
        has = np.zeros(s, bool)
        for match in every:
            has[:] = False
            has[list(match)] = True
            assert any(has[x].all() for x in sets)
    if (m, s) in ((32, 64), (16, 64), (10, 20)):
        assert min(map(len, sets)) >= 2  # no key of a single fingerprint for large tables


@pytest.mark.parametrize("how", ["keys", "pruned", "stored"])
def test_strangers_are_no_candidates(spark, folder, how):
    rows, cells = strangers(spark, 2000)
    want = {k: n for k, n in counts(cells[:3]).items() if n >= 32} | {(i, i): 64 for i in range(3, 2000)}
    if how == "keys":
        found = got(C.prefix_compare(rows, rows, 64, 0.5))
    elif how == "pruned":
        found = got(prune.pruned_compare(rows, rows, 64, 0.5))
    else:
        p = SketchParams(15, 6, 12)
        I.save(I.Index(I.chunked_postings(C.as_positions(rows)), p, 2000, 0), f"file://{folder}/index")
        index = I.load(spark, f"file://{folder}/index")
        found = got(I.compare_stored(index, index, 0.5))
    assert found == want
    assert written(spark, folder, "candidates") < 50


def test_documents_of_common_parts_are_no_candidates(spark, folder):
    cells = np.random.default_rng(3).integers(0, 4096, (400, 64))
    cells[:, :12] = 7  # all share a part, which is less than half
    cells[1, :40] = cells[0, :40]
    rows = spark.createDataFrame([(i, [p << 32 | int(x) for p, x in enumerate(r)]) for i, r in enumerate(cells)], "gid long, cells array<long>")
    assert got(C.prefix_compare(rows, rows, 64, 0.5)) == {k: n for k, n in counts(cells).items() if n >= 32}
    assert written(spark, folder, "candidates") < 400 * 399 / 2 / 10


def test_stored_lists_that_are_long_meet_in_blocks(spark, folder):
    rows, cells = strangers(spark, 300, 16, 3)
    I.save(I.Index(I.chunked_postings(C.as_positions(rows)), SketchParams(15, 4, 3), 300, 0), f"file://{folder}/index")
    index = I.load(spark, f"file://{folder}/index")
    assert got(I.compare_stored(index, index)) == counts(cells)
    assert written(spark, folder, "found") is None  # no table of all pairs


def test_few_queries_meet_in_blocks(spark, folder):
    rows, cells = strangers(spark, 3000)
    few = rows.where("gid < 5")
    assert got(C.compare(few, rows, 64, 0.05)) == {(a, b): n for a in range(5) for b in range(3000) if (n := int((cells[a] == cells[b]).sum())) >= 4}
    assert written(spark, folder, "keys") is None


def test_pruning_equals_the_fold_over_all_hits(spark):
    rows, cells = strangers(spark, 60, 64, 1)
    hits = [(a, b, p) for a in range(60) for b in range(60) for p in np.flatnonzero(cells[a] == cells[b]).tolist()]
    want = got(prune.pruned_counts(spark.createDataFrame(hits, "qid long, rid long, pos int"), 64, 0.5))
    assert got(prune.pruned_compare(rows, rows, 64, 0.5)) == want


@pytest.mark.parametrize(("s", "threshold", "cutoff"), [(64, 0.5, 0.001), (20, 0.3, 0.2), (7, 1.0, 0.001), (16, 0.25, 0.0)])
def test_many_folds_at_once_equal_the_expression(spark, s, threshold, cutoff):
    rng = np.random.default_rng(s)
    equal = rng.random((400, s)) < rng.random((400, 1))
    at = spark.createDataFrame([(i, np.flatnonzero(x).tolist()) for i, x in enumerate(equal)], "i int, at array<int>")
    want = [r[0] for r in at.orderBy("i").select(prune._fold(F.col("at"), s, threshold, cutoff)).collect()]
    fold = prune.folder(s, threshold, cutoff)
    assert fold(equal).tolist() == want == [int(fold(x[None])[0]) for x in equal] and len(set(want)) > 2


def test_pairs_are_folded_where_they_are_found(spark):
    rows, _ = strangers(spark, 200)
    plan = prune.pruned_compare(rows, rows, 64, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan
    found = C.near_pairs(rows, rows, 64, 32)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange (SinglePartition|hashpartitioning\(bucket#\d+, \d+\)), REPARTITION_BY_NUM", found)  # tasks of small rows and much work stay as they are


def test_digests_in_pieces():
    seqs = [None, "", "ACG", "ACGTNACGT--ACGGTTTAGC" * 9, "日本ACGTACGT", "T" * 40]
    for k, letters in ((1, 1), (5, 10), (15, 7), (31, 64), (5, 1 << 17)):
        n, xor = _digests(iter(seqs), k, len(seqs), letters)
        for i, s in enumerate(seqs):
            h = kmer_hashes(s, k)
            assert n[i] == len(h) and xor[i] == (np.bitwise_xor.reduce(h).view(np.int64) if len(h) else 0)


def test_sequence_files_are_written_by_several_tasks(spark, sf, folder):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = Q.QUERIES["s2_one_file_scan"](spark, sf).orderBy("gid").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(glob.glob(f"{folder}/query-*/part-*")) > 1
    assert [r["gid"] for r in rows] == list(range(len(rows))) and [r["name_id"] for r in rows] == sorted(r["name_id"] for r in rows)


def cluster(spark, n, share=0.8, seed=5):
    """Near copies of one document, and as many strangers."""
    rng = np.random.default_rng(seed)
    cells = rng.integers(0, 4096, (2 * n, 64))
    cells[:n] = np.where(rng.random((n, 64)) < share, cells[0], cells[:n])
    rows = [(i, [int(p) << 32 | int(x) for p, x in enumerate(r)]) for i, r in enumerate(cells)]
    return spark.createDataFrame(rows, "gid long, cells array<long>").repartition(4), cells


def test_pairs_of_a_dense_cluster_do_not_move(spark, folder):
    rows, cells = cluster(spark, 400)
    want = {k: n for k, n in counts(cells).items() if n >= 32}
    assert len(want) > 400 * 300
    assert got(C.prefix_compare(rows, rows, 64, 0.5)) == want
    assert written(spark, folder, "candidates") < 400 * 40  # documents and leaders; pairs were 400 * 399 / 2


@pytest.mark.parametrize("small", [False, True])
def test_groups_in_parts_lose_and_repeat_no_pair(spark, monkeypatch, small):
    if small:
        for name, value in (("KEY_ROWS", 500), ("HOT", 9), ("PART", 7), ("ROWS", 20), ("CELLS", 640), ("PAIRS", 11), ("SMALL", 5)):
            monkeypatch.setattr(groups, name, value)
    rows, cells = cluster(spark, 60, 0.75)
    want = counts(cells)
    near = C.near_pairs(rows, rows, 64, 32, True).collect()
    assert sorted((r["qid"], r["rid"], r["matches"]) for r in near) == sorted((*k, n) for k, n in want.items() if n >= 32 and k[0] < k[1])
    for r in near:
        at = np.flatnonzero(cells[r["qid"]] == cells[r["rid"]])
        assert r["both"] == [int(p) << 32 | int(cells[r["qid"], p]) for p in at]
    some, others = rows.where("gid % 3 = 0"), rows.where("gid % 2 = 0")  # two tables that have ids in common
    assert got(C.prefix_compare(some, others, 64, 0.5)) == {k: n for k, n in want.items() if n >= 32 and k[0] % 3 == 0 and k[1] % 2 == 0}


def test_a_dense_component_moves_no_pairs(spark, folder):
    pairs = [(a, b) for a in range(300) for b in range(a)] + [(1000 + a, 1001 + a) for a in range(50)]
    found = components(spark.createDataFrame(pairs, "a long, b long").repartition(4), "clique").collect()
    assert {r["node"]: r["component"] for r in found} == {i: 0 for i in range(300)} | {1000 + i: 1000 for i in range(51)}
    assert written(spark, folder, "clique") < 350 * 4 * 6  # some rounds; the pairs alone are 44,900


@pytest.mark.parametrize("least", [0.5])
def test_walks_by_cells_equal_walks_by_edges(spark, folder, monkeypatch, least):
    rows, cells = cluster(spark, 60, 0.8)
    copies = spark.createDataFrame([(500 + i, [int(p) << 32 | int(x) for p, x in enumerate(cells[i % 5])]) for i in range(20)], "gid long, cells array<long>")
    rows = work.cut(rows.unionByName(copies), "all")
    docs = rows.select("gid")
    order = lambda df: [r["old_gid"] for r in df.orderBy("new_gid").collect()]
    whole = order(reorder.greedy_order(docs, reorder.edges(C.compare_self(rows, 64, least), least)))
    c = work.cut(C.classes(rows), "kinds")
    reps = work.cut(C.representatives(rows, c), "reps")
    hits = C.compare_self(reps, 64, least)
    assert order(reorder.class_order(docs, c, hits, 64, least, most_edges=500, rows=reps)) == whole  # more edges than are walked in one task
    monkeypatch.setattr(reorder, "DENSE", 100)
    assert order(reorder.class_order(docs, c, hits, 64, least, rows=reps)) == whole and len(whole) == 140
    with pytest.raises(ValueError, match="edges and documents"):
        reorder.class_order(docs, c, hits, 64, least, most_edges=500)


def clusters(spark):
    """Near copies and copies, as ids lie in any order; documents with few cells or none."""
    rng = np.random.default_rng(8)
    cells = np.repeat(rng.integers(0, 1 << 12, (3, 64)), 20, 0)
    for i in range(60):
        cells[i, rng.permutation(64)[: i % 5 * 8]] = rng.integers(0, 1 << 12, i % 5 * 8)
    ids = rng.permutation(70)
    rows = [(int(ids[i]), [int(p) << 32 | int(x) for p, x in enumerate(r)]) for i, r in enumerate(cells)]
    rows += [(int(ids[60 + i]), [p << 32 | 5 for p in range(10)]) for i in range(4)]  # copies of too few cells for an edge
    docs = spark.createDataFrame([(int(i),) for i in ids], "gid long")
    return spark.createDataFrame(rows, "gid long, cells array<long>").repartition(4), docs


def test_weights_by_classes(spark, folder):
    rows, docs = clusters(spark)
    want = reorder.node_weights(docs, reorder.edges(C.compare_self(rows, 64, 0.5), 0.5))
    want, start = sorted(map(tuple, want.collect())), tuple(reorder.start_node(want).first())
    before = written(spark, folder, "found")
    assert before and len({w for _, w in want}) > 5
    c, found = C.class_pairs(rows, 64, 0.5)
    members = work.cut(reorder.class_members(c, 64, 0.5), "members")
    made = reorder.class_node_weights(docs, members, reorder.class_edges(found, 64, 0.5))
    assert sorted(map(tuple, made.collect())) == want and tuple(reorder.start_node(made).first()) == start
    assert written(spark, folder, "found") == before  # pairs are not written again


def test_best_neighbours_by_classes(spark, folder):
    rows, _ = clusters(spark)
    want = sorted(map(tuple, reorder.best_neighbours(reorder.edges(C.compare_self(rows, 64, 0.5), 0.5)).collect()))
    before = written(spark, folder, "found")
    c, found = C.class_pairs(rows, 64, 0.5)
    members = work.cut(reorder.class_members(c, 64, 0.5), "members")
    made = reorder.class_best_neighbours(members, reorder.class_edges(found, 64, 0.5))
    assert sorted(map(tuple, made.collect())) == want and len(want) > 20
    assert written(spark, folder, "found") == before


@pytest.mark.parametrize("most", (groups.BROADCAST, 0))
def test_representatives_with_few_and_many_copies(spark, folder, monkeypatch, most):
    monkeypatch.setattr(C, "BROADCAST", most)
    rows, _ = clusters(spark)
    c = work.cut(C.classes(rows), "classes")
    kept = {r["gid"] for r in C.representatives(rows, c).collect()}
    assert kept == {r["rep"] for r in c.collect()} and 0 < len(kept) < rows.count()


def test_o7_and_o8_write_no_pairs(spark, sf, folder):
    for name in ("o7_start_node", "o8_best_neighbour"):
        assert Q.QUERIES[name](spark, sf).count() > 0
    assert written(spark, folder, "found") is None
