import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans.queries import ORACLES, QUERIES

TABLES = "documents benchmark conversations".split()


def plain(rows):
    return sorted(repr(tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", ["f3_kmer_counts", "k4_bucket_min", "k9_whole_sketch", "k7_fp_perfect", "j3_ref_vs_query", "f7_threshold", "n6_pruned_pairs", "n12_sparse_lines", "o8_best_neighbour", "o9_order", "s1_fastx_scan", "s3_fof_scan"])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(df.select(*names).collect()) == plain(found.fetchall())


def test_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["qid", "rid", "matches", "score"]
    order = [r["old_gid"] for r in QUERIES["o9_order"](spark, "/root/testdata/sf0.001").collect()]
    assert sorted(order) == list(range(200))
