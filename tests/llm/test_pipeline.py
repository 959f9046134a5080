"""The pipeline's stages on their own inputs: near_dedup and token_files against plain versions, decontaminate and mix_sources against the operators' SQL, quality against the scores of its operator."""

import collections
import zlib

import corpus_pipeline
import duckdb
import numpy as np
from pyspark.sql import functions as F
from tessera.llm import quality, tokens
from tessera.llm.common import cut
from tessera.llm.registry import ORACLES


def sql_rows(query, given, sf, folder, columns):
    """The named columns of an operator's SQL over a stage's input."""
    given.toPandas().to_parquet(folder / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf}/benchmark.parquet'")
    found = con.execute(ORACLES[query])
    names = [d[0] for d in found.description]
    return [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]


def test_stages(spark, sf, tmp_path):
    from test_operators import brute_components
    from tokenizers import Tokenizer

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix_sources", "token_files"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.select("doc_id", "text").collect()
        texts = {r["doc_id"]: r["text"] for r in before}
        given, docs = docs, cut(stage(spark, docs, sf), f"test-{name}")
        if name == "token_files":
            plain, ids = Tokenizer.from_file(tokens.vocabulary_path()), {}
            for d, t in texts.items():
                ids[d] = [*plain.encode(t or "", add_special_tokens=False).ids, tokens.END_ID]
            start = 0
            for r, d in zip(docs.orderBy("start").collect(), sorted(r["doc_id"] for r in before), strict=True):
                assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, start, len(ids[d]), zlib.crc32(np.array(ids[d], "<u4").tobytes()))
                start += len(ids[d])
            break
        assert docs.columns == columns
        after = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(after) <= set(texts) and after
        if name == "quality":
            scored = quality.score_quality(given, quality.learn_quality(given, spark.read.parquet(f"{sf}/labels.parquet")))
            assert sorted(after) == sorted(r["doc_id"] for r in scored.where("predicted = 1").collect())
        if name == "near_dedup":
            assert sorted(after) == sorted(set(brute_components(list(texts.items()), 5).values()))
        if name == "decontaminate":
            assert set(after) == set(texts) - {d for (d,) in sql_rows("op7_decontamination", given, sf, tmp_path, ["doc_id"])}
        if name == "mix_sources":
            assert collections.Counter(after) == {d: n for d, n in sql_rows("op10_mixing", given, sf, tmp_path, ["doc_id", "copies"]) if n}


def test_stages_on_empty_tables_and_clashing_columns(spark, sf):
    from test_operators import CLASHES

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("*", *[F.lit(i).alias(n) for i, n in enumerate(CLASHES)])
    odd = docs.limit(3).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), *[F.col(f"`{c}`") for c in docs.columns[2:]])
    docs = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        docs = cut(stage(spark, docs, sf), f"test-{name}")
        assert docs.count() > 0 and (name == "token_files" or docs.columns[5:] == CLASHES), name
