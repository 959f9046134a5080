"""A corpus pipeline from five of the operators. Each stage's result is written and read again by its runner.

All stages take documents with columns of any names beside doc_id, text and source; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import cut, read_table
from tessera.llm.decontaminate import decontaminated
from tessera.llm.mixing import mixed_documents
from tessera.llm.near_dup import deduplicated
from tessera.llm.quality import good_documents
from tessera.llm.tokens import tokenized


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject stay. A null text is judged as an empty one; repeated rows stay or go together."""
    return good_documents(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more) stays: the one of least id.

    Null, empty and blank texts are duplicates of nothing; rows without id stay; of rows that repeat an id, one stays.
    """
    return deduplicated(docs, words=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark stay. Null and empty texts hold none; of rows that repeat an id, each is judged by its own text."""
    return decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a document taken twice has two rows. Null texts have no words and go; a null source is one of its own; repeated rows are taken alike."""
    return mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all that is left, and what reading them back gives. A null text has the end id alone; rows without id come first; repeated rows are all written."""
    return tokenized(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_files", token_files),
]

#: No SQL expresses the model of the first stage, the shingle hashes or the tokenizer; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
