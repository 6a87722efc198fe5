"""A corpus pipeline of five stages; each works on all that the one before kept.

Language ID keeps documents whose language can be told; the Jaccard join (five words, similarity 0.8) keeps the smallest
doc_id of each group; decontamination drops documents that hold a benchmark window; mixing repeats and cuts sources
towards their target weights; token output writes Simple-8b shards and returns a digest row a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievewright.llm import decontaminate, jaccard, langid, mixing, tokenids
from sievewright.llm.shared import discard, stored

VOCABULARY = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenids.read(tokenids.written(docs, VOCABULARY))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix),
    ("token-ID output", token_ids),
]

#: No stage but decontamination can be said in SQL over whole tables; tests/llm/test_pipeline.py holds every stage against
#: plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables: list[DataFrame] = []
    for name, stage in STAGES:
        tables.append(stored(stage(spark, tables[-1] if tables else docs, sf_dir), f"stage-{name.replace(' ', '-')}"))
        discard(*tables[:-1][-1:])
    return tables[-1]
