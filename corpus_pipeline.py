"""A corpus pipeline: quality classifier, n-gram Jaccard join, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir); all but the last return documents with the columns of docs, the
last one row per document of the token files.  A stage works on what its predecessor kept.

Defined cases, for every stage: null and empty texts are texts without words; very long texts are read whole;
rows with equal ids or texts are rows of their own where a stage does not say otherwise; empty tables give
empty tables; columns beyond doc_id, text and source are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from semlode.llm import decontaminate, jaccard, mixing, quality, tokens
from semlode.llm._shared import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; a score of exactly 0.5 is accepted, rows that repeat fare alike."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: five-word shingles, a coefficient of at least 80 %.

    That with the least id stays; documents without words or without an id stay.
    """
    return jaccard.keep_first(docs, k=5, num=80, den=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark; those without words are not."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, documents repeated as often as it takes them; null sources are one, the last."""
    return mixing.repeat_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id shards; per document its place in them, those without an id last."""
    return tokens.encode_and_read(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("token ids", token_stage),
]

#: The stages with a trained classifier, a seeded sample and a tokenizer have no SQL form; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{i}")
    return docs
