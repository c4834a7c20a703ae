"""Corpus pipeline: quality rules, exact and near duplicates, secrets, packing; one Parquet table between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessiograph.llm._common import stored
from sessiograph.llm.exact_dedup import without_exact_duplicates
from sessiograph.llm.minhash_dedup import without_near_duplicates
from sessiograph.llm.packing import pack
from sessiograph.llm.quality_rules import passing
from sessiograph.llm.queries import tokenizer_path
from sessiograph.llm.secret_scan import redacted


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules, or their host's verdict, reject go."""
    return passing(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest id stays."""
    return without_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similarity 0.8 on runs of five words the least id stays."""
    return without_near_duplicates(docs, width=5)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed secrets are replaced in the text; every document stays."""
    return redacted(docs, length_col="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 4096 tokens."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", packing)]

#: Tokenizing cannot be said in SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
