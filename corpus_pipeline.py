"""A corpus from raw documents to token ids, in five stages. Each reads what the one before has written."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm.byte_bpe import digest_documents, multi_model
from tidegrid.llm.decontamination import drop_contaminated
from tidegrid.llm.jaccard_join import keep_first
from tidegrid.llm.pii import DEMO_KEY, pseudonymise
from tidegrid.llm.quality_rules import keep_good
from tidegrid.llm.token_count import read_model
from tidegrid.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return keep_good(docs, read_model(public_tokenizers.path("piece_bpe_32k.model")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a shingle similarity of 0.75 or more, the one of the smallest doc_id."""
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced."""
    return pseudonymise(docs, DEMO_KEY)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of each document's ids and of what they decode to."""
    return digest_documents(docs, multi_model(), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("pseudonyms", pseudonyms), ("token_ids", token_ids)]
#: Neither tokenisers, components nor permutations under a key can be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
