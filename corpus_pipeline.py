"""From raw documents to mixed, clean token ids: each stage takes what its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Rows
without an id, without a text or repeated pass as the operators' docstrings say.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from engram.llm import byte_bpe, mixing, secret_scan, simhash_dedup, toxicity
from engram.llm.common import table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return simhash_dedup.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text gives way to a mark; n_chars follows."""
    return secret_scan.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the hash of the bytes that they decode to."""
    return byte_bpe.encode(docs, with_ids=True).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", toxicity_stage), ("simhash_dedup", simhash_stage), ("secret_scan", secrets_stage), ("mixing", mixing_stage), ("byte_bpe", bpe_stage)]

#: The toxicity models, SimHash's components and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
