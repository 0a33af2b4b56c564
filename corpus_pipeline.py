"""Corpus pipeline: language ID, line dedup, near-dedup, secret masking, packing; each stage is written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyseq.llm import language_id, line_dedup, minhash_dedup, packing, secret_ledger
from tallyseq.llm.common import read
from tallyseq.operators.common import shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; rejected ones (no letter, or far from every language) go."""
    return language_id.accepted(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without near-repeated lines; those that lose every line go."""
    columns = docs.columns
    aside = {c: f"{c}_of_the_table" for c in ("n_lines", "n_removed") if c in columns}
    thin = line_dedup.without_repeated_lines(docs.withColumnsRenamed(aside)).where("n_removed = 0 or n_removed < n_lines")
    thin = thin.drop(*aside).withColumnsRenamed({v: k for k, v in aside.items()})
    return thin.withColumn("n_chars", packing.chars("text")).select(*columns) if "n_chars" in columns else thin.select(*columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: a similarity of 0.8 or more on runs of five words (the 0.85 is that of operator 1's query)."""
    return minhash_dedup.deduplicated(docs, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every found secret masked."""
    return secret_ledger.masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in token-budget batches."""
    return packing.pack(docs)


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("minhash_dedup", dedup_documents), ("secret_ledger", mask_secrets), ("packing", pack)]
ORACLE_SQL = None  # trained models, MinHash and dynamic programming are not SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage writes goes to the session's shared folder.

    Null and empty texts have no language and go in the first stage; repeated rows and ties end in the near-duplicate stage, where one row of
    each doc_id stays (of null doc_ids all); very long texts are packed in pieces. Empty table: no rows. Further columns reach the last stage.
    """
    shared = shared_folder(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
