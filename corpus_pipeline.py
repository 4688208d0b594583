"""From documents to packed sequences: quality rules, near-duplicates, secrets, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caregauge.llm import packing, quality, secret_scan, simhash
from caregauge.llm.common import sends_package, shared_folder, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@sends_package
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; rows, columns and texts stay as they are."""
    forest = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality.passes(F.col("text"), forest))


@sends_package
def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near-duplicates."""
    return simhash.one_of_each(docs)


@sends_package
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in a text replaced by its kind; ``n_chars`` follows the text."""
    masked = docs.withColumn("text", secret_scan.masked(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kind)))
    return masked


@sends_package
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in a sequence of at most 2048 tokens."""
    return packing.pack(docs, TOKENIZER, capacity=2048, end_id=0)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: The forest, the fingerprints and the tokenizer have no SQL; tests hold the stages against
#: brute force.
ORACLE_SQL = None


@sends_package
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        folder = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    folder = shared_folder(spark)
    STAGES[-1][1](spark, docs, sf_dir).write.parquet(folder)
    return spark.read.parquet(folder)
