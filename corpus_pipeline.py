"""A document pipeline of the training-data operators; each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm import compression, exact_dedup, minhash, packing, secrets
from cairnlake.session import durable, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score of the model learnt from the labels of folds 0 and 2 reaches 0.7 go."""
    labels = table(spark, sf_dir, "labels").where(compression.fold(F.col("doc_id"), 3) != 1)
    return compression.drop_toxic(docs, compression.learn_toxicity(docs, labels))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words and a similarity of 0.8 stays."""
    return minhash.drop_near_duplicates(docs)


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text."""
    clean = secrets.redact_secrets(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in clean.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their bins of 2048 words."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("MinHash near-dedup", near), ("secret scans", secret), ("best-fit packing", packing_stage)]

#: SQL can express neither the classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
