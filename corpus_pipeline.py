"""From raw documents to packed training sequences: five stages over the operators of ``watchfold.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchfold.llm import minhash, mixing, packing, pii, quality, queries
from watchfold.session import shared_dir


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; learned from the labels of the input folder."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, labels, threshold=0.3)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return minhash.keep_one(docs, width=5, similarity=80)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights select, in one epoch over 80 % of the words; the last of a source is cut."""
    return mixing.mixed_documents(docs, queries.mix_domain(), queries.mix_weights(), share=0.8, epochs=1)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of 4096 tokens."""
    return packing.pack(docs, window=4096)


STAGES = [("quality", good_documents), ("near_duplicates", one_of_each), ("pii", without_pii), ("mixing", mixed), ("packing", packed)]
# Learned scores, hashed signatures and tokenizers are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``; each stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
