"""From raw documents to packed training sequences, a written table between stages.

language: documents without a letter go; all others are given the nearest learned language and stay. jaccard: one document of each group of near
copies stays (five-word shingles, similarity 0.8). pii: personal data is masked in the text. mixture:
documents are repeated or dropped until sources have their target weights. packing: token pieces in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.functions.durable import new_path
from murmura.llm.jaccard import keep_one
from murmura.llm.language import keep_identified
from murmura.llm.mixture import mixed_documents
from murmura.llm.packing import pack_documents
from murmura.llm.pii import masked

#: Packing yields token ids, which SQL cannot make; tests hold every stage against a plain version.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return masked(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("jaccard", jaccard), ("pii", pii), ("mixture", mixture), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's table is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
