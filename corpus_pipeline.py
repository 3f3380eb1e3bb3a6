"""The corpus pipeline: five stages from documents to encoded documents, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vocspark.llm import bpe, minhash, mixing, quality, toxicity
from vocspark.llm.common import fresh_folder, table

STAGES = [
    ("quality_rules", quality.stage),
    ("toxicity", toxicity.stage),
    ("minhash_near_dedup", minhash.stage),
    ("mix_sources", mixing.stage),
    ("bpe_round_trip", bpe.stage),
]

# Toxicity, and the ids of the byte-pair encoder, cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage works on what the one before it kept."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        path = fresh_folder(spark, name)
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
