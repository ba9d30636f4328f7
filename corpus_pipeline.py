"""From raw documents to training tokens: quality filter, exact and near deduplication, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet and read
again as the next one's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kozue.llm import bpe, exactdedup, minhash, mixing, quality
from kozue.llm.common import deleted, shared_folder

WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 0.5}
BUDGET_FRACTION = 0.8


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exactdedup.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs, WEIGHTS, budget_fraction=BUDGET_FRACTION, counter=bpe.counted)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("minhash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("bpe encoding and decoding", encode),
]

#: SQL can express neither the classifier nor the encoder; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. A stage's table is written to the shared folder, and deleted when the next one's has
    been; the last one, which the result is read from, when the driver ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if k:
            deleted(spark, f"{at}/{k - 1}")
    deleted(spark, at, at_end=True)
    return STAGES[-1][1](spark, docs, sf_dir)
