"""The corpus pipeline: documents of good quality, one of each group of near copies, without personal data, packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatsieve.llm import jaccard, packing, pii, quality
from chatsieve.llm.common import staged


def _short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """So many texts reach a Python worker at once, at most: the workers of all stages share an executor's memory, and texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject (score 0.3 or more)."""
    _short_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_quality(docs, quality.learnable(labels))
    return docs.where(quality.quality_score(model, F.col("text")) >= 0.3)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingles of five words link at a similarity of 0.8 or more."""
    _short_batches(spark)
    return jaccard.keep_one_of_each(docs, n=5, percent=80)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates in place of personal data and secrets."""
    _short_batches(spark)
    return pii.replace_entities(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 ids."""
    _short_batches(spark)
    pieces = packing.pack_sequences(docs, kept_pieces=400_000)  # as other stages have left their share in the workers
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality classifier", quality_classifier), ("n-gram Jaccard join", near_copies), ("PII", private_data), ("packing", packed)]

#: Neither the classifier nor the tokenizer can be written in SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
