"""Registered queries of this subpackage: each applies one operator to its whole table and derives the columns of its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatsieve.llm import bpe, counts, fingerprints, jaccard, lm, merkle, neardup, packing, pii, quality, records, repair, substrings
from chatsieve.llm.common import crc_of_id, staged
from chatsieve.llm.oracle import ORACLE_SQL  # noqa: F401 (part of what is registered)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = lm.score_texts(docs, *lm.trained(docs))
    return rows.select("doc_id", (crc_of_id("doc_id") % 7 == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_sequences(documents(spark, sf_dir), end_id=1, size=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(documents(spark, sf_dir)).select("doc_id", "text")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.bpe_encode(documents(spark, sf_dir)).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), "ids")
    return bpe.bpe_decode(coded).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_quality(documents(spark, sf_dir), quality.learnable(labels))
    rows = quality.score_quality(documents(spark, sf_dir), model)
    return rows.select("doc_id", (crc_of_id("doc_id") % 5 == 0).alias("held_out"), "score", "predicted")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir), n=4, percent=85)


def op9_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = records.write_records(documents(spark, sf_dir), end_id=0)
    rows = records.read_records(index).join(F.broadcast(records.file_starts(index)), "part")
    return rows.select("doc_id", (F.col("base") + F.col("start_in_file")).alias("start"),
                       F.expr("cast(octet_length(ids) / 4 as long)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.fingerprint_pairs(documents(spark, sf_dir))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                       "near_edited", "near_next")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir), k=20).drop("spans")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(crc_of_id("doc_id") % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = merkle.manifest(documents(spark, sf_dir), claims={"text": tampered}).withColumn("folded_root", merkle.folded(F.col("proof"), F.col("claimed")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))


def repaired_conversations(given: DataFrame, chunk_rows: int = 1024) -> DataFrame:
    rows = repair.damaged(given)
    audits = staged(repair.diagnosed(rows, given, chunk_rows))
    digests = repair.repaired_digests(rows, audits).withColumnRenamed("conv_id", "_conv")
    return audits.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dup": op1_embedding_near_dup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_packing": op3_packing,
    "op4_surrogates": op4_surrogates,
    "op5_bpe": op5_bpe,
    "op6_token_counts": op6_token_counts,
    "op7_quality": op7_quality,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_binary_records": op9_binary_records,
    "op10_fingerprints": op10_fingerprints,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_conversation_repair": op13_conversation_repair,
}
