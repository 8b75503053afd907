"""The named queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm import bpe, exact_dedup, lang_id, line_dedup, merkle, mixing, oracles, quality, quality_rules, sharding, simhash, token_files, vector_dedup, whitening
from glyphlake.llm.common import documents, held_out, new_folder

SHARDS = 40
SHARD_SEED = 8


def op1_aligned_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.without_common_blocks(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_deleted_lines", "n_deleted_words", "earlier_ids", F.sha2("text", 256).alias("text_sha256"))


def op2_gated_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = lang_id.identified(docs.select("doc_id", "text"), docs)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_language").alias("lang_pred"), F.col("_sure").alias("score"))


def op3_random_index_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality.scored(documents(spark, sf_dir).select("doc_id", "text"), labels)
    predicted = (F.col("_score") >= quality.THRESHOLD).cast("int")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), predicted.alias("predicted"))


def op4_pivotal_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir))


def op5_digest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op6_context_mixing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "token-ids")
    token_files.write_ids(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), path)
    return token_files.read_ids(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleaved(documents(spark, sf_dir), SHARDS, SHARD_SEED)


def op9_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir))


def op11_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op13_merkle_climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    ways = merkle.proved(merkle.build(docs, present=found))
    return ways.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_aligned_blocks": op1_aligned_blocks,
    "op2_gated_byte_network": op2_gated_byte_network,
    "op3_random_index_quality": op3_random_index_quality,
    "op4_pivotal_mixture": op4_pivotal_mixture,
    "op5_digest_tree": op5_digest_tree,
    "op6_context_mixing_files": op6_context_mixing_files,
    "op7_quality_rules": op7_quality_rules,
    "op8_interleaved_shards": op8_interleaved_shards,
    "op9_word_table_bpe": op9_word_table_bpe,
    "op10_simhash_anchors": op10_simhash_anchors,
    "op11_rotated_codes": op11_rotated_codes,
    "op12_lanczos_whitening": op12_lanczos_whitening,
    "op13_merkle_climb": op13_merkle_climb,
}

ORACLES: dict[str, str] = {
    "op5_digest_tree": oracles.EXACT,
    "op7_quality_rules": oracles.RULES,
    "op8_interleaved_shards": oracles.shards(SHARDS, SHARD_SEED),
    "op13_merkle_climb": oracles.MERKLE,
}
