"""The operators applied to whole tables with production parameters."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelantern.llm import (
    bayes_minhash,
    context_mixing,
    divergence_audit,
    language_id,
    multi_index,
    permutation_index,
    pfair,
    prefix_trie,
    recompression,
    sentencepieces,
    splitters,
    suffix_dedup,
    token_transducer,
)

#: Target shares of sources; every other source has weight 1.
MIX_WEIGHTS = {"src0": 5, "src1": 3, "src2": 2}
MIX_BLOCK_DOCS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return permutation_index.nearest(rows, rows.where("vec_id % 50 = 0"), k=5)


def op5_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_transducer.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.scored(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = pfair.mixed(table(spark, sf_dir, "documents").select("doc_id", "source"), MIX_WEIGHTS, 1, MIX_BLOCK_DOCS)
    return pfair.in_slot_order(mix)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recompression.without_repeats(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_removed", digest.alias("kept_sha256"))


def op8_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayes_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitters.shard(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit.divergences(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_token_counts": op2_token_counts,
    "op3_context_mixing": op3_context_mixing,
    "op4_mix_sources": op4_mix_sources,
    "op5_embedding_near_duplicates": op5_embedding_near_duplicates,
    "op6_language_id": op6_language_id,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_sentencepieces": op8_sentencepieces,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_shards": op10_shards,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_divergence_audit": op13_divergence_audit,
}
