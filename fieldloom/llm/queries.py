"""Queries of this subpackage, with production parameters over the whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, importance, lm, minhash, oracles, packing, prefix_trie, quality_classifier, quality_rules, sharding, substring_dedup, suffix_dedup, token_output
from .common import documents

try:  # the vocabularies' folder is a parameter of the operators; this is the default of the queries
    import public_tokenizers

    vocabulary = public_tokenizers.path
except ImportError:
    vocabulary = "/opt/tokenizers/{}".format


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.packed_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), end_id=1, seq_len=2048)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), end_id=0)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), 8)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.93)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(documents(spark, sf_dir))
    return judged.withColumns({c: F.round(c, 9) for c in ("class_distance", "word_distance")})


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir), 400).withColumnRenamed("kept", "text")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), 0.8)


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=10, least_words=20, seed=2024)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(documents(spark, sf_dir), 35).drop("kept")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_packing": op3_packing,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_bpe": op5_bpe,
    "op6_minhash": op6_minhash,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_lm": op9_lm,
    "op10_token_output": op10_token_output,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_importance": op12_importance,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL: dict[str, str] = {
    "op6_minhash": oracles.NEAR_DUPLICATES,
    "op7_embedding_dedup": oracles.EMBEDDINGS,
    "op8_quality_rules": oracles.QUALITY_RULES,
    "op11_substring_dedup": oracles.SUBSTRINGS,
    "op12_importance": oracles.IMPORTANCE,
    "op13_prefix_trie": oracles.PREFIX_TRIE,
}
