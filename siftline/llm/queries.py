"""The registered queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation_trie, decontamination, language_id, line_dedup, quality_rules, sharding, simhash, source_divergence, sql, substring_dedup, tree_weighting, url_reputation
from .jaccard_join import jaccard_components
from .tables import crc_remainder, read

BPE_FILE = "word_bpe_49k.json"


def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"), 8)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), "3/4", 5)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc_remainder("doc_id", 4) == 2, F.lit(False)))
    model = language_id.fit(docs.where("not held_out").select(F.col("doc_id").alias("key"), "text", "lang"))
    return language_id.identify(docs, model, ["doc_id", "held_out"])


def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge(read(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), 10)


def op6_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc_remainder("doc_id", 7) == 2, F.lit(False)))
    return tree_weighting.score(docs)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(read(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(read(spark, sf_dir, "documents"), 35, 20)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    rebuilt = conversation_trie.with_shared_openings(conversations, 20, 4)
    return conversation_trie.report(conversation_trie.prefix_trie(rebuilt, conversations.select("conv_id")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(read(spark, sf_dir, "documents"), 30, 50)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), 2, 3, 42)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kd_sharding": op1_kd_sharding,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_language_id": op3_language_id,
    "op4_url_reputation": op4_url_reputation,
    "op5_decontamination": op5_decontamination,
    "op6_tree_weighting": op6_tree_weighting,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_bpe": op9_bpe,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_source_divergence": op12_source_divergence,
    "op13_simhash": op13_simhash,
}
ORACLES: dict[str, str] = {
    "op2_jaccard_join": sql.OP2,
    "op5_decontamination": sql.OP5,
    "op7_line_dedup": sql.OP7,
    "op10_substring_dedup": sql.OP10,
    "op11_conversation_trie": sql.OP11,
    "op12_source_divergence": sql.OP12,
}
