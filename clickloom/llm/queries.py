"""Registered queries of the training-data operators and their DuckDB oracles.

Every query applies its operator, with its production parameters, to whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from clickloom.llm import conversation_repair, decontam, hard_negatives, kneser_ney, langid, mixing, neardup, oracle, quality, sharding, substring, token_counts, token_files, topk
from clickloom.llm.common import fold, table


def op1_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_odd_sketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 3) == 1)


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.lm_scores(table(spark, sf_dir, "documents"), fold("doc_id", 7) == 2)


def op5_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op6_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_word_backoff_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), fold("doc_id", 4) == 2)


def op8_arrow_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_documents(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_simhash_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op11_heap_bpe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op12_angular_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved).drop("positive_rank")


def op13_ida_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(table(spark, sf_dir, "conversations"))


SPARK = {f.__name__: f for f in (op1_block_topk, op2_odd_sketch_neardup, op3_pairwise_quality, op4_kneser_ney, op5_stratified_shards, op6_pareto_mix,
                                 op7_word_backoff_lang, op8_arrow_tokens, op9_simhash_decontaminate, op10_suffix_automata, op11_heap_bpe_counts, op12_angular_hard_negatives,
                                 op13_ida_conversation_repair)}
SPARK["pipeline"] = corpus_pipeline.run
SQL: dict[str, str] = {"op1_block_topk": oracle.TOPK, "op6_pareto_mix": oracle.MIX, "op12_angular_hard_negatives": oracle.HARD_NEGATIVES}
