"""Registered queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podweave.llm import byte_bpe, embedding_dups, importance, language_mix, merkle, mixing, ngram_join, paragraph_dedup, personal_data, quality_rules, spelling, token_counts, tool_calls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents")).drop("removed_lines")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("copies")


def op4_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paragraph_dedup.paragraphs(_table(spark, sf_dir, "documents"))
    return paragraph_dedup.document_report(found)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), ranks)
    return coded.select("doc_id", *byte_bpe.digests())


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents")).drop("n_copies")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dups.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_mix.language_ids(_table(spark, sf_dir, "documents"))


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = tool_calls.link_calls(*tool_calls.conversation_calls(_table(spark, sf_dir, "conversations")))
    return linked.withColumn("problems", F.array_join("problems", ", "))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.report(personal_data.find(_table(spark, sf_dir, "documents")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(_table(spark, sf_dir, "documents"), slips=True))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_rules": op2_quality_rules,
    "op3_mixing": op3_mixing,
    "op4_paragraph_dedup": op4_paragraph_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_ngram_join": op6_ngram_join,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_embedding_dups": op8_embedding_dups,
    "op9_language_mix": op9_language_mix,
    "op10_tool_calls": op10_tool_calls,
    "op11_personal_data": op11_personal_data,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_merkle_manifest": op13_merkle_manifest,
}
