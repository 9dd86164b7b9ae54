"""A training corpus from `documents`: five stages, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. A null text is no document of
quality and goes with the first stage; rows without doc_id pass all stages, except that they never count as copies;
extra columns travel along up to the last stage; an empty table stays empty.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podweave.llm import byte_bpe, importance, mixing, ngram_join, paragraph_dedup
from podweave.llm.landing import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling towards the labelled good ones keeps."""
    return importance.classified(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles overlap by 80 %: the one of the smallest doc_id."""
    return ngram_join.one_of_each(docs, width=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the paragraphs and passages that an earlier document has; what is empty then goes."""
    return paragraph_dedup.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the proportions of the sources' weights, each as many times as the mix takes it."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, ids_sha256, decoded_sha256 of every row."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.round_trip(docs.select("doc_id", "source", "text"), ranks)
    return coded.select("doc_id", "source", "ids", *byte_bpe.digests())


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]

#: SQL expresses neither the classifier's hashed models nor the merges; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{shared_folder(spark)}/podweave-llm/{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
