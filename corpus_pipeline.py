"""Training-corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of documents; the last returns the encoded
corpus.  Every stage works on all rows that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from newsweave.llm import byte_bpe, decontaminate, grace_dedup, hamming_dedup, language_id
from newsweave.llm.common import table
from newsweave.session import checkpointed, use_utc

MIN_COSINE = 1e-6  # a text that is orthogonal to every language is rejected, as is one without letters


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Profiles learned from the labelled rows; texts in no known language go."""
    profiles = language_id.learn_profiles(docs)
    shadowed = {c: f"_{c}" for c in docs.columns if c in ("lang_pred", "score")}  # a column of such a name comes back as it was
    found = language_id.identify(docs.withColumnsRenamed(shadowed), profiles)
    return found.filter(language_id.is_accepted(MIN_COSINE)).drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in shadowed.items()}).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal after lowering A-Z, the row with the largest id stays."""
    return grace_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a shingle similarity of 0.85 or more, the one with the smallest id stays."""
    return hamming_dedup.drop_near_duplicates(docs)


def drop_benchmark_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies inside benchmark windows go."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and their decoding, as digests."""
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.encode_and_decode(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark_texts),
    ("byte_bpe", encode_tokens),
]

ORACLE_SQL = None  # learned profiles and BPE merges are beyond SQL; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(use_utc(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = checkpointed(stage(spark, docs, sf_dir), name)
    return docs
