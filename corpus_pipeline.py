"""A corpus pipeline over ``documents``: languages, near copies, repeated passages, source mix, token ids.

Each stage is one operator of ``citegrain.llm``, takes (spark, docs, sf_dir) and works on all that the one before it
kept. Stages hand on tables with the columns of ``documents``; the last one returns the ids of each document of the
mix, as often as the mix takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers
from citegrain.llm import byte_bpe, jaccard_join, language_filters, mixing, suffix_dedup
from citegrain.llm.common import read_table, stored
from citegrain.llm.queries import BYTE_RANKS


def one_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one determined language, by filters learned from the labelled documents."""
    return language_filters.kept(docs, language_filters.learn(docs, F.lit(True)))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.one_of_each_group(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that are found elsewhere too; documents left without text go."""
    cleaned = suffix_dedup.cleaned(docs).where(F.col("text").isNull() | (F.col("text") != ""))
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of the sources take them."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the digests of ids and decoded bytes of each document of the mix."""
    return byte_bpe.round_trip(docs, BYTE_RANKS, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language", one_language),
    ("near_copies", without_near_copies),
    ("repeated_passages", without_repeated_passages),
    ("mixing", mixed_sources),
    ("token_ids", encoded),
]

# Fingerprints, samples and byte-pair merges are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each stored as Parquet and read again by the next one."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
