"""A corpus pipeline over ``documents``: each stage's rows are written and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from duebook.llm import language_id, packing, quality_rules, simhash, suffix_dedup
from duebook.session import write_and_read

#: Fifty words of five letters with their blanks and some room: passages of over 50 words are longer.
REPEAT_BYTES = 256


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages, as told by a classifier trained on this stage's own input."""
    return language_id.keep(docs, least_score=0.5)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id."""
    return simhash.keep_one(docs, words_in_shingle=3, most=2)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of ``REPEAT_BYTES`` bytes that start anywhere else too."""
    return suffix_dedup.strip_repeats(docs, length=REPEAT_BYTES)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    cut = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, longest=2048)
    return packing.pack(cut, 2048)


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("simhash_near_duplicates", simhash_stage),
    ("suffix_array_dedup", suffix_stage),
    ("best_fit_packing", packing_stage),
]

#: Hashing, a trained classifier and packing can't be said in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_and_read(stage(spark, docs, sf_dir), name)
    return docs
