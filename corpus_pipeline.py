"""Corpus pipeline: quality rules, near-dedup, passage dedup,
decontamination and tokenisation, in that order, over ``documents``.

Every stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read back as the next stage's ``docs``. All but the last return
the columns of ``documents``. ``public_tokenizers`` names the model file of
the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moodgauge.llm import decontaminate, minhash, quality, sentencepiece_codec, suffix_dedup
from moodgauge.llm.common import read_table, written
from moodgauge.llm.queries import piece_model


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the default policy go."""
    return quality.keep_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the smallest doc_id stays."""
    return minhash.keep_one(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 50 words and more are cut out of all texts but
    the first; documents of which nothing is left go."""
    return suffix_dedup.cut_repeats(docs, length_col="n_chars")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def tokenisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text with the byte spans of their pieces."""
    out = sentencepiece_codec.encode_documents(docs, piece_model())
    return out.select("doc_id", "n_tokens", "ids", "offsets", "ids_sha256")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("decontamination", decontamination),
    ("tokenisation", tokenisation),
]

# passages, leaks and pieces are beyond SQL; the tests hold the stages
# against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
