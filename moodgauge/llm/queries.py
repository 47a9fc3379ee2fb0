"""Registered queries: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodgauge.llm import (alignment, decontaminate, language, minhash, preference, quality, sentencepiece_codec,
                           sharding, suffix_dedup, token_counts, url_filter, vector_codes, warc)
from moodgauge.llm.common import read_table

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def put(fn):
        QUERIES[name] = fn
        return fn
    return put


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality.ledger(read_table(spark, sf_dir, "documents"))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      (~quality.passes("base")).alias("base_failed"),
                      quality.passes(quality.DEFAULT_POLICY).alias("kept"), "fail_bits")


@query("op10_minhash_near_dedup")
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query("op9_suffix_array_dedup")
def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.passages(read_table(spark, sf_dir, "documents"))
    words = F.aggregate("passages", F.lit(0).cast("long"), lambda n, p: n + p["hi"] - p["lo"])
    return found.select("doc_id", F.size("passages").cast("long").alias("n_passages"),
                        words.alias("n_repeated_words"), "passages", "cut")


def piece_model() -> str:
    """Place of the public tokenizer's model file on the driver."""
    import public_tokenizers
    return public_tokenizers.path(PIECE_MODEL)


@query("op7_sentencepiece_codec")
def op7_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(read_table(spark, sf_dir, "documents"), piece_model(), pieces=False)


@query("op4_sharding")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.write_shards(read_table(spark, sf_dir, "documents"))
    return rows.select(F.col("record.doc_id").alias("doc_id"), "size",
                       F.crc32(F.coalesce("record.text", F.lit("")).cast("binary")).alias("text_crc32"),
                       F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op5_warc")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(read_table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_benchmark_decontamination")
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    known = docs.where("lang is not null and doc_id is not null").where(~held)
    out = language.identify(docs, known)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), piece_model())


@query("op1_url_filter")
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    # a page's URL ends with the number of the document it shows
    number = F.regexp_extract(url_filter.path(F.col("url")), r"^/[^/]*/(\d{1,18})(\D|$)", 1)
    shown = pages.select("url", F.when(number != "", number).cast("long").alias("doc_id"))
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labelled = shown.join(read_table(spark, sf_dir, "labels"), "doc_id").select("url", bad.cast("int").alias("label"))
    return url_filter.judge(pages, url_filter.UrlModel(labelled))


@query("op11_quality_ranking")
def op11_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    out = preference.rank_quality(docs, labels.where(~held))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op12_vector_codes")
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read_table(spark, sf_dir, "embeddings"))


def byte_model() -> str:
    """Place of the public byte-level tokenizer's file on the driver."""
    import public_tokenizers
    return public_tokenizers.path(BYTE_MODEL)


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.token_links(read_table(spark, sf_dir, "documents"), byte_model(), piece_model())
