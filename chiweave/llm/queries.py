"""One query per training-data operator over its whole table, and the SQL that DuckDB
can run to the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch
from .fingerprints import fingerprints
from .html_extraction import extract
from .language_id import language_id
from .mixing import mix
from .near_duplicates import ngram_join
from .packing import pack
from .quality import quality_rules
from .sharding import shard
from .token_files import read_places, write_token_files
from .toxicity import toxicity

BPE = public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.documents.drop("key")


def op2_quartile_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_read(spark, sf_dir, "documents"))


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_read(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), BPE, keep_ids=False)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "documents"))


def op8_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate")


def op9_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = scratch(spark, "token-files")
    return read_places(write_token_files(_read(spark, sf_dir, "documents"), uri, BPE), uri)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_quartile_fingerprints, op3_html_main_text, op4_best_fit_packing, op5_quality_rules, op6_toxicity, op7_language_id, op8_entropy_mixing, op9_histogram_sharding, op10_token_files)}
ORACLE_SQL: dict[str, str] = {}
