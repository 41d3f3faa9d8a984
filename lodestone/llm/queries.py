"""The queries of this subpackage over the tables of a folder, and their SQL where it can be written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_scan, line_dedup, mixing, oracles
from ._common import Scratch, read
from .embedding_dedup import near_vectors
from .minhash_dedup import near_duplicates
from .packing import pack
from .quality_rules import quality
from .substring_dedup import dedup_word_windows
from .suffix_array_dedup import dedup_byte_windows
from .toxicity import toxicity


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.size_and_quality(read(spark, sf_dir, "documents"))
    scratch = Scratch(spark)
    sized = scratch.keep(docs.select("doc_id", "source", "size", "quality"))
    mixed = mixing.apply_mix(sized, mixing.plan_mix(sized, (5, 2, 1), 3, scratch))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=2, percent=80)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"), threshold=0.93)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality(read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_word_windows(read(spark, sf_dir, "documents"), length=35)
    return kept.select("doc_id", F.col("n_tokens").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_byte_windows(read(spark, sf_dir, "documents"), length=50)
    return kept.select("doc_id", F.col("n_tokens").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), window=4096)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_mixing, op2_minhash_dedup, op3_line_dedup, op4_toxicity, op5_embedding_dedup,
        op6_license_scan,
        op7_quality_rules, op8_substring_dedup, op9_suffix_array_dedup, op10_packing,
    )
    return {q.__name__: q for q in every}


def oracle_sql() -> dict[str, str]:
    """Operators 4, 6 and 10 have no SQL form; 9 is too slow in SQL on whole tables."""
    return {
        "op1_mixing": mixing.ORACLE_SQL,
        "op2_minhash_dedup": oracles.MINHASH_DEDUP,
        "op3_line_dedup": line_dedup.ORACLE_SQL,
        "op5_embedding_dedup": oracles.EMBEDDING_DEDUP,
        "op7_quality_rules": oracles.QUALITY_RULES,
        "op8_substring_dedup": oracles.SUBSTRING_DEDUP,
    }
