"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .decontaminate import contaminated
from .line_dedup import dedup_lines
from .packing import pack
from .quality_rules import quality_rules
from .resample import resample
from .secrets import scan
from .simhash import near_components
from .suffix_dedup import without_repeats
from .tokens import count_tokens
from .warc import archived


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=1024)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(read_table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read_table(spark, sf_dir, "documents"), span=100)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its lines, how many go, and the digest of the text that stays."""
    done = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce("kept_text", F.lit(""))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(read_table(spark, sf_dir, "pages"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_token_counts": op2_token_counts,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_simhash_near_dedup": op4_simhash_near_dedup,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_suffix_array_dedup": op6_suffix_array_dedup,
        "op7_line_dedup": op7_line_dedup,
        "op8_warc": op8_warc,
        "op9_quality_rules": op9_quality_rules,
        "op10_benchmark_decontamination": op10_benchmark_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    from . import oracle

    return dict(oracle.SQL)
