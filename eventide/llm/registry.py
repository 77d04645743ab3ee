"""Queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import oracles
from .decontaminate import digest_items, overlaps
from .html import extract_text
from .licenses import scan_licenses
from .line_dedup import line_classes
from .ngram_join import ngram_components
from .packing import pack
from .quality import quality
from .suffix_dedup import remove_repeats
from .toxicity import fit_toxicity, score_toxicity
from .urls import judge_urls


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_read(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directories of a document are its source and language."""
    return scan_licenses(_read(spark, sf_dir, "documents"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    return score_toxicity(documents, fit_toxicity(documents, _read(spark, sf_dir, "labels")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_read(spark, sf_dir, "documents")).drop("char_distance", "common_distance")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_read(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_read(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = line_classes(_read(spark, sf_dir, "documents"))
    return classes.selectExpr("id AS doc_id", "CAST(pos AS BIGINT) AS line_no", "class_id AS class_doc_id", "CAST(class_pos AS BIGINT) AS class_line_no", "kept")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_read(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_items(overlaps(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_license_scan": op2_license_scan,
        "op3_toxicity": op3_toxicity,
        "op4_quality_rules": op4_quality_rules,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_html_extraction": op6_html_extraction,
        "op7_line_dedup": op7_line_dedup,
        "op8_packing": op8_packing,
        "op9_url_filters": op9_url_filters,
        "op10_decontamination": op10_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard": oracles.NGRAMS,
        "op2_license_scan": oracles.LICENSES,
        "op4_quality_rules": oracles.QUALITY,
        "op9_url_filters": oracles.URLS,
        "op10_decontamination": oracles.DECONTAMINATION,
    }
