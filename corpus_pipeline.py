"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage is a function (spark, docs, sf_dir) to a DataFrame; run() writes what a
stage returns as Parquet in the shared folder and gives the reread table to the
next. All stages but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.decontaminate import decontaminate
from eventide.llm.line_dedup import dedup_lines
from eventide.llm.ngram_join import ngram_components
from eventide.llm.packing import pack
from eventide.llm.quality import quality
from eventide.llm.storage import stage

#: Near duplicates here: shingles of five words, similarity of 80 % or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _keep_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["__id"]), "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    kept = quality(docs).where("kept").select(F.col("doc_id").alias("__id"))
    return _keep_rows(docs, kept)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines the first stays; documents left without a line with words go."""
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    found = ngram_components(docs, k=NEAR_WORDS, percent=NEAR_PERCENT)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id"))
    return _keep_rows(docs, kept)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the others the words shared with benchmark windows are cut out."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL cannot express MinHash banding, a trained byte-pair encoding or the packing order.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
