"""A training corpus in five stages: quality, language, near-duplicates, benchmark decontamination, mixing.

Each stage judges every row that its predecessor kept by the row's own columns. Rows are told apart by all their columns, so null,
repeated and clashing doc_ids lose nothing; columns beyond those of documents stay. Empty documents give an empty corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.llm import decontam, langid, mixing, quality, simhash
from folio.llm.common import stash


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A null text counts as empty; equal texts go or stay together. With fewer than two grades among the labels nothing goes.
    """
    return quality.good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: those without letters (null and empty ones), and those told with too little probability.

    Without any language to learn, all go.
    """
    return langid.known_language(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the smallest doc_id, a null one last; of rows equal in all columns, one.

    Texts without words (null and empty ones) have fingerprint zero, so they are a group, of which one stays.
    """
    return simhash.dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark text go, each row by its own text. An empty benchmark removes nothing."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each piece of text that a slot takes, repeats included; a document of which nothing is taken keeps a row without text."""
    return mixing.mixed(docs)


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_dedup", near_dedup_stage), ("decontamination", decontamination_stage), ("mixing", mixing_stage)]

#: The classifiers' stages can't be told in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
