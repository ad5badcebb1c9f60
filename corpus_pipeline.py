"""A corpus pipeline: quality, boilerplate lines, near duplicates, mixing and packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; of no rows it makes none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import catalogue, packing, stages
from tessera.llm.runtime import prepare, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; an empty or null text is judged as an empty text, repeated rows alike."""
    return stages.keep_quality(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go; every row stays, with a null text as it is."""
    return stages.without_boilerplate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: shingles of five words, similarity of 0.8 or more.

    Of repeated rows one stays; documents without words, and those without doc_id, are linked with nothing and stay.
    """
    return stages.one_of_each(docs, width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken 0, 1 or 2 times, so that sources come to their target weights.

    Documents without words are not taken; repeated rows are taken each on their own.
    """
    return stages.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids; a null or empty text is its end id, repeated rows are packed each."""
    return packing.pack(docs, catalogue.vocabulary())


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", pack)]

# Training a network and tokenizing are not SQL; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
