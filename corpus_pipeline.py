"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread as the next one's input.

toxicity            documents that score as toxic go
line_dedup          later copies of repeated line runs of 50 words or more are deleted from the texts; what is left empty by that goes
near_duplicates     one document of each group of near-duplicates stays (5-word shingles, similarity 0.8 or more)
decontamination     documents with a 10-word window of a benchmark item go
mixing              every document that is left, with the words that the mix takes of it

Every stage judges rows by their own text, so rows that share an id, or have none, stay or go one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelcheck.llm import decontam, linededup, mixing, neardup, toxicity
from reelcheck.llm.common import keep, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.clean(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.clean(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: Toxicity scores, near-duplicate components and window matches are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
