"""The registered queries of this subpackage: one ``opN_<name>`` for each operator, thin digests of their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, chat, decontam, extract, lblm, linededup, mixing, neardup, pii, toxicity
from .common import crc_rest, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bm25.search(docs, docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("id"), "text"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.digest(extract.main_text(table(spark, sf_dir, "pages")))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lblm.scores(table(spark, sf_dir, "documents"), crc_rest("doc_id", 7) == 2)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.formatted(rows.unionByName(more)))


#: The key of the query's pseudonyms is a secret of the session; without one the tables are taken to be a demonstration.
KEY_SETTING, DEMONSTRATION = "spark.reelcheck.pseudonyms.key", "demonstration"


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(KEY_SETTING, DEMONSTRATION))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_mix_sources": op2_mix_sources,
    "op3_line_dedup": op3_line_dedup,
    "op4_search": op4_search,
    "op5_decontaminate": op5_decontaminate,
    "op6_main_text": op6_main_text,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_lm_scores": op8_lm_scores,
    "op9_chat_format": op9_chat_format,
    "op10_pseudonyms": op10_pseudonyms,
}

ORACLES: dict[str, str] = {
    "op2_mix_sources": mixing.SQL,
    "op3_line_dedup": linededup.SQL,
}
