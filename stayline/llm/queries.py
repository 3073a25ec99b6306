"""The registered queries opN_<name> of the numbered operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stayline.llm import (
    articles,
    backoff,
    decontaminate,
    language,
    lengths,
    licenses,
    mixing,
    quality,
    rules,
    runs,
    secrets,
    simhash,
    spelling,
)
from stayline.llm.common import table
from stayline.llm.oracle import ORACLE

__all__ = ["ORACLE", "REGISTRY"]

REGISTRY = {}


def registered(query):
    REGISTRY[query.__name__] = query
    return query


@registered
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@registered
def op2_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@registered
def op3_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.find_licenses(table(spark, folder, "documents"))


@registered
def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.predictions(table(spark, folder, "documents"))


@registered
def op5_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return lengths.length_report(table(spark, folder, "documents"))


@registered
def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(table(spark, folder, "documents"))


@registered
def op7_backoff(spark: SparkSession, folder: str) -> DataFrame:
    return backoff.score(table(spark, folder, "documents"))


@registered
def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


@registered
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.predictions(table(spark, folder, "documents"), table(spark, folder, "labels"))


@registered
def op10_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = rules.judged(table(spark, folder, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


@registered
def op11_articles(spark: SparkSession, folder: str) -> DataFrame:
    return articles.page_texts(table(spark, folder, "pages"))


@registered
def op12_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.digest(runs.periodic_runs(runs.planted(table(spark, folder, "documents"))))


@registered
def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, folder, "documents"), spelled=spelling.dropped_letter))
