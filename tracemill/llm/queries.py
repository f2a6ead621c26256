"""The queries of the problems on text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import bpe, consensus, mixture, pairs, sentences, truncation
from tracemill.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.found(table(spark, sf_dir, "results"), table(spark, sf_dir, "cases"))


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, cases = table(spark, sf_dir, "results"), table(spark, sf_dir, "cases")
    return truncation.shares(results, cases, truncation.found(results, cases))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.found(table(spark, sf_dir, "results"), table(spark, sf_dir, "cases"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.consensus(table(spark, sf_dir, "audit_labels")).where("consensus").select("audit_id")


def p3_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.consensus(table(spark, sf_dir, "audit_labels"))


def p3_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.reliability(table(spark, sf_dir, "audit_labels"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(mixture.sized(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.shares(mixture.sized(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_shares, p2_found, p3_found, p3_items, p3_annotators, p6_ids, p7_mix, p7_shares, p8_found)}
ORACLE: dict[str, str] = {}
