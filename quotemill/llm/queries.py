"""Queries of the training-text operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quotemill.llm import canonical_text, encoding_repair, leakage, product_match, shared_spans, tokenize_corpus

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_repair.garbled_items(table(spark, sf_dir, "quote_items"))


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_repair.repaired(table(spark, sf_dir, "quote_items"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_match.same_product(table(spark, sf_dir, "catalog_items"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_text.lookalike_items(table(spark, sf_dir, "quote_items"))


def p4_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_text.canonical_items(table(spark, sf_dir, "quote_items"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize_corpus.encode_documents(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_pairs(table(spark, sf_dir, "documents"))


def p8_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_share(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_restored": p1_restored,
        "p2_found": p2_found,
        "p4_found": p4_found,
        "p4_canonical": p4_canonical,
        "p6_ids": p6_ids,
        "p7_found": p7_found,
        "p7_overlaps": p7_overlaps,
        "p8_found": p8_found,
        "p8_shared": p8_shared,
    }


def oracle_sql() -> dict[str, str]:
    return {}
