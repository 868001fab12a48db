"""Queries of the training-data operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, langid, lexical, minhash, pieces, pii, pitman_yor, simhash, structure, token_counts, token_ids, url_filter
from .common import table


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.query(table(spark, sf_dir, "pages"))


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.query(table(spark, sf_dir, "documents"))


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.query(table(spark, sf_dir, "documents"))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.query(table(spark, sf_dir, "documents"))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.query(table(spark, sf_dir, "conversations"))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(table(spark, sf_dir, "documents"))


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.query(table(spark, sf_dir, "documents"))


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(table(spark, sf_dir, "documents"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.query(table(spark, sf_dir, "documents"))


def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.query(table(spark, sf_dir, "conversations"))


def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.query(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": _op1,
    "op2_url_filter": _op2,
    "op3_minhash": _op3,
    "op4_language_id": _op4,
    "op5_token_ids": _op5,
    "op6_chat": _op6,
    "op7_simhash": _op7,
    "op8_pieces": _op8,
    "op9_pii": _op9,
    "op10_pitman_yor": _op10,
    "op11_lexical_search": _op11,
    "op12_structure_repair": _op12,
    "op13_token_counts": _op13,
}
ORACLE_SQL: dict[str, str] = {"op2_url_filter": url_filter.ORACLE, "op11_lexical_search": lexical.ORACLE, "op12_structure_repair": structure.ORACLE}
