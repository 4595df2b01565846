"""The operators bound to the tables of the test corpus, one query each, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, chat, decontaminate, embeddings, langid, lines, quality, simhash, substrings, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {
    "op1_embedding_near_dedup": embeddings.ORACLE, "op2_substring_dedup": substrings.ORACLE, "op3_line_dedup": lines.ORACLE, "op9_chat_tools": chat.ORACLE, "op10_decontamination": decontaminate.ORACLE,
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.op1_embedding_near_dedup(_table(spark, sf_dir, "embeddings"))


@_query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.op2_substring_dedup(_table(spark, sf_dir, "documents"))


@_query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.op3_line_dedup(_table(spark, sf_dir, "documents"))


@_query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op4_simhash(_table(spark, sf_dir, "documents"))


@_query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op5_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op6_language(_table(spark, sf_dir, "documents"))


@_query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op7_bpe(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op8_token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op9_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op9_chat_tools(_table(spark, sf_dir, "conversations"))


@_query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op10_decontamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
