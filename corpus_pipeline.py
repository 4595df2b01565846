"""A training-corpus pipeline over the ``documents`` table, made of the operators in ``quillon.llm``.

Each stage takes all rows that the one before it kept and returns the columns of ``documents``; the last returns token ids.
ORACLE_SQL is None: a learned classifier, fingerprints and byte-pair encoding aren't SQL; ``tests/llm`` holds the stages against
brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, decontaminate, lines, quality, simhash
from quillon.llm.common import stored
from quillon.session import ship_package

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, learned from the labels of those that came in."""
    ship_package(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def unspread_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on many sites, but for each line's first place."""
    ship_package(spark)
    return lines.keep_unspread(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every near-duplicate group."""
    ship_package(spark)
    return simhash.keep_first(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every passage of the benchmark cut out."""
    ship_package(spark)
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and their decoding."""
    ship_package(spark)
    return bpe.with_ids(docs, TOKENIZER).drop("text", "n_chars")


STAGES = [("quality classifier", good_quality), ("line dedup", unspread_lines), ("simhash near-dedup", one_of_each), ("benchmark decontamination", uncontaminated), ("bpe encoding and decoding", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not k else stored(docs, "stage"), sf_dir)
    return docs
