"""Views of the test tables as the frames that the operators work on, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-07-01"

FILES_SQL = """files AS (
  SELECT doc_id, source || '/' || (['src', 'docs', '__tests__', 'models', 'config'])[(doc_id % 5 + 1)::INT] || '/' || lang || doc_id ||
    (['.ts', '.py', '.md', '.spec.ts', '.html', '.txt', '.png'])[(doc_id % 7 + 1)::INT] AS path, text, lang, source FROM documents)"""
EDGES_SQL = """edges AS (
  SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b
    ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_quantity >= 40 AND b.l_quantity >= 40 AND a.l_suppkey <> b.l_suppkey)"""
SPARSE_SQL = """sparse AS (
  SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b
    ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_quantity >= 50 AND b.l_quantity >= 50 AND a.l_partkey <> b.l_partkey)"""
PATTERNS_SQL = "observed AS (SELECT o_orderstatus AS category, o_orderpriority AS name, o_custkey AS file, o_orderdate AS ts, o_orderkey AS seq FROM orders)"
NOTES_SQL = """notes AS (
  SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'convention' WHEN 'click' THEN 'decision' WHEN 'error' THEN 'failure' ELSE 'gotcha' END AS type,
    event_type AS category, props AS memory, user_id AS file, ts FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` over all cores, by their keys. A small file is one task, and what is derived from it may be a hundred times its size, which a plan made from the file's size doesn't see."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism * 2, *keys)


def _pick(names: list[str], n: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, path, text, lang, source``: each document as a file."""
    d = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), _pick(["src", "docs", "__tests__", "models", "config"], F.col("doc_id")), F.lit("/"), "lang", F.col("doc_id").cast("string"), _pick([".ts", ".py", ".md", ".spec.ts", ".html", ".txt", ".png"], F.col("doc_id")))
    return d.select("doc_id", path.alias("path"), "text", "lang", "source")


def _neighbours(spark: SparkSession, sf_dir: str, key: str, least: int) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") >= least).select("l_orderkey", "l_linenumber", key)
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col(key).alias("dst"))
    return lines.withColumnRenamed(key, "src").join(after, ["l_orderkey", "l_linenumber"]).where("src <> dst").select("src", "dst").distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense graph: suppliers of large neighbouring lines of an order."""
    return _neighbours(spark, sf_dir, "l_suppkey", 40)


def near_edges(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    """As :func:`edges`, of lines of at least that quantity."""
    return _neighbours(spark, sf_dir, "l_suppkey", least)


def sparse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse graph: parts of the largest neighbouring lines of an order."""
    return _neighbours(spark, sf_dir, "l_partkey", 50)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern observations ``category, name, file, ts, seq``."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("category"), F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("file"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes ``id, type, category, memory, file, ts``."""
    kind = F.when(F.col("event_type") == "view", "convention").when(F.col("event_type") == "click", "decision").when(F.col("event_type") == "error", "failure").otherwise("gotcha")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), kind.alias("type"), F.col("event_type").alias("category"), F.col("props").alias("memory"), F.col("user_id").alias("file"), "ts")
