"""Spans of lines: around a hit, merged, cut to the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def around(hits: DataFrame, context: int, line: str = "line", total: str = "n_lines") -> DataFrame:
    return hits.withColumn("start", F.greatest(F.col(line) - context, F.lit(1))).withColumn("end", F.least(F.col(line) + context, F.col(total)))


def merged(spans: DataFrame, key: str) -> DataFrame:
    """Overlapping and adjacent spans of a key become one."""
    w = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.select(key, "start", "end").withColumn("new", F.when(before.isNull() | (F.col("start") > before + 1), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("parts")).drop("island")
