"""Risk of files from their place in the graph and their complexity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scores import LEVELS

MEASURES = ("fan_out", "fan_in", "cycles", "complexity")


def metrics(degrees: DataFrame, cycles: DataFrame, complexity: DataFrame) -> DataFrame:
    """All measures of every node, 0 where unknown, and its ``place`` by degree; a union and one aggregation instead of outer joins.

    Only nodes that can be among the ten first by degree are ranked.
    """
    parts = [df.select("node", *[(F.col(m) if m in df.columns else F.lit(None)).cast("long").alias(m) for m in MEASURES]) for df in (degrees, cycles, complexity)]
    rows = reduce(DataFrame.union, parts).groupBy("node").agg(*[F.coalesce(F.max(m), F.lit(0)).alias(m) for m in MEASURES])
    degree = F.col("fan_out") + F.col("fan_in")
    first = rows.where(degree > 0).orderBy(F.desc(degree), "node").limit(10)
    ranked = first.select(F.col("node").alias("hot"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(degree), "node")).alias("place"))
    return rows.join(F.broadcast(ranked), F.col("node") == F.col("hot"), "left").drop("hot")  # ten rows


def scored(rows: DataFrame) -> DataFrame:
    """``score``, ``level``, and up to three ``reasons``."""
    def pick(high, low, strong, weak):
        return F.when(high, strong).when(low, weak)

    cyc, fan, place, cx = (F.col(c) for c in ("cycles", "fan_in", "place", "complexity"))
    top5, top10 = F.coalesce(place <= 5, F.lit(False)), F.coalesce(place <= 10, F.lit(False))
    score = F.when(cyc > 0, 3).otherwise(0) + F.coalesce(pick(fan >= 8, fan >= 4, 2, 1), F.lit(0)) + F.coalesce(pick(top5, top10, 2, 1), F.lit(0)) + F.coalesce(pick(cx >= 18, cx >= 10, 2, 1), F.lit(0))
    reasons = F.array(
        F.when(cyc > 0, F.concat(F.lit("cycles: "), cyc.cast("string"))), F.when(fan >= 4, F.concat(F.lit("importers: "), fan.cast("string"))),
        F.when(top10, F.concat(F.lit("hotspot "), place.cast("string"))), F.when(cx >= 10, F.concat(F.lit("complexity "), cx.cast("string"))),
    )
    rows = rows.withColumn("score", score).withColumn("level", F.when(F.col("score") >= 4, "high").when(F.col("score") >= 2, "medium").otherwise("low"))
    return rows.withColumn("reasons", F.slice(F.filter(reasons, lambda x: x.isNotNull()), 1, 3))


def _severity(level):
    return F.element_at(F.create_map(*[F.lit(x) for p in LEVELS.items() for x in p]), level)


def summary(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.count_if(F.col("level") == x).alias(x) for x in ("high", "medium", "low")])


def at_least(rows: DataFrame, level: str) -> DataFrame:
    """Rows of that level or a worse one, with ``severity``."""
    return rows.withColumn("severity", _severity(F.col("level"))).where(F.col("severity") >= LEVELS[level])


def worst(results: DataFrame, rows: DataFrame) -> DataFrame:
    """The worst level among results, and how many of them have one."""
    known = results.join(rows.select("node", "level"), "node", "left")
    return known.agg(F.max_by("level", _severity(F.col("level"))).alias("worst"), F.count("level").alias("known"), F.count("*").alias("results"))
