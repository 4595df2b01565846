"""Content-hash manifests ``(path, hash)``: differences, stale rows, incremental rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import content_hash


def manifest(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    return files.select(F.col(path).alias("path"), content_hash(F.col(text)).alias("hash"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, status``: added, deleted, changed or unchanged; one aggregation over both sides."""
    both = old.select("path", F.col("hash").alias("o"), F.lit(None).cast("string").alias("n")).union(new.select("path", F.lit(None), "hash"))
    rows = both.groupBy("path").agg(F.max("o").alias("o"), F.max("n").alias("n"))
    return rows.select("path", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.col("o") != F.col("n"), "changed").otherwise("unchanged").alias("status"))


def freshness(chunks: DataFrame, known: DataFrame, current: DataFrame) -> DataFrame:
    """``chunks`` with ``state``: corrupt without a manifest row, stale if the file changed or went, else current."""
    m = known.select(F.col("path").alias("mp"), F.col("hash").alias("mh"))
    c = current.select(F.col("path").alias("cp"), F.col("hash").alias("ch"))
    rows = chunks.join(m, F.col("path") == F.col("mp"), "left").join(c, F.col("path") == F.col("cp"), "left")
    state = F.when(F.col("mh").isNull(), "corrupt").when(F.col("ch").isNull() | (F.col("ch") != F.col("mh")), "stale").otherwise("current")
    return rows.withColumn("state", state).drop("mp", "mh", "cp", "ch")


def coverage(rows: DataFrame) -> DataFrame:
    """How many rows are stale, and whether what is left is current, partial or nothing."""
    n = rows.agg(F.count_if(F.col("state") == "stale").alias("stale"), F.count_if(F.col("state") == "current").alias("current"))
    return n.withColumn("status", F.when(F.col("stale") == 0, "current").when(F.col("current") > 0, "partial").otherwise("no_fresh_results"))


def rebuilt(chunks: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """``chunks`` without those of changed and deleted paths, and the ``fresh`` rows of added and changed ones."""
    gone = changes.where("status in ('changed', 'deleted')").select("path")
    made = changes.where("status in ('changed', 'added')").select("path")
    return chunks.join(gone, "path", "left_anti").unionByName(fresh.join(made, "path", "left_semi"))


def checked_snapshot(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose bytes moved while a build read them; a build that finds any must stop."""
    return diff(before, after).where("status <> 'unchanged'")
