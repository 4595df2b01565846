"""Readiness to edit: what evidence there is, what speaks against it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evidence(tasks: DataFrame) -> DataFrame:
    """``score, status, stress, abstain, ready`` of tasks with the counts ``results, patterns, notes, stale_notes, failures, conflicts, callers, covered``
    and ``quality`` (ok or low_confidence) and ``age`` (fresh, aging or stale)."""
    def strength(strong, weak):
        return F.when(strong, 1.0).when(weak, 0.5).otherwise(0.0)

    code = strength(F.col("results") >= 3, F.col("results") > 0)
    pattern = strength(F.col("patterns") >= 2, F.col("patterns") == 1)
    note = strength((F.col("notes") >= 2) | (F.col("failures") > 0), F.col("notes") == 1)
    rows = tasks.withColumns({"code": code, "pattern": pattern, "note": note})
    parts = ("code", "pattern", "note")
    count = lambda v: sum(((F.col(p) == v).cast("int") for p in parts), F.lit(0))
    strong, weak, missing = count(1.0), count(0.5), count(0.0)
    status = F.when((F.col("code") == 1.0) & (strong >= 2), "pass").when((F.col("code") > 0) & ((strong >= 1) | (weak >= 2)), "warn").otherwise("block")
    total = F.col("notes") + F.col("stale_notes")
    stress = F.least(F.col("conflicts"), F.lit(3)) + (F.coalesce(F.col("stale_notes") / F.nullif(total, F.lit(0)), F.lit(0.0)) > 0.5).cast("int") + (missing >= 2).cast("int") + ((F.col("callers") > 3) & (F.col("covered") / F.greatest("callers", F.lit(1)) < 0.4)).cast("int")
    rows = rows.withColumns({"score": F.floor(45 * F.col("code") + 30 * F.col("pattern") + 25 * F.col("note") + 0.5).cast("int"), "status": status, "stress": stress})
    rows = rows.withColumn("abstain", (F.col("stress") >= 3) | ((F.col("stress") == 2) & (F.col("status") != "pass")))
    down = F.col("abstain") | (F.col("quality") == "low_confidence")
    final = F.when(F.col("age") == "stale", "block").when(down & (F.col("status") == "pass"), "warn").otherwise(F.col("status"))
    rows = rows.withColumn("status", final)
    return rows.withColumn("ready", (F.col("status") == "pass") & ~F.col("abstain") & (F.col("quality") != "low_confidence"))


def risk(rows: DataFrame) -> DataFrame:
    """``risk`` of an edit: high on a cycle or with over ten files affected, medium with over three."""
    return rows.withColumn("risk", F.when((F.col("cycles") > 0) | (F.col("affected") > 10), "high").when(F.col("affected") > 3, "medium").otherwise("low"))
