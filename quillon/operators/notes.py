"""Notes of a team: identity, decay, filters, order, relevance to results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import scores

# Commit subjects that make a note, and what kind.
COMMITS = [("refactor", "decision", "architecture"), ("migrate", "decision", "dependencies"), ("fix", "gotcha", "conventions"), ("revert", "gotcha", "architecture")]


def scope_text(kind: Column, file: Column, symbol: Column) -> Column:
    return F.when(kind == "file", F.concat_ws(":", F.lit("file"), file)).when(kind == "symbol", F.concat_ws(":", F.lit("symbol"), file, symbol)).otherwise("global")


def identity(type_: Column, category: Column, memory: Column, reason: Column, scope: Column) -> Column:
    """A note's identifier: 12 digits of the hash of all that it says."""
    return F.substring(F.sha2(F.concat_ws(":", type_, category, memory, reason, scope), 256), 1, 12)


def decayed(notes: DataFrame, now: Column) -> DataFrame:
    c = scores.confidence(F.col("type"), F.col("ts"), now)
    return notes.withColumn("confidence", c).withColumn("stale", scores.is_stale(F.col("confidence")) | F.col("ts").isNull())


def matching(notes: DataFrame, terms: list[str], *texts: str) -> DataFrame:
    """Notes in whose texts some term stands, in any case; no terms match all."""
    low = F.lower(F.concat_ws(" ", *texts))
    return notes.where(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(low, F.lower(t)))) if terms else notes


def recent(notes: DataFrame, k: int, tie: str = "id") -> DataFrame:
    """The newest k notes; without a date a note counts as oldest."""
    return notes.orderBy(F.desc(F.coalesce("ts", F.lit("1970-01-01").cast("timestamp"))), tie).limit(k)


def added(store: DataFrame, new: DataFrame) -> DataFrame:
    """``store`` and those of ``new`` whose identifier it lacks, each once."""
    return store.unionByName(new.dropDuplicates(["id"]).join(store.select("id"), "id", "left_anti"))


def boosted(notes: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``boost``: 3 for a note on a result's file; for one on a symbol 4 with its file and symbol, 2 with the file, 1 with the symbol."""
    f = files.select(F.col("file").alias("rf")).distinct()
    s = symbols.select(F.lower("symbol").alias("rs")).distinct()
    rows = notes.join(f, F.col("file") == F.col("rf"), "left").join(s, F.lower("symbol") == F.col("rs"), "left")
    hit_file, hit_symbol = F.col("rf").isNotNull(), F.col("rs").isNotNull()
    boost = F.when(F.col("scope") == "file", F.when(hit_file, 3).otherwise(0)).when(F.col("scope") == "symbol", F.when(hit_file & hit_symbol, 4).when(hit_file, 2).when(hit_symbol, 1).otherwise(0)).otherwise(0)
    return rows.withColumn("boost", boost).drop("rf", "rs")


def strong(notes: DataFrame, k: int = 2) -> DataFrame:
    """The first k notes that two terms or a boost of two support and that are half sure."""
    good = ((F.col("matches") >= 2) | (F.col("boost") >= 2)) & (F.col("confidence") >= 0.5)
    return notes.where(good).orderBy(F.desc("boost"), F.desc("matches"), F.desc("confidence"), "id").limit(k)


def from_commits(log: DataFrame, line: str = "line") -> DataFrame:
    """Notes from lines ``date<tab>hash subject`` of a commit log: ``id, type, category, memory, ts``; messages under 10 characters make none."""
    date, rest = F.btrim(F.substring_index(line, "\t", 1)), F.btrim(F.regexp_extract(line, "\t(.*)$", 1))
    kind, category = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for prefix, k, c in COMMITS:
        fits = rest.rlike(rf"(?i)^[a-f0-9]+ {prefix}[(!:]")
        kind, category = kind.when(fits, k), category.when(fits, c)
    message = F.btrim(F.regexp_replace(rest, "(?i)^[a-f0-9]+ ", ""))
    rows = log.select(kind.alias("type"), category.alias("category"), message.alias("memory"), F.try_to_timestamp(date).alias("ts"))
    rows = rows.where("type is not null and ts is not null and length(memory) >= 10")
    return rows.select(F.substring(F.sha2(F.concat_ws(":", F.lit("git"), "type", "category", "memory"), 256), 1, 12).alias("id"), "type", "category", "memory", "ts")
