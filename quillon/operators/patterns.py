"""Usage patterns of a code base: consensus, robust dates, conflicts, canonical examples, golden files, library use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import paths, scores


def frequencies(observed: DataFrame) -> DataFrame:
    """``category, name, n, percent``: counts, and shares of the category rounded half up to whole percent."""
    n = observed.groupBy("category", "name").agg(F.count("*").alias("n"))
    total = n.groupBy("category").agg(F.sum("n").alias("total"))
    return n.join(total, "category").select("category", "name", "n", F.floor(F.col("n") * 100 / F.col("total") + 0.5).cast("int").alias("percent"))


def robust_dates(observed: DataFrame, share: float = 0.1) -> DataFrame:
    """For each pattern the newest date, of five and more the one at index ``floor(share * n)`` of the newest first.

    Only a group's newest ``share`` of rows decides, but which these are takes a ranking of the group: dates are
    counted first, so that a group is ranked over its distinct dates and not over its rows.
    """
    keys = ["category", "name"]
    days = observed.where("ts is not null").groupBy(*keys, "ts").agg(F.count("*").alias("k"))
    w = Window.partitionBy(*keys)
    days = days.withColumn("upto", F.sum("k").over(w.orderBy(F.desc("ts")))).withColumn("n", F.sum("k").over(w))
    at = F.when(F.col("n") < 5, 0).otherwise(F.floor(F.col("n") * share))
    return days.where((F.col("upto") > at) & (F.col("upto") - F.col("k") <= at)).select(*keys, F.col("ts").alias("date"))


def consensus(observed: DataFrame, now: Column, alternatives: int = 3) -> DataFrame:
    """The leading pattern of each category and its next ``alternatives``: share, trend and guidance."""
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "name"))
    rows = frequencies(observed).withColumn("place", place).where(F.col("place") <= 1 + alternatives)
    rows = rows.join(robust_dates(observed), ["category", "name"], "left").withColumn("trend", scores.trend(F.col("date"), now))
    rising = F.max((F.col("place") > 1) & (F.coalesce(F.col("trend") == "Rising", F.lit(False)))).over(Window.partitionBy("category"))
    rows = rows.withColumn("rising", rising)
    return rows.withColumn("guidance", scores.guidance(F.col("name"), F.col("percent"), F.col("trend"), F.col("place") > 1, F.col("rising")))


def conflicts(shares: DataFrame, complementary: DataFrame | None = None) -> DataFrame:
    """Categories whose leader is below 80 % and has a challenger of 20 % or more that doesn't go along with it."""
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "name"))
    rows = shares.withColumn("place", place)
    lead = rows.where("place = 1 and percent < 80").select("category", F.col("name").alias("leader"), F.col("percent").alias("leader_percent"))
    out = rows.where("place > 1 and percent >= 20").select("category", F.col("name").alias("challenger"), F.col("percent").alias("challenger_percent")).join(lead, "category")
    if complementary is None:
        return out
    pairs = complementary.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    return out.join(pairs, (F.least("leader", "challenger") == F.col("x")) & (F.greatest("leader", "challenger") == F.col("y")), "left_anti")


def canonical_examples(examples: DataFrame) -> DataFrame:
    """For each ``category, name`` the example that a reader in order of ``seq`` ends with.

    The reader keeps the first example, but takes one from a core or shared directory over one that isn't, and among equals one of over 50
    characters over a longer one of over 200. So examples outside those directories count only where there is none inside; the first
    stays if it has at most 200 characters; else the first of 51 to 200 wins, or without any the first of the shortest. These are plain
    aggregates, and no group is held in a task.
    """
    prior = F.contains("file", F.lit("core/")) | F.contains("file", F.lit("shared/"))
    one, size = F.struct("file", "snippet"), F.length("snippet")
    rows = examples.withColumn("prior", prior).groupBy("category", "name", "prior").agg(
        F.min_by(one, "seq").alias("first"), F.min_by(one, F.when(size.between(51, 200), F.col("seq"))).alias("short"), F.min_by(one, F.when(size > 200, F.struct(size, "seq"))).alias("least")
    )
    best = F.when(F.length("first.snippet") <= 200, F.col("first")).otherwise(F.coalesce("short", "least"))
    return rows.groupBy("category", "name").agg(F.max_by(best, "prior").alias("x")).select("category", "name", "x.file", "x.snippet")


def golden_files(observed: DataFrame, k: int = 5, least: int = 2) -> DataFrame:
    """The files that show most patterns, if of at least ``least`` categories."""
    n = observed.groupBy("file").agg(F.countDistinct("category").alias("categories"), F.countDistinct("category", "name").alias("score"))
    return n.where(F.col("categories") >= least).orderBy(F.desc("score"), "file").limit(k)


def library_use(imports: DataFrame, builtin: tuple[str, ...] = (), examples: int = 3) -> DataFrame:
    """For each package ``source``: imports, files, and its first places ``file:line``; relative and built-in ones don't count."""
    rows = imports.where(~F.col("source").startswith(".") & ~F.col("source").isin(list(builtin)))
    place = F.struct("file", "line")
    first = F.transform(F.slice(F.array_sort(F.collect_set(place)), 1, examples), lambda p: F.concat_ws(":", p["file"].cast("string"), p["line"].cast("string")))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"), F.array_join(first, ",").alias("examples"))


def package_use(imports: DataFrame, examples: int = 10) -> DataFrame:
    """For each package ``source``: distinct places ``(path, line)``, a place being named by the last four segments of its path, and the first of them."""
    rows = imports.where(~F.col("source").startswith(".")).select("source", paths.tail(F.col("path"), 4).alias("file"), "line").distinct()
    first = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("file", "line"))), 1, examples), lambda p: F.concat_ws(":", p["file"], p["line"].cast("string")))
    return rows.groupBy("source").agg(F.count("*").alias("places"), F.countDistinct("file").alias("files"), F.array_join(first, ",").alias("examples"))


def first_dependencies(found: DataFrame) -> DataFrame:
    """One row a dependency ``(name, version, place)``: what its first place states."""
    return found.groupBy("name").agg(F.min_by("version", "place").alias("version"))


def united(parts: DataFrame, key: str, *lists: str) -> DataFrame:
    """Lists of several parts ``(key, place, …)`` as one: every element once, sorted."""
    return parts.groupBy(key).agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in lists])


def with_dates(observed: DataFrame, dates: DataFrame) -> DataFrame:
    """Observations ``(…, file)`` with ``ts``, when their file was last changed; null where nothing is known of it."""
    return observed.drop("ts").join(dates.select(F.col("path").alias("file"), "ts"), "file", "left")


def merged_dependencies(found: DataFrame) -> DataFrame:
    """One row a dependency: the version of the last package, and of its last kind, that states it; without its range mark."""
    return found.groupBy("name").agg(F.regexp_replace(F.max_by("version", F.struct("package", "kind")), r"^[\^~]", "").alias("version"))
