"""What is added to results and facts: examples, verified edges, summaries, declarations, merged metadata, gates over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import paths, text


def best_example(results: DataFrame, golden: DataFrame, first: int = 5) -> DataFrame:
    """For each query the best-ranked of its first results that is a golden file."""
    hit = results.where(F.col("rank") < first).join(golden.select("file"), "file", "left_semi")
    return hit.groupBy("query_id").agg(F.min_by("file", "rank").alias("file"), F.min("rank").alias("rank"))


def grounded(results: DataFrame, examples: DataFrame) -> DataFrame:
    """``query_id, grounded``: whether exactly one result is the example's file and its snippet holds the example."""
    hit = examples.join(results.select("query_id", "file", "snippet"), ["query_id", "file"], "left")
    one = hit.groupBy("query_id").agg(F.count("snippet").alias("n"), F.max(F.contains("snippet", "example")).alias("inside"))
    return one.select("query_id", ((F.col("n") == 1) & F.coalesce("inside", F.lit(False))).alias("grounded"))


def verified(edges: DataFrame, current: DataFrame, known: DataFrame) -> DataFrame:
    """``edges(src, dst, src_fp, dst_fp)`` with ``state``: both full fingerprints must be those of the current files and agree with the manifest's short hashes.

    malformed, unknown (an end isn't a file any more), stale or verified.
    """
    ends = current.select(F.col("path").alias("p"), F.col("fingerprint").alias("f"))
    m = known.select(F.col("path").alias("q"), F.col("hash").alias("h"))
    rows = edges
    for side in ("src", "dst"):
        rows = rows.join(ends.withColumnsRenamed({"p": f"{side}_p", "f": f"{side}_f"}), F.col(side) == F.col(f"{side}_p"), "left").join(m.withColumnsRenamed({"q": f"{side}_q", "h": f"{side}_h"}), F.col(side) == F.col(f"{side}_q"), "left")
    shaped = F.col("src_fp").rlike("^[0-9a-f]{64}$") & F.col("dst_fp").rlike("^[0-9a-f]{64}$")
    agree = (F.substring("src_fp", 1, 16) == F.col("src_h")) & (F.substring("dst_fp", 1, 16) == F.col("dst_h")) & (F.col("src_fp") == F.col("src_f")) & (F.col("dst_fp") == F.col("dst_f"))
    state = F.when(~F.coalesce(shaped, F.lit(False)), "malformed").when(F.col("src_f").isNull() | F.col("dst_f").isNull(), "unknown").when(F.coalesce(agree, F.lit(False)), "verified").otherwise("stale")
    return rows.select(*edges.columns, state.alias("state"))


def exact_declaration(names: Column, query: Column) -> Column:
    """Whether the query names a declaration: the whole query if it is an identifier, else its camel- or snake-case words."""
    q = F.btrim(query)
    mixed = F.filter(F.regexp_extract_all(query, F.lit("([a-zA-Z_][a-zA-Z0-9_]*)"), 1), lambda w: w.rlike("[a-z][A-Z]|_"))
    asked = F.when(q.rlike("^[a-zA-Z_][a-zA-Z0-9_]*$"), F.array(q)).otherwise(mixed)
    own = F.flatten(F.transform(F.filter(names, lambda n: n.isNotNull()), lambda n: F.split(n, "[+]")))
    return F.arrays_overlap(F.transform(asked, F.lower), F.transform(own, F.lower))


def summary(kind: Column, name: Column, path: Column, layer: Column, lines: Column) -> Column:
    """One line on a result."""
    what = F.concat_ws(" ", F.coalesce(kind, F.lit("code")), name)
    return F.concat(what, F.lit(" in "), paths.base_name(path), F.when(layer.isNotNull() & (layer != "unknown"), F.concat(F.lit(" ("), layer, F.lit(")"))).otherwise(""), F.lit(", "), lines.cast("string"), F.lit(" lines"))


def signature(content: Column, k: int = 3, width: int = 200) -> Column:
    """The first lines that aren't blank or comments, cut to a width."""
    rows = F.filter(F.transform(F.split(content, "\n", -1), lambda x: F.btrim(x)), lambda x: (x != "") & ~x.rlike(r"^(//|#|/?\*)"))
    return F.substring(F.array_join(F.slice(rows, 1, k), " "), 1, width)


def scoped(path: Column, hint: Column, content: Column) -> Column:
    """A chunk's text under a comment that says what it stands in."""
    return F.concat(F.lit("// "), F.array_join(path, " > "), F.when(hint != "", F.concat(F.lit(" :: "), hint)).otherwise(""), F.lit("\n"), content)


def reasons(matched: Column, exact: Column, layer: Column, trend: Column) -> Column:
    """Why a result was found."""
    parts = F.array(F.when(F.size(matched) > 0, F.concat(F.lit("matches "), F.array_join(F.slice(matched, 1, 3), ", "))), F.when(exact, "declares it"), F.when(layer != "unknown", F.concat(F.lit("in layer "), layer)), F.when(trend == "Declining", "declining pattern"))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull()), "; ")


def exporters(symbols: DataFrame) -> DataFrame:
    """Which files export each symbol."""
    return symbols.groupBy("name").agg(F.array_sort(F.collect_set("file")).alias("files"))


def merged_metadata(parts: DataFrame) -> DataFrame:
    """Analyzers' numbers ``(analyzer, priority, framework, indicators, layer, files)`` as one: most files of each layer, and the framework of the highest priority with three indicators or more."""
    best = parts.where("indicators >= 3").agg(F.max_by("framework", F.struct("priority", "framework")).alias("framework"))
    layers = parts.groupBy("layer").agg(F.max("files").alias("files"))
    return layers.join(F.broadcast(best))  # one row


def in_scope(conflicts: DataFrame, query: Column, rules: dict[str, str], legacy: tuple[str, ...] = ()) -> DataFrame:
    """Conflicts whose category a query is about: categories without a rule always are, legacy ones never."""
    keep = F.lit(True)
    for category, words in rules.items():
        keep = keep & ((F.col("category") != category) | text.has_word(query, words))
    return conflicts.where(keep & ~F.col("category").isin(list(legacy)))


def path_strings(json: Column) -> Column:
    """Strings in a JSON text that look like paths of files, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(json, F.lit(r'"((?:[\w.@-]+/)+[\w.@-]+\.\w+)"'), 1))


def narrowed(chunks: DataFrame, inside: list[str] | None = None, outside: list[str] | None = None, tests: bool | None = None, complexity: tuple[int, int] | None = None) -> DataFrame:
    """Further filters: path parts to hold and not to hold, test files only or never, a range of complexity."""
    low = F.lower("path")
    if inside:
        chunks = chunks.where(paths.any_of([F.contains(low, F.lit(p.lower())) for p in inside]))
    if outside:
        chunks = chunks.where(~paths.any_of([F.contains(low, F.lit(p.lower())) for p in outside]))
    if tests is not None:
        chunks = chunks.where(paths.is_test(F.col("path")) == tests)
    return chunks if complexity is None else chunks.where(F.col("complexity").between(*complexity))


def rescue_order(rows: DataFrame, keep: int | None = None) -> DataFrame:
    """Order of rescued chunks ``(query_id, file, clues, declared, file_clues, anchor, test, score, density, ordinal)``; the best of each file."""
    value = (F.col("file_clues") + F.col("declared")) * 8 + F.col("clues") * 3 + F.col("anchor").cast("int") * 8 - F.col("test").cast("int") * 2 - F.col("score")
    rows = rows.withColumn("value", value)
    best = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "file").orderBy(F.desc("value"), F.desc("density"), "ordinal"))).where("n = 1")
    out = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("value"), F.desc("density"), "ordinal")) - 1).drop("n")
    return out if keep is None else out.where(F.col("rank") < keep)


def gate(runs: DataFrame, baseline: str, rivals: list[str], percent: float, lower: tuple[str, ...] = ()) -> DataFrame:
    """For each measure of ``(lane, measure, value)`` and rival whether the baseline is within tolerance: passed, failed, or pending without evidence."""
    mean = runs.groupBy("lane", "measure").agg(F.avg("value").alias("value"))
    ours = mean.where(F.col("lane") == baseline).select("measure", F.col("value").alias("ours"))
    names = runs.select("measure").distinct().withColumn("rival", F.explode(F.array(*map(F.lit, rivals))))
    theirs = mean.select(F.col("lane").alias("rival"), "measure", F.col("value").alias("theirs"))
    rows = names.join(ours, "measure", "left").join(theirs, ["rival", "measure"], "left")
    good = F.when(F.col("measure").isin(list(lower)), F.col("ours") <= F.col("theirs") * (1 + percent / 100)).otherwise(F.col("ours") >= F.col("theirs") * (1 - percent / 100))
    return rows.withColumn("status", F.when(F.col("ours").isNull() | F.col("theirs").isNull(), "pending").when(good, "passed").otherwise("failed"))


def complete_runs(runs: DataFrame, tasks: list[str], lanes: list[str], repeats: int) -> DataFrame:
    """Missing and repeated runs of a full plan of lanes, tasks and repeats: ``lane, task, repeat, problem``."""
    spark = runs.sparkSession
    plan = spark.createDataFrame([(la, t, r) for la in lanes for t in tasks for r in range(repeats)], "lane string, task string, repeat int")
    n = runs.groupBy("lane", "task", "repeat").agg(F.count("*").alias("n"))
    rows = plan.join(n, ["lane", "task", "repeat"], "full_outer").join(plan.withColumn("planned", F.lit(True)), ["lane", "task", "repeat"], "left")
    problem = F.when(F.col("planned").isNull(), "unplanned").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return rows.select("lane", "task", "repeat", problem.alias("problem")).where("problem is not null")
