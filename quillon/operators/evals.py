"""Offline evaluation: retrieval and discovery measures, gates, baselines, deterministic samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_hits(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """``query_id, first``: position from 1 of the first result whose path holds an expected pattern, null without one."""
    e = expected.groupBy("query_id").agg(F.collect_set("pattern").alias("patterns"))
    hit = ranked.join(e, "query_id").where(F.exists("patterns", lambda p: F.contains("path", p)))
    return e.select("query_id").join(hit.groupBy("query_id").agg((F.min("rank") + 1).cast("long").alias("first")), "query_id", "left")


def retrieval(ranked: DataFrame, expected: DataFrame, forbidden: DataFrame | None = None, gate: float = 0.7) -> DataFrame:
    """One row: queries, top-1 accuracy, top-3 recall, contamination of the first three and whether the gate is met."""
    rows = first_hits(ranked, expected)
    if forbidden is not None:
        bad = first_hits(ranked, forbidden).select("query_id", F.col("first").alias("bad"))
        rows = rows.join(bad, "query_id", "left")
    else:
        rows = rows.withColumn("bad", F.lit(None).cast("long"))
    out = rows.agg(F.count("*").alias("queries"), F.avg(F.coalesce(F.col("first") == 1, F.lit(False)).cast("int")).alias("top1"), F.avg(F.coalesce(F.col("first") <= 3, F.lit(False)).cast("int")).alias("top3"), F.avg(F.coalesce(F.col("bad") <= 3, F.lit(False)).cast("int")).alias("contaminated"))
    return out.withColumn("passed", F.col("top3") * F.col("queries") >= F.ceil(F.col("queries") * gate))


def signals(rows: DataFrame, text: str, expected: list[str], forbidden: list[str]) -> DataFrame:
    """``rows`` with the expected signals that their text has and lacks, the forbidden ones it has, and ``useful``, the share of the expected."""
    low = F.lower(F.col(text))
    e, f = F.array(*map(F.lit, expected)), F.array(*map(F.lit, forbidden)).cast("array<string>")
    has = lambda x: F.contains(low, F.lower(x))
    return rows.withColumns({"matched": F.filter(e, has), "missing": F.filter(e, lambda x: ~has(x)), "found_forbidden": F.filter(f, has)}).withColumn("useful", F.size("matched") / len(expected))


def preflight_rates(tasks: DataFrame) -> DataFrame:
    """One row over ``(risk, ready, abstain, first_hit, target_in_top3, example_hit)``: how often safe tasks are ready, unsafe ones refused or wrongly ready, targets and examples found.

    Shares are null where no task calls for them.
    """
    safe, unsafe = F.col("risk") == "safe", F.col("risk") == "unsafe"
    rate = lambda of, yes: F.count_if(of & yes) / F.nullif(F.count_if(of), F.lit(0))
    target, example = F.col("target_in_top3").isNotNull(), F.col("example_hit").isNotNull()
    return tasks.agg(
        F.count("*").alias("tasks"), F.count_if(safe).alias("safe"), F.count_if(unsafe).alias("unsafe"), rate(target, F.col("target_in_top3")).alias("target_rate"), F.avg("first_hit").alias("first_hit"),
        rate(example, F.col("example_hit")).alias("example_rate"), rate(safe, F.col("ready")).alias("safe_ready"), rate(unsafe, F.col("abstain")).alias("unsafe_refused"), rate(unsafe, F.col("ready")).alias("unsafe_ready"),
    )


def relative(path: Column, root: str = "") -> Column:
    """A path within a repository: with slashes, without one leading ``./``, the root in any case, and leading slashes."""
    top = root.replace("\\", "/").removesuffix("/").lower() + "/"
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")
    if root:
        p = F.when(F.startswith(F.lower(p), F.lit(top)), F.substring(p, len(top) + 1, 1 << 20)).otherwise(p)
    return F.regexp_replace(p, "^/+", "")


def answer_files(answers: DataFrame, root: str = "") -> DataFrame:
    """``task, file, start, end, full_file`` of answers ``(task, evidence, referenced)``: a span for each piece of evidence, and the whole of files that are only referred to."""
    def clean(path: Column) -> Column:
        return relative(path, root)

    spans = answers.select("task", F.explode("evidence").alias("e")).select("task", clean(F.col("e.file")).alias("file"), F.col("e.start").alias("start"), F.col("e.end").alias("end"), F.lit(False).alias("full_file"))
    whole = answers.select("task", F.explode(F.array_distinct(F.transform("referenced", clean))).alias("file")).where("file <> ''").join(spans.select("task", "file"), ["task", "file"], "left_anti")
    return spans.union(whole.select("task", "file", F.lit(1), F.lit(None).cast("int"), F.lit(True)))


def answer_problems(answers: DataFrame) -> DataFrame:
    """What is wrong with answers ``(task, status, evidence, referenced)``, by name: an unknown status, evidence without a file, lines that are no range, readiness without evidence."""
    e = F.col("evidence")
    checks = [
        (~F.coalesce(F.col("status").isin("ready", "abstain", "partial"), F.lit(False)), "status"), (F.exists(e, lambda x: F.coalesce(F.btrim(x["file"]), F.lit("")) == ""), "file"),
        (F.exists(e, lambda x: ~F.coalesce((x["start"] >= 1) & (x["end"] >= x["start"]), F.lit(False))), "lines"), ((F.col("status") == "ready") & (F.size(e) == 0), "false ready"),
    ]
    return answers.select("task", F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for test, name in checks]), lambda x: x.isNotNull()).alias("problems"))


def means(runs: DataFrame, key: str, *measures: str) -> DataFrame:
    """Means over the runs that have the measure, null where none has; ``evidence`` if any run brought some."""
    return runs.groupBy(key).agg(*[F.avg(m).alias(m) for m in measures], F.count("*").alias("runs"), F.bool_or(reduce(Column.__or__, [F.col(m).isNotNull() for m in measures])).alias("evidence"))


def stratified(rows: DataFrame, strata: list[str], per: int, total: int, seed: str, key: str) -> DataFrame:
    """``total`` rows in the order of a hash of seed and key: up to ``per`` of each value of every stratum first, then what comes next."""
    rows = rows.withColumn("h", F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256))
    picks = [rows.withColumn("n", F.row_number().over(Window.partitionBy(s).orderBy("h"))).where(F.col("n") <= per).drop("n").withColumn("turn", F.lit(i)) for i, s in enumerate(strata)]
    fill = rows.orderBy("h").limit(total).withColumn("turn", F.lit(len(strata)))
    every = reduce(DataFrame.unionByName, [*picks, fill]).groupBy(key).agg(F.min("turn").alias("turn"), F.min("h").alias("h"))
    return every.orderBy("turn", "h").limit(total).select(key, "turn")


def _holding(rows: DataFrame, body: Column, tokens: DataFrame, block: int = 1000) -> DataFrame:
    """``rows`` once for each of the ``tokens(token)`` that ``body`` holds. Tokens come in blocks of about ``block``, each one broadcast row, so that only what is found is multiplied."""
    n = -(-tokens.count() // block) or 1
    parts = [tokens if n == 1 else tokens.where(F.pmod(F.xxhash64("token"), F.lit(n)) == b) for b in range(n)]
    asked = [F.broadcast(p.agg(F.collect_set("token").alias("asked"))) for p in parts]
    return reduce(DataFrame.union, [rows.join(a).withColumn("token", F.explode(F.filter("asked", lambda t: F.contains(body, t)))).drop("asked") for a in asked])


def lexical_baseline(files: DataFrame, queries: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Score of each query and file: 8 for every token in the path, 1 for every token of a line; and the first line with most tokens. Empty tokens don't count."""
    q = queries.select("query_id", F.lower("token").alias("token")).where("token <> ''").distinct()
    tokens = q.select("token").distinct()
    lines = files.select(key, F.posexplode(F.split(F.lower(text), "\n", -1)).alias("line", "body"))
    found = _holding(lines, F.col("body"), tokens).select(key, "line", "token")
    hit = found.join(q, "token").groupBy("query_id", key, "line").agg(F.count("*").alias("n"))
    body = hit.groupBy("query_id", key).agg(F.sum("n").alias("lines"), (F.max_by("line", F.struct("n", -F.col("line"))) + 1).alias("best"))
    placed = _holding(files.select(key), F.lower(key), tokens)
    on_path = placed.join(q, "token").groupBy("query_id", key).agg(F.count("*").alias("n"))
    rows = body.join(on_path, ["query_id", key], "full_outer")
    return rows.select("query_id", key, (8 * F.coalesce("n", F.lit(0)) + F.coalesce("lines", F.lit(0))).alias("score"), "best")


def step_files(spans: DataFrame, traces: DataFrame, root: str) -> DataFrame:
    """``task, files`` of an answer's one step: files of its ``spans(task, file)`` and of its ``traces(task, files)``, relative to the root, once each and sorted."""
    seen = traces.select("task", F.explode("files").alias("file")).select("task", relative(F.col("file"), root).alias("file"))
    both = spans.select("task", "file").union(seen).where("file <> ''")
    return both.groupBy("task").agg(F.array_sort(F.collect_set("file")).alias("files"))


def budget(rows: DataFrame, group: str, order: str, size: Column, most: int) -> DataFrame:
    """The first rows of each group whose sizes stay within a budget together; what comes after is dropped."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= most)
