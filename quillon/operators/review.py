"""Change reviews: what a patch touches, and which queries to ask about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of a patch that name nothing.
NOISE = [
    "abstract", "any", "array", "async", "await", "boolean", "break", "case", "catch", "class", "const", "continue", "debugger", "declare", "default", "delete", "else", "enum", "export", "extends", "false", "finally",
    "for", "from", "func", "function", "implements", "import", "interface", "let", "map", "namespace", "never", "new", "null", "number", "object", "package", "private", "protected", "public", "readonly", "return", "self",
    "static", "string", "struct", "super", "switch", "this", "throw", "true", "try", "type", "typeof", "undefined", "unknown", "using", "var", "void", "while", "with", "yield",
]
IDENTIFIER = r"([A-Za-z_$][A-Za-z0-9_$]*)"


def patch_lines(patches: DataFrame, key: str = "path", patch: str = "patch") -> DataFrame:
    """``key, sign, body`` of added and removed lines."""
    rows = patches.select(key, F.explode(F.split(patch, "\r?\n", -1)).alias("l"))
    changed = (F.col("l").startswith("+") & ~F.col("l").startswith("+++")) | (F.col("l").startswith("-") & ~F.col("l").startswith("---"))
    return rows.where(changed).select(key, F.substring("l", 1, 1).alias("sign"), F.substring("l", 2, 1 << 30).alias("body"))


def patch_stats(patches: DataFrame, key: str = "path", patch: str = "patch") -> DataFrame:
    """Lines added and removed, and whether the patch is binary."""
    n = patch_lines(patches, key, patch).groupBy(key).agg(F.count_if(F.col("sign") == "+").alias("additions"), F.count_if(F.col("sign") == "-").alias("deletions"))
    zero = F.lit(0).cast("long")
    return patches.select(key, F.col(patch).rlike("(?m)^(Binary files .*|GIT binary patch)$").alias("binary")).join(n, key, "left").select(key, F.coalesce("additions", zero).alias("additions"), F.coalesce("deletions", zero).alias("deletions"), "binary")


def changed_identifiers(patches: DataFrame, k: int = 10, key: str = "path", patch: str = "patch") -> DataFrame:
    """The k identifiers of each patch with the highest score: 3 for each addition and 2 for each removal, more for Pascal and camel case and for eight letters."""
    words = patch_lines(patches, key, patch).select(key, "sign", F.explode(F.regexp_extract_all("body", F.lit(IDENTIFIER), 1)).alias("identifier"))
    i = F.col("identifier")
    words = words.where((F.length(i) >= 3) & ~F.lower(i).isin(NOISE))
    score = F.when(F.col("sign") == "+", 3).otherwise(2) + i.rlike("^[A-Z][A-Za-z0-9_$]+$").cast("int") * 2 + i.rlike("[a-z][A-Z]").cast("int") + (F.length(i) >= 8).cast("int")
    total = words.groupBy(key, "identifier").agg(F.sum(score).alias("score"))
    return total.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "identifier"))).where(F.col("n") <= k)


def path_words(path: Column) -> Column:
    """What to ask by if a patch names nothing: the base name, then the folders' words from the innermost, each once."""
    bare = F.regexp_replace(path, r"\.[^./]+$", "")
    folders = F.reverse(F.filter(F.split(F.regexp_replace(bare, "/?[^/]*$", ""), "[/\\\\._-]+"), lambda s: s != ""))
    return F.array_distinct(F.filter(F.concat(F.array(F.element_at(F.split(bare, "/"), -1)), folders), lambda s: (F.length(s) >= 3) & ~F.lower(s).isin(NOISE)))


def review_queries(files: DataFrame, k: int = 8) -> DataFrame:
    """Queries for the k files ``(path, identifiers, changes)`` with most identifiers and changes: the first three, with all files that ask the same."""
    first = files.orderBy(F.desc(F.size("identifiers")), F.desc("changes"), "path").limit(k)
    ids = F.slice(F.when(F.size("identifiers") > 0, F.col("identifiers")).otherwise(path_words(F.col("path"))), 1, 3)
    rows = first.select("path", F.array_join(ids, " ").alias("query")).where("query <> ''")
    return rows.groupBy(F.lower("query").alias("asked")).agg(F.array_sort(F.collect_set("path")).alias("files"), F.min("query").alias("query")).select("query", "files")


def name_status(lines: DataFrame, line: str = "line") -> DataFrame:
    """``status, path, old_path`` from lines of a tab-separated name-status listing; copies and renames have two paths."""
    p = F.split(line, "\t")
    code = F.substring(F.element_at(p, 1), 1, 1)
    moved = code.isin("R", "C")
    names = F.create_map(*[F.lit(x) for x in ("A", "added", "M", "modified", "D", "deleted", "R", "renamed", "C", "copied", "T", "modified")])
    return lines.where(F.size(p) >= 2).select(F.coalesce(F.try_element_at(names, code), F.lit("unknown")).alias("status"), F.when(moved, F.try_element_at(p, F.lit(3))).otherwise(F.element_at(p, 2)).alias("path"), F.when(moved, F.element_at(p, 2)).alias("old_path"))
