"""Sources: file trees, commit logs, notes, guides, package manifests."""

from __future__ import annotations

import re
import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import paths
from quillon.operators.chunking import sections

MAX_BYTES = 1 << 20
MAX_FILES = 10_000
NOTE_SCHEMA = "id string, type string, category string, memory string, decision string, reason string, date string, scope struct<kind:string,file:string,symbol:string>"
# Places of a project's guides.
GUIDE_PATHS = ["STYLE_GUIDE.md", "CODING_STYLE.md", "ARCHITECTURE.md", "CONTRIBUTING.md", "docs/style-guide.md", "docs/coding-style.md", "docs/ARCHITECTURE.md"]


def ignore_pattern(line: str) -> str | None:
    """A regular expression for one line of an ignore file, without the ``!`` of a negation; None for comments and blanks."""
    line = line.strip().removeprefix("!")
    if not line or line[0] == "#":
        return None
    rooted, folder = line.startswith("/") or "/" in line.rstrip("/"), line.endswith("/")
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", line.strip("/"))
    body = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts)
    return ("^" if rooted else "(?:^|/)") + body + ("/" if folder else "(?:/|$)")


def is_ignored(path: Column, lines: list[str]) -> Column:
    """Whether the last of an ignore file's lines that fits a path ignores it; a line with ``!`` takes paths back in."""
    out = F.lit(False)
    for line in lines:
        if (p := ignore_pattern(line)) is not None:
            out = F.when(path.rlike(p), F.lit(not line.strip().startswith("!"))).otherwise(out)
    return out


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """``path, bytes, text, skip_reason`` of all files under ``root``; the text only of those that are eligible (no reason).

    Reasons, first that fits: ignored, binary, not code, too large, over the cap. The cap counts in order of paths. Without ``ignore`` the lines
    of the tree's own ``.gitignore`` hold. Paths and lengths decide; the bytes of files that are skipped, and of files too large, aren't read.
    """
    if ignore is None:
        jvm = spark.sparkContext._jvm
        own = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/.gitignore")
        fs, ignore = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), []
        if fs.exists(own):  # Spark's own readers pass over hidden files
            stream = fs.open(own)
            ignore = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
            stream.close()
    base = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = re.sub(r"^file:/+", "/", root.rstrip("/")) + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(prefix), "")
    rows = base.select(path.alias("path"), F.col("length").alias("bytes"), F.col("path").alias("place"))
    ignored = is_ignored(F.col("path"), ignore)
    inside = F.exists(F.split(F.lower("path"), "/"), lambda s: s.isin(paths.EXCLUDED_DIRECTORIES))
    reason = F.when(ignored | inside, "ignored").when(paths.is_binary(F.col("path")), "binary").when(~paths.is_code(F.col("path")), "not code").when(F.col("bytes") > MAX_BYTES, "too large")
    rows = rows.withColumn("skip_reason", reason)
    # The source reads a file's bytes only where they are asked for, and this filter on its length reaches it.
    content = base.where(F.col("length") <= MAX_BYTES).select(F.col("path").alias("place"), F.col("content").cast("string").alias("text"))
    eligible = rows.where("skip_reason is null").join(content, "place", "left").select("path", "bytes", "text", "skip_reason")
    return eligible.union(rows.where("skip_reason is not null").select("path", "bytes", F.lit(None).cast("string"), "skip_reason"))


def capped(files: DataFrame, most: int = MAX_FILES) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` eligible files by path, and how many are over with 20 of them."""
    eligible = files.where("skip_reason is null")
    kept = eligible.orderBy("path").limit(most)
    over = eligible.join(kept.select("path"), "path", "left_anti")
    first = over.select("path").orderBy("path").limit(20).agg(F.array_sort(F.collect_list("path")).alias("samples"))
    return kept, over.agg(F.count("*").alias("over")).join(F.broadcast(first))  # one row each


def preview(files: DataFrame) -> DataFrame:
    """Files and bytes by reason, eligible ones under ``eligible``."""
    return files.groupBy(F.coalesce("skip_reason", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def newest_dates(log: DataFrame, line: str = "value", order: str = "n", mark: str = ":::", block: int = 100_000) -> DataFrame:
    """``path, ts`` from a commit log of date lines ``:::date`` each followed by its paths: the first date a path comes after."""
    dated = log.withColumn("date", F.when(F.col(line).startswith(mark), F.substring(line, len(mark) + 1, 64))).withColumn("block", F.floor(F.col(order) / block))
    # The last date is carried forward within blocks of lines; only one row a block is ordered globally.
    w = Window.partitionBy("block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = dated.groupBy("block").agg(F.max_by("date", F.when(F.col("date").isNotNull(), F.col(order))).alias("end"))
    before = ends.select(F.col("block").alias("b"), F.last("end", ignorenulls=True).over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    dated = dated.join(before, F.col("block") == F.col("b"), "left")
    rows = dated.withColumn("at", F.coalesce(F.last("date", ignorenulls=True).over(w), "before")).where(F.col("date").isNull() & (F.btrim(line) != "") & F.col("at").isNotNull())
    return rows.groupBy(F.btrim(line).alias("path")).agg(F.min_by(F.try_to_timestamp("at"), order).alias("ts"))


def git_log(root: str, *args: str) -> list[str]:
    """Lines of a commit log, by git on the driver."""
    done = subprocess.run(["git", "-C", root, "log", *args], capture_output=True, text=True, timeout=60, check=True)
    return done.stdout.splitlines()


def git_diff(root: str, base: str, head: str = "HEAD") -> list[tuple[str, str]]:
    """``(path, patch)`` of the changes between two commits, by git on the driver."""
    done = subprocess.run(["git", "-C", root, "diff", "--no-color", base, head], capture_output=True, text=True, timeout=60, check=True)
    found = re.split(r"(?m)^diff --git a/.* b/(.*)$", done.stdout)
    return list(zip(found[1::2], found[2::2]))


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Notes of a JSON-lines file; older files call the text ``decision``; rows without identifier, type or text are left out."""
    rows = spark.read.schema(NOTE_SCHEMA).option("mode", "PERMISSIVE").json(path)
    memory = F.coalesce("memory", "decision")
    return rows.withColumn("memory", memory).drop("decision").where("id is not null and type is not null and memory is not null").withColumn("ts", F.try_to_timestamp("date"))


def append_notes(spark: SparkSession, path: str, new: DataFrame) -> int:
    """Add the notes whose identifier the store lacks; how many were added."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)
    have = read_notes(spark, path).select("id") if exists else new.select("id").limit(0)
    fresh = new.dropDuplicates(["id"]).join(have, "id", "left_anti").select("id", "type", "category", "memory", "reason", "date", "scope")
    n = fresh.count()
    if n:
        fresh.coalesce(1).write.mode("append").json(path)
    return n


def guides(spark: SparkSession, root: str) -> DataFrame:
    """``path, heading, body`` of the sections of a project's guides."""
    there = [f"{root}/{p}" for p in GUIDE_PATHS if (Path(root) / p).is_file()]
    if not there:
        return spark.createDataFrame([], "path string, pos int, heading string, body string")
    rows = spark.read.text(there, wholetext=True).select(F.regexp_replace(F.input_file_name(), "^.*/", "").alias("path"), F.posexplode(sections(F.col("value"))).alias("pos", "s"))
    return rows.select("path", "pos", "s.heading", "s.body").where("body <> '' or heading is not null")


def package_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, text`` of a tree's package manifests, outside folders that are never indexed."""
    base = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "package.json").load(root)
    prefix = re.sub(r"^file:/+", "/", root.rstrip("/")) + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(prefix), "")
    rows = base.select(path.alias("path"), F.col("content").cast("string").alias("text"))
    return rows.where(~F.exists(F.split(F.lower("path"), "/"), lambda x: x.isin(paths.EXCLUDED_DIRECTORIES)))


def packages(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``package, kind, name, version`` of all dependencies that package manifests state."""
    kinds = ["dependencies", "devDependencies", "peerDependencies"]
    rows = files.where(paths.base_name(F.col(path)) == "package.json")

    def stated(i: int, k: str) -> Column:
        entries = F.map_entries(F.from_json(F.get_json_object(text, f"$.{k}"), "map<string,string>"))
        return F.transform(entries, lambda e: F.struct(F.lit(i).alias("kind"), F.lit(k).alias("section"), e["key"].alias("name"), e["value"].alias("version")))

    maps = [stated(i, k) for i, k in enumerate(kinds)]
    none = F.array().cast("array<struct<kind:int,section:string,name:string,version:string>>")
    return rows.select(F.col(path).alias("package"), F.explode(F.concat(*[F.coalesce(m, none) for m in maps])).alias("d")).select("package", "d.kind", "d.section", "d.name", "d.version")


MARKS = [("workspace", ["pnpm-workspace.yaml", "lerna.json", "nx.json", "turbo.json"]), ("project", ["package.json", "pyproject.toml", "go.mod", "Cargo.toml", "pom.xml", "Gemfile", "composer.json"]), ("repository", [".git"])]


def projects(files: DataFrame, path: str = "path", depth: int = 4) -> DataFrame:
    """Folders up to ``depth`` deep that marks make a project, with the strongest kind of mark and all marks."""
    every = [m for _, ms in MARKS for m in ms]
    rows = files.select(F.regexp_replace(path, "/?[^/]*$", "").alias("root"), paths.base_name(F.col(path)).alias("mark")).where(F.col("mark").isin(every))
    rows = rows.where((F.col("root") == "") | (F.size(F.split("root", "/")) <= depth))
    kind = F.when(F.col("mark").isin(MARKS[0][1]), 0).when(F.col("mark").isin(MARKS[1][1]), 1).otherwise(2)
    best = rows.groupBy("root").agg(F.min(kind).alias("k"), F.array_sort(F.collect_set("mark")).alias("marks"))
    return best.select("root", F.element_at(F.array(*[F.lit(n) for n, _ in MARKS]), F.col("k") + 1).alias("kind"), "marks")


def containing_root(files: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """``path, root``: the deepest root that contains a path, joined on the path's own ancestors."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    rows = files.withColumn("__above", above).select(F.col(path).alias("path"), F.explode("__above").alias("root")).join(roots.select("root").distinct(), "root")
    return rows.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
