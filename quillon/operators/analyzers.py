"""From source text to symbols, imports, exports and framework facts.

Python is parsed by its own ``ast`` in a batch function. Other languages are read lexically, by regular expressions as
Column expressions: declared as such, and narrower than a syntax tree.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "kind string, name string, start int, end int, parent string"
# Lexical declarations: kind, pattern with the name as its group.
DECLARATIONS = [
    ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"),
    ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\*?|def|func|fn)\s+([A-Za-z_$][\w$]*)"),
    ("method", r"^\s+(?:public\s+|private\s+|protected\s+|static\s+|async\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)([A-Za-z_$][\w$]*)\s*\([^)]*\)\s*\{"),
]
# Facts of frameworks that regular expressions can see: framework, category, name, pattern.
RULES = [
    ("angular", "dependencyInjection", "inject() function", r"\binject\s*\("), ("angular", "dependencyInjection", "constructor injection", r"constructor\s*\([^)]*(?:private|public|protected)\s"),
    ("angular", "stateManagement", "Signals", r"\b(?:signal|computed|effect)\s*\("), ("angular", "stateManagement", "RxJS", r"BehaviorSubject|ReplaySubject|\bSubject\b"), ("angular", "componentStyle", "Standalone", r"standalone\s*:\s*true"),
    ("react", "hooks", "useState", r"\buseState\b"), ("react", "hooks", "useEffect", r"\buseEffect\b"), ("react", "hooks", "custom hook", r"function\s+use[A-Z]"), ("react", "context", "createContext", r"\bcreateContext\b"), ("react", "memoization", "memo", r"\b(?:useMemo|useCallback|memo)\s*\("),
    ("next", "rendering", "client component", r"^\s*['\"]use client['\"]"), ("next", "rendering", "server action", r"['\"]use server['\"]"), ("next", "data", "metadata", r"export\s+(?:const|async function)\s+(?:metadata|generateMetadata)"),
    ("nest", "components", "controller", r"@Controller\s*\("), ("nest", "components", "injectable", r"@Injectable\s*\("), ("nest", "components", "module", r"@Module\s*\("), ("nest", "validation", "class-validator", r"class-validator"), ("nest", "testing", "testing module", r"Test\.createTestingModule"),
]
# Test frameworks: kind, name, priority, marks; the highest priority that is present wins.
TESTING = [
    ("unit", "vitest", 3, ["from 'vitest'", 'from "vitest"', "vi.fn("]), ("unit", "jest", 2, ["@jest/globals", "jest.fn(", "jest.mock("]), ("unit", "jasmine", 1, ["jasmine.", "spyOn("]), ("unit", "pytest", 2, ["import pytest", "@pytest."]),
    ("e2e", "playwright", 3, ["@playwright/test"]), ("e2e", "cypress", 2, ["cy.visit(", "cy.get("]),
]


class Analyzer(Protocol):
    """What turns files into facts; the one with the highest priority that accepts a path takes it."""

    name: str
    priority: int

    def accepts(self, path: Column, text: Column) -> Column: ...


def chosen(path: Column, text: Column, analyzers: list[Analyzer]) -> Column:
    """The name of the analyzer for each file, null if none accepts it."""
    ordered = sorted(analyzers, key=lambda a: (-a.priority, a.name))
    return reduce(lambda chain, a: chain.when(a.accepts(path, text), a.name), ordered, F.when(F.lit(False), "")).otherwise(F.lit(None))


def lexical_symbols(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Declarations by line: ``key, kind, name, line``."""
    rows = files.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line", "body"))
    found = [F.when(F.col("body").rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract("body", p, 1).alias("name"))) for k, p in DECLARATIONS]
    return rows.select(key, (F.col("line") + 1).alias("line"), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("s")).select(key, "s.kind", "s.name", "line")


def _python(source: str) -> list[dict] | None:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out: list[dict] = []

    def visit(node: ast.AST, owner: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                out.append({"kind": kind, "name": child.name, "start": child.lineno, "end": child.end_lineno, "parent": owner})
                visit(child, child.name)
            else:
                visit(child, owner)

    visit(tree, None)
    return out


def python_symbols(files: DataFrame, key: str = "path", text: str = "text", most_bytes: int = 1 << 20) -> DataFrame:
    """Classes, functions and methods of Python files with their lines and owners; files that don't parse or are too large give none."""
    schema = f"{key} {dict(files.dtypes)[key]}, {SYMBOLS}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [{key: k} | s for k, t in zip(rows[key], rows[text]) for s in _python(t) or []]
            yield pd.DataFrame(out, columns=[key, "kind", "name", "start", "end", "parent"])

    return files.where((F.octet_length(text) <= most_bytes) & F.col(text).isNotNull()).select(key, text).mapInPandas(run, schema)


def _quoted(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 1)


IMPORT = r"""(?m)^[ \t]*import\s+(?:type\s+(?=[\w{*$]))?([^'";()]*?)\s*from\s*['"]([^'"\n]+)['"]|^[ \t]*import\s*['"]([^'"\n]+)['"]"""


def imports(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Import statements, over several lines too: ``key, line, source, names``; ``*`` and ``default`` name whole and default imports, others are names before ``as``."""
    rows = files.select(key, F.col(text).alias("__text"), F.regexp_extract_all(text, F.lit(IMPORT), 0).alias("found"))
    # Where each statement stands: at or after the end of the one before it.
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<statement:string,at:int>>").alias("out"))
    placed = F.aggregate("found", start, lambda acc, s: F.struct((F.call_function("locate", s, F.col("__text"), acc["at"]) + F.length(s)).alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("statement"), F.call_function("locate", s, F.col("__text"), acc["at"]).alias("at")))).alias("out")))
    rows = rows.where(F.size("found") > 0).select(key, "__text", F.explode(placed["out"]).alias("x"))
    s = F.col("x.statement")
    before = F.substring(F.col("__text"), F.lit(1), F.col("x.at") - 1 + F.length(s) - F.length(F.ltrim(s)))
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1
    source = F.when(F.regexp_extract(s, IMPORT, 2) != "", F.regexp_extract(s, IMPORT, 2)).otherwise(F.regexp_extract(s, IMPORT, 3))
    clause = F.regexp_replace(F.regexp_extract(s, IMPORT, 1), r"(?s)//[^\n]*|/\*.*?\*/", "")
    none = F.array().cast("array<string>")
    head = F.regexp_extract(clause, r"^\s*([A-Za-z_$][\w$]*)", 1)
    names = F.concat(F.when(head != "", F.array(F.lit("default"))).otherwise(none), F.when(clause.rlike(r"\*\s*as\s"), F.array(F.lit("*"))).otherwise(none), _listed(clause, 1))
    return rows.select(key, line.cast("int").alias("line"), source.alias("source"), names.alias("names"))


def _listed(clause: Column, side: int) -> Column:
    """The names in braces: of ``a as b`` the first (1) or the second (2)."""
    own = F.filter(F.transform(F.split(F.regexp_extract(clause, r"\{([^}]*)\}", 1), ","), lambda x: F.regexp_replace(F.btrim(x, F.lit(" \t\r\n")), r"^type\s+(?!as\s)", "")), lambda x: x != "")
    return F.transform(own, lambda x: F.btrim(F.regexp_replace(x, r"\s+as\s+.*$" if side == 1 else r"^.*\s+as\s+", ""), F.lit("'\"")))


DECLARED = r"(?m)^[ \t]*export\s+(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:const\s+enum|class|function\s*\*?|interface|enum|type|namespace|const|let|var)\s+([A-Za-z_$][\w$]*)"
LISTED = r"(?m)^[ \t]*export\s+(?:type\s+)?(\{[^}]*\})"
DEFAULT = r"(?m)^[ \t]*export\s+default\s+((?:(?:abstract\s+)?(?:async\s+)?(?:class|function)\b)?[^\n;]*)"


def exports(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """What files export: ``key, name, is_default``. A default is named if it is a plain identifier, else ``default``; of a list's ``a as b`` the second name counts."""
    bare = F.regexp_replace(text, r"(?s)/\*.*?\*/|(?m)^[ \t]*//[^\n]*", "")
    lists = F.flatten(F.transform(F.regexp_extract_all(bare, F.lit(LISTED), 1), lambda c: _listed(c, 2)))
    named = F.concat(F.regexp_extract_all(bare, F.lit(DECLARED), 1), lists)
    whole = F.transform(F.regexp_extract_all(bare, F.lit(DEFAULT), 1), lambda d: F.when(F.btrim(d, F.lit(" \t\r")).rlike(r"^(?!(?:class|function|async|abstract|new|null|true|false|this)$)[A-Za-z_$][\w$]*$"), F.btrim(d, F.lit(" \t\r"))).otherwise("default"))
    both = F.concat(F.transform(named, lambda n: F.struct(n.alias("name"), F.lit(False).alias("is_default"))), F.transform(whole, lambda n: F.struct(n.alias("name"), F.lit(True).alias("is_default"))))
    return files.where(F.col(text).isNotNull()).select(key, F.explode(both).alias("x")).select(key, "x.name", "x.is_default")


def reexports(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """``export … from`` statements: ``key, source``."""
    return files.select(key, F.explode(_quoted(F.col(text), r"""(?m)^[ \t]*export\s+(?:type\s+)?(?:\*(?:\s+as\s+\w+)?|\{[^}]*\})\s*from\s*['"]([^'"]+)['"]""")).alias("source"))


SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", ".py", "/index.ts", "/index.js", "/__init__.py"]


def resolved(found: DataFrame, files: DataFrame, aliases: DataFrame | None = None, key: str = "path") -> DataFrame:
    """``found(key, source)`` with ``target`` and ``outcome``: resolved, external, outside-root or not-found.

    Candidates are the joined path with each suffix; the first that is a file wins. An alias ``(prefix, replacement)`` with the
    longest fitting prefix is applied first. The alias table is a project's configuration and is broadcast when Spark finds it small.
    """
    rows = found.select(key, "source").distinct()
    if aliases is not None:
        hit = rows.join(aliases, F.col("source").startswith(F.col("prefix"))).groupBy(key, "source").agg(F.max_by(F.struct("prefix", "replacement"), F.length("prefix")).alias("a"))
        rows = rows.join(hit, [key, "source"], "left").withColumn("spec", F.when(F.col("a").isNotNull(), F.concat(F.lit("/"), F.col("a.replacement"), F.substring("source", F.length("a.prefix") + 1, F.length("source")))).otherwise(F.col("source"))).drop("a")
    else:
        rows = rows.withColumn("spec", F.col("source"))
    folder = F.regexp_replace(key, "[^/]*$", "")
    joined = F.when(F.col("spec").startswith("."), F.concat(folder, "spec")).when(F.col("spec").startswith("/"), F.substring("spec", 2, 4096))
    parts = F.filter(F.split(joined, "/"), lambda s: (s != ".") & (s != ""))
    # ``..`` takes the segment before it away; too many leave the root.
    folded = F.aggregate(parts, F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok")), lambda acc, s: F.when(s == "..", F.struct(F.slice(acc["p"], 1, F.greatest(F.size(acc["p"]) - 1, F.lit(0))).alias("p"), (acc["ok"] & (F.size(acc["p"]) > 0)).alias("ok"))).otherwise(F.struct(F.concat(acc["p"], F.array(s)).alias("p"), acc["ok"].alias("ok"))))
    rows = rows.withColumn("f", F.when(joined.isNotNull(), folded))
    tried = rows.where("f.ok").select(key, "source", F.posexplode(F.transform(F.array(*map(F.lit, SUFFIXES)), lambda s: F.concat(F.array_join("f.p", "/"), s))).alias("n", "candidate"))
    hit = tried.join(files.select(F.col(key).alias("candidate")), "candidate").groupBy(key, "source").agg(F.min_by("candidate", "n").alias("target"))
    out = rows.join(hit, [key, "source"], "left")
    return out.select(key, "source", "target", F.when(F.col("f").isNull(), "external").when(~F.col("f.ok"), "outside-root").when(F.col("target").isNotNull(), "resolved").otherwise("not-found").alias("outcome"))


def framework_facts(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """``key, framework, category, name`` of every rule that fits a file's text."""
    facts = [F.when(F.col(text).rlike("(?m)" + p), F.struct(F.lit(f).alias("framework"), F.lit(c).alias("category"), F.lit(n).alias("name"))) for f, c, n, p in RULES]
    return files.select(key, F.explode(F.filter(F.array(*facts), lambda x: x.isNotNull())).alias("x")).select(key, "x.*")


def test_frameworks(files: DataFrame, key: str = "path", text: str = "text", table: list[tuple[str, str, int, list[str]]] | None = None) -> DataFrame:
    """``key, kind, framework`` of test files: of each kind the one with the highest priority. ``table`` takes the place of :data:`TESTING`."""
    found = [F.when(reduce(Column.__or__, [F.contains(text, F.lit(m)) for m in marks]), F.struct(F.lit(k).alias("kind"), F.lit(p).alias("priority"), F.lit(n).alias("framework"))) for k, n, p, marks in table or TESTING]
    rows = files.select(key, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x"))
    return rows.groupBy(key, "x.kind").agg(F.max_by("x.framework", "x.priority").alias("framework"))


def class_facts(text: Column) -> Column:
    """Of a class's text: decorators, lifecycle hooks, injected services, inputs and outputs."""
    return F.struct(
        F.array_distinct(_quoted(text, r"@([A-Z]\w*)\s*\(")).alias("decorators"), F.array_distinct(_quoted(text, r"\b(ng(?:OnInit|OnDestroy|OnChanges|AfterViewInit|DoCheck))\s*\(")).alias("hooks"),
        F.array_distinct(F.concat(_quoted(text, r"\binject\s*(?:<[^>]*>)?\(\s*([A-Za-z_]\w*)"), _quoted(text, r"(?:private|public|protected)\s+(?:readonly\s+)?\w+\s*:\s*([A-Z]\w*)"))).alias("services"),
        F.array_distinct(_quoted(text, r"@Input\([^)]*\)\s*(\w+)")).alias("inputs"), F.array_distinct(_quoted(text, r"@Output\([^)]*\)\s*(\w+)")).alias("outputs"),
    )


def framework_claims(facts: DataFrame, least: int = 3) -> DataFrame:
    """Frameworks that at least ``least`` distinct facts speak for, most first."""
    return facts.groupBy("framework").agg(F.countDistinct("category", "name").alias("facts"), F.countDistinct("path").alias("files")).where(F.col("facts") >= least).orderBy(F.desc("facts"), "framework")


def controller_routes(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Routes that decorated controllers serve: ``key, verb, route``."""
    base = F.regexp_extract(text, r"""@Controller\(\s*['"]?([^'")]*)['"]?\s*\)""", 1)
    hit = F.regexp_extract_all(text, F.lit(r"""(@(?:Get|Post|Put|Patch|Delete)\(\s*['"]?[^'")]*['"]?\s*\))"""), 1)
    rows = files.where(F.contains(text, F.lit("@Controller("))).select(key, base.alias("base"), F.explode(hit).alias("d"))
    own = F.regexp_extract("d", r"""\(\s*['"]?([^'")]*)""", 1)
    whole = F.array_join(F.filter(F.split(F.concat_ws("/", "base", own), "/"), lambda s: s != ""), "/")
    return rows.select(key, F.upper(F.regexp_extract("d", "@(\\w+)", 1)).alias("verb"), F.concat(F.lit("/"), whole).alias("route"))
