"""Scalar functions over file paths: language, kind, layer, eligibility, routes, dependency categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The language of a file extension.
LANGUAGES = {
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascriptreact", ".ts": "typescript", ".tsx": "typescriptreact", ".mts": "typescript", ".cts": "typescript",
    ".html": "html", ".htm": "html", ".css": "css", ".scss": "scss", ".sass": "sass", ".less": "less",
    ".json": "json", ".jsonc": "jsonc", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".xml": "xml", ".md": "markdown", ".mdx": "mdx",
    ".graphql": "graphql", ".gql": "graphql", ".sql": "sql", ".sh": "shellscript", ".bash": "shellscript", ".zsh": "shellscript", ".ps1": "powershell",
    ".py": "python", ".pyi": "python", ".rb": "ruby", ".php": "php", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".go": "go", ".rs": "rust", ".cs": "csharp", ".swift": "swift", ".scala": "scala",
    ".c": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".h": "c", ".hpp": "cpp",
}
BINARY = [".png", ".jpg", ".jpeg", ".gif", ".ico", ".webp", ".pdf", ".zip", ".tar", ".gz", ".woff", ".woff2", ".ttf", ".eot", ".mp3", ".mp4", ".exe", ".dll", ".so", ".dylib"]
NOT_CODE = {"markdown", "mdx", "json", "jsonc", "yaml", "toml", "xml"}
# Names of documentation files.
GUIDES = ["readme.md", "contributing.md", "changelog.md", "license.md", "style_guide.md", "style-guide.md", "architecture.md"]
STYLES = [".html", ".scss", ".css", ".less", ".sass", ".styl"]
# Paths that a bounded map leaves out.
EXCLUDED_PATHS = [
    r"(?:^|/)(?:tests?|__tests__|specs?|__specs__)(?:/|$)", r"\.(?:test|spec)\.[^/]+$", r"(?:^|/)(?:fixtures?|__fixtures__)(?:/|$)",
    r"(?:^|/)(?:generated|__generated__)(?:/|$)", r"(?:^|/)[^/]*\.(?:generated|gen|min)\.[^/]+$", r"(?:^|/)raw(?:/|$)", r"(?:^|/)live-from-ai(?:/|$)", r"\.snap$",
]
EXCLUDED_DIRECTORIES = ["node_modules", "dist", "build", "coverage", ".git", "vendor", "__fixtures__", "__generated__", "fixtures", "generated"]
# The category of a library, and of a scope of libraries.
LIBRARIES = {
    "framework": ["react", "vue", "angular", "svelte", "next", "nuxt"],
    "ui": ["tailwindcss", "@mui/material", "styled-components", "@emotion/react", "framer-motion", "lucide-react", "@radix-ui/react-slot", "class-variance-authority", "clsx", "tailwind-merge", "react-hook-form", "formik"],
    "state": ["redux", "@reduxjs/toolkit", "zustand", "jotai", "recoil", "mobx", "@tanstack/react-query", "swr"],
    "utility": ["zod", "yup", "valibot"],
    "testing": ["jest", "vitest", "cypress", "@playwright/test", "@testing-library/react"],
    "build": ["typescript", "vite", "webpack", "esbuild", "eslint", "prettier", "nx", "turbo"],
}
SCOPES = {"@angular/": "framework", "@nestjs/": "other", "@nx/": "build", "@nrwl/": "build", "@types/": "build"}
# The layer that a directory or suffix stands for, first match first.
LAYERS = [("core", r"(^|/)(core|config)/"), ("state", r"(^|/)(store|state)/|\.(store|reducer|effects)\."), ("data", r"(^|/)(data|services?|api|repositor(y|ies))/|\.(service|repository)\."), ("presentation", r"(^|/)(components?|pages?|views?|ui)/|\.(component|page)\.|\.html$"), ("shared", r"(^|/)(shared|common|models)/")]


def any_of(tests: list[Column]) -> Column:
    return reduce(Column.__or__, tests)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The last extension of the base name, lower-cased, with its dot; empty without one."""
    return F.regexp_extract(F.lower(base_name(path)), r"[^.](\.[^.]*)$", 1)


def normalized(path: Column) -> Column:
    return F.btrim(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", ""))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("plaintext"))


def is_code(path: Column, more: tuple[str, ...] = ()) -> Column:
    return extension(path).isin([e for e, n in LANGUAGES.items() if n not in NOT_CODE] + ["." + e.strip().lower().lstrip(".") for e in more if e.strip()])


def is_binary(path: Column) -> Column:
    return extension(path).isin(BINARY)


def is_test(path: Column) -> Column:
    low = F.lower(path)
    return any_of([F.contains(low, F.lit(x)) for x in (".spec.", ".test.", "__tests__", "/test/", "/tests/")])


def is_documentation(path: Column) -> Column:
    low = F.lower(path)
    return base_name(low).isin(GUIDES) | F.contains(low, F.lit("/docs/"))


def is_style(path: Column) -> Column:
    return extension(path).isin(STYLES)


def is_composition_root(path: Column) -> Column:
    low = F.lower(normalized(path))
    return base_name(low).rlike(r"^(main|index|bootstrap|startup)\.") | any_of([F.contains(low, F.lit(x)) for x in ("/routes", "/routing", "/router", "/config", "/providers")])


def is_definition_heavy(path: Column, kind: Column) -> Column:
    low = F.lower(normalized(path))
    return F.coalesce(F.lower(kind).isin("type", "interface", "enum", "constant"), F.lit(False)) | any_of([F.contains(low, F.lit(x)) for x in ("/models/", "/interfaces/", "/types/", "/constants")])


def layer(path: Column) -> Column:
    low = F.lower(path)
    return reduce(lambda chain, rule: chain.when(low.rlike(rule[1]), rule[0]), LAYERS, F.when(F.lit(False), "")).otherwise("unknown")


def is_map_eligible(path: Column) -> Column:
    clean = normalized(path)
    inside = F.exists(F.split(F.lower(clean), "/"), lambda s: s.isin(EXCLUDED_DIRECTORIES))
    hashed = clean.rlike(r"(?i)[^/]+-(?=[A-Za-z0-9]*[0-9])[A-Za-z0-9]{6,}\.(?:js|css|mjs|cjs)$")
    return (clean != "") & ~inside & ~hashed & ~any_of([clean.rlike("(?i)" + p) for p in EXCLUDED_PATHS])


def dependency_category(name: Column) -> Column:
    chain = F.when(F.lit(False), "")
    for category, names in LIBRARIES.items():
        chain = chain.when(name.isin(names), category)
    for prefix, category in SCOPES.items():
        chain = chain.when(name.startswith(prefix), category)
    return chain.otherwise("other")


def path_strength(path: Column, query: Column) -> Column:
    """2 if the query names the path's base name or the path itself, 1 if it names the base name without its extension, else 0."""
    low, base = F.lower(query), F.lower(base_name(path))
    return F.when(F.contains(low, F.lower(path)) | F.contains(low, base), 2).when(F.contains(low, F.regexp_replace(base, r"\.[^.]*$", "")), 1).otherwise(0)


def tail(path: Column, k: int) -> Column:
    """The last k segments of a path."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - k + 1, F.lit(1)), k), "/")


def route(path: Column, root: str = "app") -> Column:
    """The route that a page file under ``root`` serves: groups ``(x)`` and slots ``@x`` are no part of it, nor is the file's name; null for other files."""
    parts = F.split(F.regexp_extract(path, rf"(?:^|/){root}/(.*)$", 1), "/")
    kept = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: ~s.rlike(r"^\(.*\)$") & ~s.startswith("@") & (s != "index") & (s != ""))
    return F.when(F.lower(base_name(path)).rlike(r"^(page|route|layout)\.[jt]sx?$"), F.concat(F.lit("/"), F.array_join(kept, "/")))


def redacted(path: Column, digits: int = 8) -> Column:
    return F.concat(F.lit("path:"), F.substring(F.sha1(path), 1, digits))
