"""What files say of their frameworks: who analyses a file, components and hooks, decorated classes, claims of a project, summaries, snippets.

Everything is a Column expression over whole texts, read lexically by regular expressions: narrower than a syntax tree. Declarations are seen at
the beginning of a line; comments don't count. A null text is an empty one; a file that declares nothing gives no row, or empty lists.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import paths

# Hooks that come with React; lifecycle hooks of decorated classes; keys of a module's metadata.
HOOKS = [
    "useState", "useEffect", "useMemo", "useCallback", "useReducer", "useRef", "useContext", "useLayoutEffect", "useImperativeHandle", "useDebugValue", "useDeferredValue",
    "useTransition", "useId", "useSyncExternalStore", "useInsertionEffect", "useActionState", "useOptimistic", "useFormStatus",
]
LIFECYCLE = ["ngOnChanges", "ngOnInit", "ngDoCheck", "ngAfterContentInit", "ngAfterContentChecked", "ngAfterViewInit", "ngAfterViewChecked", "ngOnDestroy"]
MODULE_KEYS = ["imports", "declarations", "controllers", "providers", "exports"]
# Which libraries of a project's dependencies are named, by framework and use.
REACT_LIBRARIES = {
    "state": [("@reduxjs/toolkit", "redux"), ("redux", "redux"), ("zustand", "zustand"), ("jotai", "jotai"), ("recoil", "recoil"), ("mobx", "mobx")],
    "ui": [("tailwindcss", "Tailwind"), ("@mui/material", "MUI"), ("styled-components", "styled-components"), ("@radix-ui/react-slot", "Radix UI")],
    "testing": [("vitest", "Vitest"), ("jest", "Jest"), ("@testing-library/react", "Testing Library"), ("playwright", "Playwright"), ("cypress", "Cypress")],
}
ANGULAR_LIBRARIES = {
    "state": [("@ngrx/store", "ngrx"), ("@datorama/akita", "akita"), ("@ngneat/elf", "elf")],
    "ui": [("@angular/material", "Angular Material"), ("primeng", "PrimeNG"), ("@ng-bootstrap/ng-bootstrap", "ng-bootstrap")],
    "testing": [("jasmine-core", "Jasmine"), ("karma", "Karma"), ("jest", "Jest")],
}
NEST_LIBRARIES = {"state": [], "ui": [], "testing": [("@nestjs/testing", "Nest Testing"), ("vitest", "Vitest"), ("jest", "Jest")]}
# Framework, dependencies of which one makes the claim, further dependencies and places that speak for it.
CLAIMS = [
    ("nestjs", ["@nestjs/core", "@nestjs/common"], r"^@nestjs/", [("nest-cli-json", r"^nest-cli\.json$"), ("main-ts", r"^(src/)?main\.ts$")], NEST_LIBRARIES),
    ("angular", ["@angular/core"], r"^@angular/(core|common|compiler-cli|cli)$", [("angular-json", r"^angular\.json$"), ("tsconfig-app", r"^tsconfig\.app\.json$"), ("ng-package-json", r"^ng-package\.json$")], ANGULAR_LIBRARIES),
    ("nextjs", ["next"], r"^(next|react|react-dom)$", [("app-router", r"^(src/)?app/"), ("pages-router", r"^(src/)?pages/"), ("next-config", r"^next\.config\.(js|ts|mjs|cjs)$")], REACT_LIBRARIES),
    ("react", ["react"], r"^(react|react-dom|@types/react|react-native)$", [("src-directory", r"^src/"), ("public-index-html", r"^public/index\.html$")], REACT_LIBRARIES),
]
# What a snippet of a pattern is found by.
SNIPPETS = {
    ("dependencyInjection", "inject() function"): r"\binject\s*[<(]",
    ("dependencyInjection", "Constructor injection"): r"constructor\s*\(",
    ("stateManagement", "RxJS"): r"BehaviorSubject|ReplaySubject|Subject|Observable",
    ("stateManagement", "Signals"): r"\bsignal\s*[<(]",
    ("reactivity", "Effect"): r"\beffect\s*\(",
    ("reactivity", "Computed"): r"\bcomputed\s*[<(]",
    ("componentStyle", "Standalone"): r"standalone\s*:\s*true",
    ("componentStyle", "NgModule-based"): r"@(?:Component|Directive|Pipe)\s*\(",
    ("componentInputs", "Signal-based inputs"): r"\binput\s*[<(]",
    ("componentInputs", "Decorator-based @Input"): r"@Input\(\)",
}


def _none() -> Column:
    return F.array().cast("array<string>")


def bare(text: Column) -> Column:
    """A text without block comments and without lines that are comments."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)/\*.*?\*/|(?m)^[ \t]*//[^\n]*", "")


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


# ------------------------------------------------------------------ who analyses a file

SCRIPTS = (".ts", ".js", ".mjs", ".cjs", ".mts", ".cts")
VIEWS = (".html", ".scss", ".css", ".sass", ".less")


@dataclass(frozen=True)
class FrameworkAnalyzer:
    """An :class:`~quillon.operators.analyzers.Analyzer` of files with one of some extensions that pass a test."""

    name: str
    priority: int
    extensions: tuple[str, ...]
    test: Callable[[Column, Column], Column]

    def accepts(self, path: Column, text: Column) -> Column:
        return F.coalesce(paths.extension(path).isin(*self.extensions) & self.test(path, text), F.lit(False))


@dataclass(frozen=True)
class FallbackAnalyzer:
    """Takes every file of a language that is known, after all others."""

    name: str = "generic"
    priority: int = 10

    def accepts(self, path: Column, text: Column) -> Column:
        return F.coalesce(paths.is_code(path), F.lit(False))


def _angular(path: Column, text: Column) -> Column:
    imported = bare(text).rlike(r"""(?m)^\s*import\s+(?:[^'";()]*?\sfrom\s*)?['"]@angular/""")
    return paths.extension(path).isin(*VIEWS) | ((paths.extension(path) == ".ts") & imported)


def _next(path: Column, text: Column) -> Column:
    placed = F.concat(F.lit("/"), paths.normalized(path)).rlike(r"/(?:app|pages)/|/proxy\.(?:js|jsx|ts|tsx|mjs|cjs|mts|cts)$")
    return placed | F.coalesce(text.rlike(r"""\bfrom\s+['"]next['"/]"""), F.lit(False))


def _react(path: Column, text: Column) -> Column:
    end = paths.extension(path)
    marked = text.rlike(r"""\bfrom\s+['"]react['"]|\brequire\(\s*['"]react['"]\s*\)|\bReact\.createElement\b""")
    return end.isin(".tsx", ".jsx") | F.coalesce(marked | (~end.isin(".ts", ".mts", ".cts") & text.rlike(r"<[A-Za-z][^>]*>")), F.lit(False))


def framework_analyzers() -> list:
    """The analyzers, for :func:`~quillon.operators.analyzers.chosen`; a project adds its own."""
    return [
        FrameworkAnalyzer("nestjs", 105, SCRIPTS, lambda p, t: t.rlike(r"""\bfrom\s+['"]@nestjs/|\bNestFactory\b""")),
        FrameworkAnalyzer("angular", 100, (".ts", ".js", *VIEWS), _angular),
        FrameworkAnalyzer("nextjs", 90, (".tsx", ".jsx", *SCRIPTS), _next),
        FrameworkAnalyzer("react", 80, (".tsx", ".jsx", *SCRIPTS), _react),
        FallbackAnalyzer(),
    ]


# ------------------------------------------------------------------ components and hooks

DECLARATION = r"(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var)\s"
MARKUP = r"(?m)(?:return|=>|[(?:&|{,]|^)\s*<(?:[A-Za-z][\w.:-]*(?:\s|/?>)|>)"


def react_components(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """``key, name, kind`` of hooks (``use`` and a capital or digit), function components (a capital, with markup in what is declared) and class components.

    What is declared reaches from its line to the next declaration at a line's beginning. Repeated names of a kind count once.
    """
    parts = files.select(key, F.explode(F.split(bare(F.col(text)), rf"(?m)^(?={DECLARATION})", -1)).alias("part"))
    function = F.regexp_extract("part", r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)", 1)
    variable = F.regexp_extract("part", r"^(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=\n]*)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=\n]*)?=>|[A-Za-z_$][\w$]*\s*=>)", 1)
    owner = F.regexp_extract("part", r"^(?:export\s+)?(?:default\s+)?class\s+([A-Za-z_$][\w$]*)\s+extends\s+(?:React\s*\.\s*)?(?:Pure)?Component\b", 1)
    name = F.when(function != "", function).when(variable != "", variable).otherwise(owner)
    kind = F.when(owner != "", "class-component").when(name.rlike("^use[A-Z0-9]"), "custom-hook").when(name.rlike("^[A-Z]") & F.col("part").rlike(MARKUP), "function-component")
    return parts.select(key, name.alias("name"), kind.alias("kind")).where("kind is not null").distinct()


def react_facts(text: Column) -> Column:
    """Of a file's text: built-in hooks that are called, sorted, and whether it uses context, memoization, suspense, actions, optimistic state and form status."""
    code = bare(text)
    called = _all(code, r"\b(" + "|".join([*HOOKS, "createContext", "memo", "lazy"]) + r")\s*(?:<[^()\n]*>)?\(")
    # ``use`` is a hook under the name that it is imported by.
    own = F.regexp_extract(code, r"""import\s[^'";()]*\{[^}]*?\buse(?:\s+as\s+([A-Za-z_$][\w$]*))?\s*[,}][^'";()]*from\s*['"]react['"]""", 1)
    imported = code.rlike(r"""import\s[^'";()]*\{[^}]*?\buse(?:\s+as\s+[A-Za-z_$][\w$]*)?\s*[,}][^'";()]*from\s*['"]react['"]""")
    bound = F.when(imported, F.when(own == "", "use").otherwise(own))
    awaited = F.coalesce(F.regexp_like(code, F.concat(F.lit(r"(?<![\w$.])\Q"), bound, F.lit(r"\E\s*(?:<[^()\n]*>)?\("))), F.lit(False))

    def calls(*names: str) -> Column:
        return F.arrays_overlap(called, F.array(*map(F.lit, names)))

    hooks = F.concat(F.filter(called, lambda h: h.isin(*HOOKS)), F.when(awaited, F.array(bound)).otherwise(_none()))
    return F.struct(
        F.array_sort(F.array_distinct(hooks)).alias("hooks"), (calls("createContext", "useContext") | code.rlike(r"<[A-Za-z][\w.]*\.(?:Provider|Consumer)\b")).alias("context"),
        calls("memo", "useMemo", "useCallback").alias("memoization"), (calls("lazy") | awaited | code.rlike(r"<(?:React\.)?Suspense\b")).alias("suspense"),
        calls("useActionState").alias("actions"), calls("useOptimistic").alias("optimistic"), calls("useFormStatus").alias("form_status"),
    )


# ------------------------------------------------------------------ decorated classes

ARGUMENTS = r"\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\)"
HEAD = r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s"
CLASS = rf"(?ms)^(?:@\w+[ \t]*(?:{ARGUMENTS})?\s*)*+{HEAD}\s*\w+.*?(?=^@\w|^{HEAD}|\z)"


def _metadata(head: Column, key: str) -> Column:
    value = F.regexp_extract(head, rf"""\b{key}\s*:\s*(?:['"`]([^'"`]*)['"`]|([\w$]+))""", 1)
    return F.when(value != "", value).otherwise(F.nullif(F.regexp_extract(head, rf"""\b{key}\s*:\s*([\w$]+)""", 1), F.lit("")))


def _names(head: Column, key: str) -> Column:
    return _all(F.regexp_extract(head, rf"\b{key}\s*:\s*\[([^\]]*)\]", 1), r"\b([A-Z][\w$]*)")


def decorated_classes(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """One row a class with decorators: ``key, name, decorators, kind, nest_kind, nest_layer, selector, provided_in, standalone, hooks, services, tokens, inputs, outputs`` and the lists of a module.

    ``kind`` follows the first decorator, of ``Injectable`` what the class implements; ``nest_kind`` and ``nest_layer`` follow decorators in a fixed order, then the
    name's ending. ``services`` are types of constructor parameters in their order, ``tokens`` are sorted and take an ``Inject`` argument before a type.
    """
    parts = files.select(key, F.explode(_all(bare(F.col(text)), CLASS, 0)).alias("part")).where(F.col("part").startswith("@"))
    at = F.regexp_instr("part", F.lit(r"(?m)^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+\w"))
    rows = parts.select(key, "part", F.substring(F.col("part"), F.lit(1), at - 1).alias("head"), F.substring(F.col("part"), at, F.length("part")).alias("body"))
    rows = rows.select("*", F.regexp_extract("body", r"class\s+([A-Za-z_$][\w$]*)", 1).alias("name"), F.array_distinct(_all(F.col("head"), r"(?m)^@(\w+)")).alias("decorators"))
    first, body, head = F.get("decorators", F.lit(0)), F.col("body"), F.col("head")
    made = [("guard", r"implements\s+(?:CanActivate|CanDeactivate|CanLoad|CanMatch)|can(?:Activate|Deactivate|Load|Match)\s*\(|Can(?:Activate|Deactivate|Match)Fn"), ("interceptor", r"implements\s+HttpInterceptor|intercept\s*\(|HttpInterceptorFn"),
            ("resolver", r"implements\s+Resolve|resolve\s*\(|ResolveFn"), ("validator", r"implements\s+(?:Validator|AsyncValidator)|validate\s*\(")]
    by_body = reduce(lambda chain, m: chain.when(body.rlike(m[1]), m[0]), made, F.when(F.lit(False), ""))
    named = {"Component": "component", "Directive": "directive", "Pipe": "pipe", "NgModule": "module"}
    kind = reduce(lambda chain, n: chain.when(first == n[0], n[1]), named.items(), F.when(F.lit(False), "")).when(first == "Injectable", F.coalesce(by_body, F.lit("service"))).otherwise(by_body)
    order = [("Module", "module"), ("Controller", "controller"), ("WebSocketGateway", "gateway"), ("Resolver", "resolver"), ("Processor", "processor"), ("Schema", "schema"), ("Catch", "filter")]
    endings = [("Repository", "repository"), ("Guard", "guard"), ("Interceptor", "interceptor"), ("Pipe", "pipe"), ("Filter", "filter"), ("Service", "service")]
    by_end = reduce(lambda chain, e: chain.when(F.col("name").endswith(e[0]), e[1]), endings, F.when(F.lit(False), "")).otherwise("provider")
    nest = reduce(lambda chain, o: chain.when(F.array_contains("decorators", o[0]), o[1]), order, F.when(F.lit(False), "")).when(F.array_contains("decorators", "Injectable"), by_end)
    layers = {"controller": "presentation", "resolver": "presentation", "service": "business", "repository": "data", "schema": "data", "module": "feature", "gateway": "infrastructure", "processor": "infrastructure"}
    parameters = F.split(F.regexp_extract(body, rf"constructor\s*({ARGUMENTS})", 1), r",(?![^(<]*[)>],?)")
    typed = F.transform(parameters, lambda p: F.regexp_extract(p, r":\s*([A-Za-z_$][\w$]*)", 1))
    tokens = F.transform(parameters, lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"""@Inject\(\s*['"`]?([\w.$]+)""", 1), F.lit("")), F.regexp_extract(p, r":\s*([A-Za-z_$][\w$]*)", 1)))
    filled = lambda c: F.filter(c, lambda x: x != "")
    lead = r"(?m)^\s*(?:(?:public|protected|private|readonly|override)\s+)*+"
    inputs = F.concat(_all(body, r"@Input\([^)]*\)\s*(?:(?:public|readonly|override)\s+)*([A-Za-z_$][\w$]*)"), _all(body, lead + r"([A-Za-z_$][\w$]*)\s*=\s*input(?:\s*\.\s*required)?\s*[<(]"))
    outputs = F.concat(_all(body, r"@Output\([^)]*\)\s*(?:(?:public|readonly|override)\s+)*([A-Za-z_$][\w$]*)"), _all(body, lead + r"([A-Za-z_$][\w$]*)\s*=\s*output\s*[<(]"))
    rows = rows.withColumn("nest_kind", nest)
    layer = F.when(F.col("nest_kind").isNotNull(), reduce(lambda chain, x: chain.when(F.col("nest_kind") == x[0], x[1]), layers.items(), F.when(F.lit(False), "")).otherwise("core"))
    return rows.select(
        key, "name", "decorators", kind.alias("kind"), "nest_kind", layer.alias("nest_layer"), _metadata(head, "selector").alias("selector"), _metadata(head, "providedIn").alias("provided_in"),
        head.rlike(r"\bstandalone\s*:\s*true").alias("standalone"), F.array_distinct(_all(body, r"(?m)^\s+(?:(?:public|async)\s+)*+(" + "|".join(LIFECYCLE) + r")\s*\(")).alias("hooks"),
        filled(typed).alias("services"), F.array_sort(F.array_distinct(filled(tokens))).alias("tokens"), F.array_distinct(inputs).alias("inputs"), F.array_distinct(outputs).alias("outputs"),
        *[_names(head, k).alias(f"module_{k}") for k in MODULE_KEYS],
    )


# ------------------------------------------------------------------ claims of projects


def project_claims(dependencies: DataFrame, files: DataFrame) -> DataFrame:
    """``project, framework, version, indicators, state, ui, testing`` from ``dependencies(project, name, version)`` and ``files(project, path)``, paths within the project.

    A framework is claimed where one of its packages is a dependency; versions lose ``^`` and ``~``; of repeated dependencies the smallest version counts. Indicators and lists
    are sorted. Only names that some rule knows are gathered, so a project's row stays small whatever it depends on.
    """
    uses = sorted({n for *_, libraries in CLAIMS for named in libraries.values() for n, _ in named})
    known = dependencies.where(reduce(Column.__or__, [F.col("name").rlike(p) for _, _, p, _, _ in CLAIMS]) | F.col("name").isin(*uses))
    one = known.groupBy("project", "name").agg(F.coalesce(F.min("version"), F.lit("")).alias("version"))
    held = one.groupBy("project").agg(F.map_from_entries(F.collect_list(F.struct("name", "version"))).alias("held"))
    marks = [F.when(F.col("path").rlike(p), F.lit(f"{f}/disk:{n}")) for f, _, _, places, _ in CLAIMS for n, p in places]
    seen = files.select("project", F.explode(F.filter(F.array(*marks), lambda x: x.isNotNull())).alias("mark")).groupBy("project").agg(F.collect_set("mark").alias("marks"))
    rows = held.join(seen, "project", "left").withColumn("marks", F.coalesce("marks", _none()))

    def listed(named: list[tuple[str, str]]) -> Column:
        if not named:
            return _none()
        return F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.map_contains_key("held", n), F.lit(as_)) for n, as_ in named]), lambda x: x.isNotNull())))

    def claim(name: str, packages: list[str], pattern: str, libraries: dict) -> Column:
        version = F.coalesce(*[F.try_element_at("held", F.lit(p)) for p in packages])
        own = F.transform(F.filter(F.map_keys("held"), lambda d: d.rlike(pattern)), lambda d: F.concat(F.lit("dep:"), d))
        disk = F.transform(F.filter("marks", lambda m: m.startswith(name + "/")), lambda m: F.substring(m, F.lit(len(name) + 2), F.length(m)))
        cells = [F.lit(name).alias("framework"), F.regexp_replace(version, r"^[\^~]", "").alias("version"), F.array_sort(F.concat(own, disk)).alias("indicators")]
        return F.when(version.isNotNull(), F.struct(*cells, *[listed(libraries[u]).alias(u) for u in ("state", "ui", "testing")]))

    claims = F.array(*[claim(n, p, d, libraries) for n, p, d, _, libraries in CLAIMS])
    return rows.select("project", F.explode(F.filter(claims, lambda c: c.isNotNull())).alias("c")).select("project", "c.*")


# ------------------------------------------------------------------ summaries and snippets


def summary(language: Column, kind: Column, path: Column, content: Column) -> Column:
    """One line on a chunk: its first documentation comment, or its class, or its function, or its first line that isn't an import or a comment."""
    base, text = paths.base_name(path), F.coalesce(content, F.lit(""))
    head = F.concat(language, F.lit(" "), F.coalesce(F.nullif(kind, F.lit("")), F.lit("code")), F.lit(" in "), base)
    said = F.btrim(F.regexp_extract(text, r"/\*\*\s*\n?\s*\*\s*(.+?)(?:\n|\*/)", 1), F.lit(" \t\r"))
    of_class, of_function = r"(class|struct|interface|trait)\s+(\w+)", r"(function|fn|func|def|method)\s+(\w+)"

    def declared(p: str) -> Column:
        return F.concat(language, F.lit(" "), F.regexp_extract(text, p, 1), F.lit(" '"), F.regexp_extract(text, p, 2), F.lit("' in "), base, F.lit("."))

    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: (x != "") & ~x.startswith("import") & ~x.startswith("//"))
    rest = F.concat(language, F.lit(" code in "), base, F.lit(": "), F.coalesce(F.concat(F.substring(F.get(lines, F.lit(0)), 1, 60), F.lit("...")), F.lit("code definition")))
    return F.when(text == "", head).when(said != "", F.concat(head, F.lit(": "), said)).when(text.rlike(of_class), declared(of_class)).when(text.rlike(of_function), declared(of_function)).otherwise(rest)


def class_summary(rows: DataFrame, text: str = "content", path: str = "path") -> DataFrame:
    """``rows(kind, selector, provided_in, inputs, outputs, module_imports, …)`` with ``summary``, one sentence on a decorated class; kinds without a sentence of their own get what the text uses."""
    t, base = F.coalesce(F.col(text), F.lit("")), paths.base_name(F.col(path))
    found = F.regexp_extract(t, r"(?:export\s+)?class\s+(\w+)", 1)
    name = F.when(found != "", found).otherwise(base)
    q = F.concat(F.lit("'"), name, F.lit("'"))
    unknown = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    counted = lambda c, what: F.when(F.size(c) > 0, F.concat(F.lit(", "), F.size(c).cast("string"), F.lit(what))).otherwise("")
    # Hooks that a sentence names, in this order.
    told = F.filter(F.array(*map(F.lit, ["ngOnInit", "ngOnChanges", "ngOnDestroy", "ngAfterViewInit", "ngAfterContentInit"])), lambda h: F.contains(t, h))
    methods = F.slice(_all(t, r"public\s+(\w+)\s*\("), 1, 3)
    guard = reduce(lambda chain, g: chain.when(F.contains(t, F.lit(g)), g), ["CanActivate", "CanDeactivate", "CanLoad", "CanMatch"], F.when(F.lit(False), "")).otherwise("route")
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    number = lambda c: F.greatest(F.size(c), F.lit(0)).cast("string")
    exported = F.regexp_extract(t, r"export\s+(?:const|function|class|interface|type|enum)\s+(\w+)", 1)
    plain = F.when(t.rlike(r"(?:signal|computed|effect)\("), said("Angular code ", q, " using signals.")).when(t.rlike(r"inject\("), said("Angular code ", q, " using dependency injection."))
    plain = plain.when(t.rlike("Observable|Subject"), said("Angular code ", q, " with reactive streams.")).otherwise(said("Angular code ", q, " in ", base, "."))
    other = F.when(found != "", plain).when(exported != "", said("Exports '", exported, "' from ", base, ".")).otherwise(said("Angular code in ", base, "."))
    k = F.col("kind")
    # The sentences.
    sentence = (
        F.when(k == "component", said("Angular component ", q, " (selector: ", unknown("selector"), ")", F.when(F.size(told) > 0, said(" with ", F.array_join(told, ", "))).otherwise(""), counted("inputs", " inputs"), counted("outputs", " outputs"), "."))
        .when(k == "service", said("Angular service ", q, " (providedIn: ", unknown("provided_in"), ")", F.when(F.size(methods) > 0, said(" providing methods: ", F.array_join(methods, ", "))).otherwise(""), "."))
        .when(k == "guard", said("Angular ", guard, " guard ", q, " protecting routes."))
        .when(k == "directive", said("Angular directive ", q, " (selector: ", unknown("selector"), ")."))
        .when(k == "module", said("Angular module ", q, " with ", number("module_declarations"), " declarations and ", number("module_imports"), " imports."))
        .when(k == "interceptor", said("Angular HTTP interceptor ", q, " modifying HTTP requests/responses."))
        .when(k == "resolver", said("Angular resolver ", q, " pre-fetching route data."))
        .when(k == "validator", said("Angular validator ", q, " for form validation."))
        .otherwise(other)
    )
    return rows.withColumn("summary", sentence)


def snippet(text: Column, pattern: str, before: int = 1, after: int = 3) -> Column:
    """The lines around the first match of a pattern; null without one."""
    at = F.regexp_instr(text, F.lit(pattern))
    line = F.size(F.split(F.substring(text, F.lit(1), at - 1), "\n", -1)) - 1
    start = F.greatest(line - before, F.lit(0))
    lines = F.slice(F.split(text, "\n", -1), start + 1, line + after + 1 - start)
    return F.when(at > 0, F.btrim(F.array_join(lines, "\n"), F.lit(" \t\r\n")))


def pattern_snippets(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """``key, category, name, snippet`` of each pattern that a file shows."""
    found = [F.struct(F.lit(c).alias("category"), F.lit(n).alias("name"), snippet(F.col(text), p).alias("snippet")) for (c, n), p in SNIPPETS.items()]
    return files.select(key, F.explode(F.array(*found)).alias("x")).select(key, "x.*").where("snippet is not null")
