"""Catalog: what files say of their frameworks. The files are made of the part table, so that the SQL states the facts themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import analyzers, frameworks
from quillon.plans.catalog import query
from quillon.plans.code_plans import W, code
from quillon.sources.tables import FILES_SQL, files, spread, table

REACT_TEXT = """'import { useState, use as load } from ''react'';' || chr(10) || '/* useRef( */' || chr(10) || '// useMemo(() => 1)' || chr(10) ||
  'export function Card' || p_partkey || '() {' || chr(10) || '  const [a] = useState<string>(0);' || chr(10) || CASE WHEN p_size % 2 = 0 THEN '  return <Suspense><div /></Suspense>;' ELSE '  return a < 1;' END || chr(10) || '}' || chr(10) ||
  'const use' || p_partkey || ' = (x) => ' || CASE WHEN p_size % 3 = 0 THEN 'load(x);' ELSE 'useEffect(x);' END || chr(10) || 'class Old' || p_size || ' extends React.Component {' || chr(10) || '}' || chr(10) ||
  CASE WHEN p_size % 5 = 0 THEN 'const Box = () => <Theme.Provider />;' ELSE 'const Box = 1;' END"""


def _react(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "part"), "p_partkey").selectExpr("p_partkey AS path", f"{REACT_TEXT} AS text")


@query("""SELECT p_partkey AS path, 'use' || p_partkey AS name, 'custom-hook' AS kind FROM part UNION ALL SELECT p_partkey, 'Card' || p_partkey, 'function-component' FROM part WHERE p_size % 2 = 0
  UNION ALL SELECT p_partkey, 'Old' || p_size, 'class-component' FROM part UNION ALL SELECT p_partkey, 'Box', 'function-component' FROM part WHERE p_size % 5 = 0""")
def react_components(spark: SparkSession, d: str) -> DataFrame:
    return frameworks.react_components(_react(spark, d))


@query("""SELECT p_partkey AS path, CASE WHEN p_size % 3 = 0 THEN 'load,useState' ELSE 'useEffect,useState' END AS hooks, p_size % 5 = 0 AS context, false AS memoization, p_size % 2 = 0 OR p_size % 3 = 0 AS suspense, false AS actions FROM part""")
def react_facts(spark: SparkSession, d: str) -> DataFrame:
    rows = _react(spark, d).select("path", frameworks.react_facts(F.col("text")).alias("f"))
    return rows.select("path", F.array_join("f.hooks", ",").alias("hooks"), "f.context", "f.memoization", "f.suspense", "f.actions")


KINDS = "(['Component', 'Injectable', 'Controller', 'Module'])[(p_size % 4 + 1)::INT]"
CLASS_TEXT = """'@' || {kind} || '({{ selector: ''app-' || p_partkey || ''', imports: [A' || p_size || ', f(B)] }})' || chr(10) || 'export class P' || p_partkey || {ending} || ' {{' || chr(10) ||
  '  @Input() size: number;' || chr(10) || '  constructor(private a: Http' || p_size || ', @Inject(KEY) b: Token) {{}}' || chr(10) || '  ngOnInit() {{ this.ngOnDestroy(); }}' || chr(10) || '}}' || chr(10) || 'class Bare {{}}'"""
ENDINGS = "(['Guard', 'Service', 'Repository'])[(p_size % 3 + 1)::INT]"


def _spark(pick: str) -> str:
    """The same pick from a list in Spark SQL."""
    return pick.replace("([", "element_at(array(").replace("])[(", "), cast(").replace(")::INT]", " as int))")


@query(f"""WITH c AS (SELECT p_partkey AS path, p_size, 'P' || p_partkey || {ENDINGS} AS name, {KINDS} AS decorator, {ENDINGS} AS ending FROM part)
  SELECT path, name, decorator, CASE decorator WHEN 'Component' THEN 'component' WHEN 'Injectable' THEN 'service' END AS kind,
    CASE decorator WHEN 'Injectable' THEN lower(ending) WHEN 'Controller' THEN 'controller' WHEN 'Module' THEN 'module' END AS nest_kind,
    CASE decorator WHEN 'Controller' THEN 'presentation' WHEN 'Module' THEN 'feature' WHEN 'Injectable' THEN CASE ending WHEN 'Service' THEN 'business' WHEN 'Repository' THEN 'data' ELSE 'core' END END AS nest_layer,
    'app-' || path AS selector, 'ngOnInit' AS hooks, 'Http' || p_size || ',Token' AS services, 'Http' || p_size || ',KEY' AS tokens, 'size' AS inputs, 'A' || p_size || ',B' AS imports FROM c""")
def decorated_classes(spark: SparkSession, d: str) -> DataFrame:
    text = CLASS_TEXT.format(kind=_spark(KINDS), ending=_spark(ENDINGS))
    rows = frameworks.decorated_classes(spread(table(spark, d, "part"), "p_partkey").selectExpr("p_partkey AS path", f"{text} AS text"))
    return rows.select("path", "name", F.array_join("decorators", ",").alias("decorator"), "kind", "nest_kind", "nest_layer", "selector", *[F.array_join(c, ",").alias(c) for c in ("hooks", "services", "tokens", "inputs")], F.array_join("module_imports", ",").alias("imports"))


@query(f"""WITH {FILES_SQL}, x AS (SELECT path, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS e, coalesce(text, '') AS text FROM files)
  SELECT path, CASE WHEN e = '.ts' AND regexp_matches(text, '\\bfrom\\s+[''"]@nestjs/|\\bNestFactory\\b') THEN 'nestjs' WHEN e = '.html' OR (e = '.ts' AND regexp_matches(text, '(?m)^\\s*import\\s[^''"]*[''"]@angular/')) THEN 'angular'
    WHEN e = '.ts' AND regexp_matches(text, '\\bfrom\\s+[''"]next[''"/]') THEN 'nextjs' WHEN e = '.ts' AND regexp_matches(text, '\\bfrom\\s+[''"]react[''"]') THEN 'react' WHEN e IN ('.ts', '.py') THEN 'generic' END AS analyzer FROM x""")
def analyzer_choice(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("path", analyzers.chosen(F.col("path"), F.col("text"), frameworks.framework_analyzers()).alias("analyzer"))


@query("""WITH s AS (SELECT s_suppkey AS project, CASE WHEN s_suppkey % 3 = 0 THEN 'redux' ELSE 'mobx' END AS state FROM supplier)
  SELECT project, 'react' AS framework, '18.' || project AS version, 'dep:react,disk:src-directory' AS indicators, state, 'Jest' AS testing FROM s WHERE project % 5 <> 0
  UNION ALL SELECT project, 'nextjs', '14', CASE WHEN project % 5 <> 0 THEN 'dep:next,dep:react,disk:app-router' ELSE 'dep:next,disk:app-router' END, state, 'Jest' FROM s WHERE project % 2 = 0""")
def project_claims(spark: SparkSession, d: str) -> DataFrame:
    s, k = table(spark, d, "supplier").select(F.col("s_suppkey").alias("project")), F.col("project")
    deps = F.array(
        F.when(k % 5 != 0, F.struct(F.lit("react").alias("name"), F.concat(F.lit("^18."), k.cast("string")).alias("version"))),
        F.when(k % 2 == 0, F.struct(F.lit("next").alias("name"), F.lit("14").alias("version"))),
        F.when(k % 3 == 0, F.struct(F.lit("@reduxjs/toolkit").alias("name"), F.lit("1").alias("version"))).otherwise(F.struct(F.lit("mobx").alias("name"), F.lit("1").alias("version"))),
        F.struct(F.lit("jest").alias("name"), F.lit("1").alias("version")), F.struct(F.lit("left-pad").alias("name"), F.lit("1").alias("version")),
    )
    dependencies = s.select(k, F.explode(F.filter(deps, lambda x: x.isNotNull())).alias("x")).select("project", "x.*")
    claims = frameworks.project_claims(dependencies, s.select(k, F.lit("src/app/page.tsx").alias("path")))
    return claims.select("project", "framework", "version", *[F.array_join(c, ",").alias(c) for c in ("indicators", "state", "testing")])


@query(rf"""WITH {FILES_SQL}, x AS (SELECT path, regexp_extract(path, '[^/]+$') AS base, coalesce(text, '') AS text FROM files),
  y AS (SELECT *, trim(regexp_extract(text, '/\*\*\s*\n?\s*\*\s*(.+?)(?:\n|\*/)', 1), chr(32) || chr(9) || chr(13)) AS said, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, chr(32) || chr(9) || chr(13))), lambda l: l <> '' AND NOT starts_with(l, 'import') AND NOT starts_with(l, '//')) AS lines FROM x)
  SELECT path, CASE WHEN text = '' THEN 'text code in ' || base WHEN said <> '' THEN 'text code in ' || base || ': ' || said
    WHEN regexp_matches(text, '(class|struct|interface|trait)\s+(\w+)') THEN 'text ' || regexp_extract(text, '(class|struct|interface|trait)\s+(\w+)', 1) || ' ''' || regexp_extract(text, '(class|struct|interface|trait)\s+(\w+)', 2) || ''' in ' || base || '.'
    WHEN regexp_matches(text, '(function|fn|func|def|method)\s+(\w+)') THEN 'text ' || regexp_extract(text, '(function|fn|func|def|method)\s+(\w+)', 1) || ' ''' || regexp_extract(text, '(function|fn|func|def|method)\s+(\w+)', 2) || ''' in ' || base || '.'
    ELSE 'text code in ' || base || ': ' || coalesce(left(lines[1], 60) || '...', 'code definition') END AS summary FROM y""")
def file_summaries(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("path", frameworks.summary(F.lit("text"), F.lit(None).cast("string"), F.col("path"), F.col("text")).alias("summary"))


@query(W + """ SELECT path, 'dependencyInjection' AS category, 'inject() function' AS name, 'export class Part' || k || ' {' || chr(10) || '  size' || p_size || '(a) { return inject(A); }' || chr(10) || '}' || chr(10) || 'export async function make' || k || '() {}' AS snippet FROM code WHERE p_size % 2 = 1""")
def pattern_snippets(spark: SparkSession, d: str) -> DataFrame:
    return frameworks.pattern_snippets(code(spark, d))


@query(f"""WITH {FILES_SQL} SELECT path, CASE doc_id % 5 WHEN 0 THEN 'Angular component ''Sample'' (selector: unknown), 2 inputs.' WHEN 1 THEN 'Angular service ''Sample'' (providedIn: root) providing methods: load, save.' WHEN 2 THEN 'Angular CanMatch guard ''Sample'' protecting routes.'
    WHEN 3 THEN 'Angular module ''Sample'' with 0 declarations and 2 imports.' ELSE 'Angular code ''Sample'' using signals.' END AS summary FROM files""")
def class_summaries(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id") % 5
    kind = F.when(n == 0, "component").when(n == 1, "service").when(n == 2, "guard").when(n == 3, "module")
    two, none = F.array(F.lit("a"), F.lit("b")), F.array().cast("array<string>")
    content = F.lit("export class Sample { public load() {} public save() {} on = signal(CanMatch) }")
    rows = files(spark, d).select("path", kind.alias("kind"), F.lit(None).cast("string").alias("selector"), F.lit("root").alias("provided_in"), two.alias("inputs"), none.alias("outputs"), none.alias("module_declarations"), two.alias("module_imports"), content.alias("content"))
    return frameworks.class_summary(rows).select("path", "summary")
