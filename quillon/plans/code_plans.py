"""Catalog: source text, reviews, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import paths, scores, text
from quillon.operators import analyzers, evals, review
from quillon.plans.catalog import query
from quillon.sources.tables import FILES_SQL, files, spread, table

#: Parts as small source files.
CODE_PATH = "lower(replace(p_brand, '#', '')) || '/f' || p_partkey || '.ts'"
CODE_TEXT = """'import { useState, P' || p_size || ' as Q } from ''react'';' || chr(10) || 'import d' || p_partkey || ' from ''./f' || (p_partkey + 25) || ''';' || chr(10) ||
  'import * as all from ''../../x' || p_size || ''';' || chr(10) || 'export * from ''../' || lower(replace(p_brand, '#', '')) || '/f' || (p_partkey + 1) || ''';' || chr(10) ||
  'export class Part' || p_partkey || ' {' || chr(10) || '  size' || p_size || '(a) {' || CASE WHEN p_size % 2 = 0 THEN ' const s = useState(0);' ELSE ' return inject(A);' END || ' }' || chr(10) || '}' || chr(10) ||
  'export async function make' || p_partkey || '() {}'"""
W = f"WITH code AS (SELECT p_partkey AS k, {CODE_PATH} AS path, p_size, {CODE_TEXT} AS text FROM part)"


def code(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "part"), "p_partkey").selectExpr("p_partkey AS k", f"{CODE_PATH} AS path", f"{CODE_TEXT} AS text")


@query(W + """, l AS (SELECT path, unnest(string_split(text, chr(10))) AS body, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS line FROM code)
  SELECT path, line::INTEGER AS line, CASE line WHEN 5 THEN 'class' WHEN 6 THEN 'method' ELSE 'function' END AS kind,
    CASE line WHEN 5 THEN regexp_extract(body, 'class (\\w+)', 1) WHEN 6 THEN regexp_extract(body, '^  (\\w+)', 1) ELSE regexp_extract(body, 'function (\\w+)', 1) END AS name FROM l WHERE line IN (5, 6, 8)""")
def lexical_symbols(spark: SparkSession, d: str) -> DataFrame:
    return analyzers.lexical_symbols(code(spark, d))


@query(W + """ SELECT path, 1 AS line, 'react' AS source, 'useState,P' || p_size AS names FROM code UNION ALL SELECT path, 2, './f' || (k + 25), 'default' FROM code UNION ALL SELECT path, 3, '../../x' || p_size, '*' FROM code""")
def import_statements(spark: SparkSession, d: str) -> DataFrame:
    return analyzers.imports(code(spark, d)).withColumn("names", F.array_join("names", ","))


@query(W + """, i AS (SELECT path, 'react' AS source FROM code UNION ALL SELECT path, './f' || (k + 25) FROM code UNION ALL SELECT path, '../../x' || p_size FROM code UNION ALL SELECT path, regexp_extract(text, 'export \\* from .([^'';]+)', 1) FROM code),
  t AS (SELECT path, source, CASE WHEN source LIKE './%' THEN split_part(path, '/', 1) || '/' || substr(source, 3) || '.ts' WHEN source LIKE '../../%' THEN NULL WHEN source LIKE '../%' THEN substr(source, 4) || '.ts' END AS c FROM i)
  SELECT t.path, source, f.path AS target, CASE WHEN source = 'react' THEN 'external' WHEN source LIKE '../../%' THEN 'outside-root' WHEN f.path IS NULL THEN 'not-found' ELSE 'resolved' END AS outcome FROM t LEFT JOIN code f ON f.path = t.c""")
def resolved_imports(spark: SparkSession, d: str) -> DataFrame:
    c = code(spark, d)
    found = analyzers.imports(c).select("path", "source").union(analyzers.reexports(c))
    return analyzers.resolved(found, c)


@query(W + """ SELECT 'react' AS framework, 'hooks' AS category, 'useState' AS name, count(*) AS files FROM code UNION ALL SELECT 'angular', 'dependencyInjection', 'inject() function', count(*) FILTER (WHERE p_size % 2 = 1) FROM code""")
def framework_facts(spark: SparkSession, d: str) -> DataFrame:
    return analyzers.framework_facts(code(spark, d)).groupBy("framework", "category", "name").agg(F.count("*").alias("files"))


@query(f"""WITH {FILES_SQL}, r AS (SELECT path, CASE WHEN doc_id % 2 = 0 THEN '/' || source || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '/' || lang END END AS route FROM files) SELECT * FROM r""")
def page_routes(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    p = F.concat(F.lit("web/app/(group)/@slot/"), "source", F.lit("/"), F.when(F.col("doc_id") % 3 == 0, "index").otherwise(F.col("lang")), F.lit("/"), F.when(F.col("doc_id") % 2 == 0, "page.tsx").otherwise("view.tsx"))
    return f.select("path", paths.route(p).alias("route"))


#: Conversations as patches: a user's lines are removed, an assistant's added.
PATCH = "CASE WHEN role = 'user' THEN '-' ELSE '+' END || replace(text, chr(10), chr(10) || '+')"
PATCH_SQL = f"""patches AS (SELECT conv_id AS path, string_agg({PATCH}, chr(10) ORDER BY turn) AS patch FROM conversations GROUP BY 1),
  l AS (SELECT path, unnest(string_split(patch, chr(10))) AS l FROM patches), c AS (SELECT path, left(l, 1) AS sign, substr(l, 2) AS body FROM l WHERE l LIKE '+%' OR l LIKE '-%'),
  w AS (SELECT path, sign, unnest(regexp_extract_all(body, '[A-Za-z_$][A-Za-z0-9_$]*')) AS i FROM c),
  s AS (SELECT path, i AS identifier, sum(CASE WHEN sign = '+' THEN 3 ELSE 2 END + 2 * regexp_matches(i, '^[A-Z][A-Za-z0-9_$]+$')::INT + regexp_matches(i, '[a-z][A-Z]')::INT + (length(i) >= 8)::INT)::BIGINT AS score
    FROM w WHERE length(i) >= 3 AND lower(i) NOT IN ({', '.join(repr(x) for x in review.NOISE)}) GROUP BY ALL),
  ids AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, identifier)::INTEGER AS n FROM s QUALIFY n <= 10)"""


def patches(spark: SparkSession, d: str) -> DataFrame:
    part = F.concat(F.when(F.col("role") == "user", "-").otherwise("+"), F.replace("text", F.lit("\n"), F.lit("\n+")))
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("path")).agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))).alias("x"))
    return rows.select("path", F.array_join(F.transform("x", lambda t: t["p"]), "\n").alias("patch"))


@query(f"WITH {PATCH_SQL} SELECT * FROM ids")
def changed_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return review.changed_identifiers(patches(spark, d))


@query(f"WITH {PATCH_SQL} SELECT path, count(*) FILTER (WHERE sign = '+') AS additions, count(*) FILTER (WHERE sign = '-') AS deletions, FALSE AS binary FROM c GROUP BY path")
def patch_stats(spark: SparkSession, d: str) -> DataFrame:
    return review.patch_stats(patches(spark, d))


@query(f"""WITH {PATCH_SQL}, f AS (SELECT path, count(*) AS k, list(identifier ORDER BY n) AS x FROM ids GROUP BY path), n AS (SELECT path, count(*) AS changes FROM c GROUP BY path),
  t AS (SELECT path, array_to_string(x[1:3], ' ') AS query FROM f JOIN n USING (path) ORDER BY k DESC, changes DESC, path LIMIT 8) SELECT min(query) AS query, array_to_string(list_sort(list(path)), ',') AS files FROM t GROUP BY lower(query)""")
def review_queries(spark: SparkSession, d: str) -> DataFrame:
    p = patches(spark, d)
    ids = review.changed_identifiers(p).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "identifier"))), lambda x: x["identifier"]).alias("identifiers"))
    changes = review.patch_stats(p).select("path", (F.col("additions") + F.col("deletions")).alias("changes"))
    return review.review_queries(ids.join(changes, "path")).withColumn("files", F.array_join("files", ","))


@query("""SELECT CASE o_orderstatus WHEN 'F' THEN 'renamed' WHEN 'O' THEN 'added' ELSE 'modified' END AS status, CASE WHEN o_orderstatus = 'F' THEN 'n' || o_orderkey ELSE 'p' || o_orderkey END AS path, CASE WHEN o_orderstatus = 'F' THEN 'p' || o_orderkey END AS old_path FROM orders""")
def name_status(spark: SparkSession, d: str) -> DataFrame:
    code_ = F.when(F.col("o_orderstatus") == "F", "R100").when(F.col("o_orderstatus") == "O", "A").otherwise("M")
    k = F.col("o_orderkey").cast("string")
    line = F.concat(code_, F.lit("\tp"), k, F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("\tn"), k)).otherwise(""))
    return review.name_status(table(spark, d, "orders").select(line.alias("line")))


#: Results of a query are a language's documents by length; expected are those of sources 1, 11 and 12, forbidden those of source 3.
EVAL_SQL = f"""WITH {FILES_SQL}, r AS (SELECT lang AS query_id, path, row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, doc_id) - 1 AS rank FROM files),
  f AS (SELECT query_id, min(rank) FILTER (WHERE contains(path, 'src1/') OR contains(path, 'src11/') OR contains(path, 'src12/')) + 1 AS first, min(rank) FILTER (WHERE contains(path, 'src3/')) + 1 AS bad FROM r GROUP BY 1)"""


def _evaluated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    from quillon.operators.search import ranked

    rows = files(spark, d).select(F.col("lang").alias("query_id"), "path", F.length("text").alias("n"), "doc_id")
    asked = rows.select("query_id").distinct()
    expected = asked.withColumn("pattern", F.explode(F.array(F.lit("src1/"), F.lit("src11/"), F.lit("src12/"))))
    return ranked(rows, [F.desc("n"), F.asc("doc_id")]), expected, asked.withColumn("pattern", F.lit("src3/"))


@query(EVAL_SQL + " SELECT query_id, first FROM f")
def first_hit(spark: SparkSession, d: str) -> DataFrame:
    rows, expected, _ = _evaluated(spark, d)
    return evals.first_hits(rows, expected)


@query(EVAL_SQL + " SELECT count(*) AS queries, avg((coalesce(first, 999) = 1)::INT) AS top1, avg((coalesce(first, 999) <= 3)::INT) AS top3, avg((coalesce(bad, 999) <= 3)::INT) AS contaminated, count(*) FILTER (WHERE first <= 3) >= ceil(count(*) * 0.7) AS passed FROM f")
def eval_retrieval(spark: SparkSession, d: str) -> DataFrame:
    return evals.retrieval(*_evaluated(spark, d))


@query("""SELECT doc_id, contains(lower(text), 'the') :: INT + contains(lower(text), 'and')::INT + contains(lower(text), 'der')::INT AS n, contains(lower(text), 'xyz') AS spoiled, round((contains(lower(text), 'the') :: INT + contains(lower(text), 'and')::INT + contains(lower(text), 'der')::INT) / 3, 6) AS useful FROM documents""")
def eval_discovery(spark: SparkSession, d: str) -> DataFrame:
    rows = evals.signals(table(spark, d, "documents"), "text", ["The", "and", "der"], ["XYZ"])
    return rows.select("doc_id", F.size("matched").alias("n"), (F.size("found_forbidden") > 0).alias("spoiled"), F.round("useful", 6).alias("useful"))


@query("""WITH r AS (SELECT l_returnflag AS lane, CASE WHEN l_linenumber > 2 THEN l_quantity END AS files, CASE WHEN l_returnflag <> 'A' THEN l_discount END AS lines FROM lineitem) SELECT lane, round(avg(files), 6) AS files, round(avg(lines), 6) AS lines, count(*) AS runs, bool_or(files IS NOT NULL OR lines IS NOT NULL) AS evidence FROM r GROUP BY lane""")
def comparator_means(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("lane"), F.when(F.col("l_linenumber") > 2, F.col("l_quantity")).alias("files"), F.when(F.col("l_returnflag") != "A", F.col("l_discount")).alias("lines"))
    return evals.means(r, "lane", "files", "lines").withColumns({c: F.round(c, 6) for c in ("files", "lines")})


@query("""SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN s_acctbal <= 5000 * 1.15 ELSE s_acctbal >= 5000 * 0.85 END AS ok, ceil(CASE WHEN s_nationkey / 10.0 <= 1 THEN 20 * s_nationkey / 10.0 ELSE s_nationkey / 10.0 END)::BIGINT AS needed FROM supplier""")
def gate_compare(spark: SparkSession, d: str) -> DataFrame:
    gate = F.col("s_nationkey") / F.lit(10.0)
    return table(spark, d, "supplier").select("s_suppkey", scores.within_tolerance(F.col("s_acctbal"), F.lit(5000.0), 15, F.col("s_nationkey") % 2 == 0).alias("ok"), scores.needed(F.lit(20), gate).cast("long").alias("needed"))


@query("SELECT doc_id, greatest(1, ceil(octet_length(encode(text)) / 4))::BIGINT AS tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("""WITH h AS (SELECT *, sha256('seed:' || doc_id) AS h FROM documents), p AS (SELECT doc_id, h, 0 AS turn FROM h QUALIFY row_number() OVER (PARTITION BY lang ORDER BY h) <= 2
  UNION ALL SELECT doc_id, h, 1 FROM h QUALIFY row_number() OVER (PARTITION BY source ORDER BY h) <= 2 UNION ALL (SELECT doc_id, h, 2 FROM h ORDER BY h LIMIT 60)),
  m AS (SELECT doc_id, min(turn)::INTEGER AS turn, min(h) AS h FROM p GROUP BY 1) SELECT doc_id, turn FROM m ORDER BY m.turn, m.h LIMIT 60""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return evals.stratified(table(spark, d, "documents"), ["lang", "source"], 2, 60, "seed", "doc_id")


@query(f"""WITH {FILES_SQL}, q AS (SELECT unnest([1, 2]) AS query_id, unnest([['the', 'src1'], ['von', 'models', 'en']]) AS tokens), l AS (SELECT path, unnest(string_split(lower(text), chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM files),
  h AS (SELECT query_id, path, line, len(list_filter(tokens, lambda t: contains(body, t))) AS n FROM l, q), b AS (SELECT query_id, path, sum(n) AS lines, arg_max(line, {{'n': n, 'l': -line}}) AS best FROM h WHERE n > 0 GROUP BY ALL),
  p AS (SELECT query_id, path, len(list_filter(tokens, lambda t: contains(path, t))) AS n FROM files, q) SELECT query_id::BIGINT AS query_id, path, (8 * p.n + coalesce(lines, 0))::BIGINT AS score, best::INTEGER AS best FROM p LEFT JOIN b USING (query_id, path) WHERE p.n > 0 OR lines > 0""")
def lexical_baseline(spark: SparkSession, d: str) -> DataFrame:
    q = spark.createDataFrame([(1, "the"), (1, "src1"), (2, "von"), (2, "Models"), (2, "en")], "query_id long, token string")
    return evals.lexical_baseline(files(spark, d), q)


@query("SELECT source, doc_id, used::BIGINT AS used FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 4000")
def budget_trim(spark: SparkSession, d: str) -> DataFrame:
    return evals.budget(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", F.col("n_chars"), 4000).drop("n_chars")


@query("""SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, '{"a":"' || event_type || '","k":' || json_extract(props, '$.k') || '}' AS canonical FROM events""")
def canonical_json(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    loose = F.concat(F.lit('{ "k" : '), F.get_json_object("props", "$.k"), F.lit(', "a":"'), "event_type", F.lit('"}'))
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), text.canonical_json(loose).alias("canonical"))
