"""Catalog: usage patterns, dependencies, notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import paths, scores
from quillon.operators import notes, patterns
from quillon.plans.catalog import query
from quillon.sources.tables import NOTES_SQL, NOW, PATTERNS_SQL, observations, table
from quillon.sources.tables import notes as notes_table

P = f"WITH {PATTERNS_SQL}"
#: Orders end before the notes' present; trends are taken as of this day.
THEN = "2001-08-15"
FREQ = """, n AS (SELECT category, name, count(*) AS n FROM observed GROUP BY ALL), freq AS (SELECT category, name, n, floor(n * 100 / sum(n) OVER (PARTITION BY category) + 0.5)::INTEGER AS percent FROM n)"""
DATES = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY category, name ORDER BY ts DESC) - 1 AS i, count(*) OVER (PARTITION BY category, name) AS c FROM observed WHERE ts IS NOT NULL),
  dates AS (SELECT category, name, ts AS date FROM ranked WHERE i = CASE WHEN c < 5 THEN 0 ELSE floor(c * 0.1) END)"""
TREND = f"""CASE WHEN date_diff('day', date, TIMESTAMP '{THEN}') <= 60 THEN 'Rising' WHEN date_diff('day', date, TIMESTAMP '{THEN}') >= 180 THEN 'Declining' ELSE 'Stable' END"""


def _then() -> F.Column:
    return F.lit(THEN).cast("timestamp")


@query(P + FREQ + " SELECT * FROM freq")
def pattern_consensus(spark: SparkSession, d: str) -> DataFrame:
    return patterns.frequencies(observations(spark, d))


@query(P + DATES + f" SELECT category, name, date::VARCHAR AS date, {TREND} AS trend FROM dates")
def robust_date(spark: SparkSession, d: str) -> DataFrame:
    rows = patterns.robust_dates(observations(spark, d))
    return rows.select("category", "name", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), scores.trend(F.col("date"), _then()).alias("trend"))


GUIDE = P + FREQ + DATES + f""", k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, name)::INTEGER AS place FROM freq),
  t AS (SELECT k.*, {TREND} AS trend FROM k JOIN dates USING (category, name) WHERE place <= 4),
  r AS (SELECT *, bool_or(place > 1 AND trend = 'Rising') OVER (PARTITION BY category) AS rising, name || ' – ' || percent || '%' AS s, ', ' || lower(trend) AS w FROM t)
  SELECT category, name, place, trend, CASE WHEN place > 1 AND trend = 'Rising' THEN 'USE: ' || s || ', rising (migration target)'
    WHEN place = 1 AND trend = 'Declining' AND rising THEN 'CAUTION: ' || s || ', declining (legacy)'
    WHEN place = 1 AND percent >= 80 AND trend <> 'Declining' THEN 'USE: ' || s || ' adoption' || w WHEN place = 1 AND percent >= 50 THEN 'PREFER: ' || s || ' adoption' || w
    WHEN place > 1 AND trend = 'Declining' THEN 'AVOID: ' || s || ', declining (legacy)' WHEN place > 1 AND percent < 20 THEN 'CAUTION: ' || s || ' minority pattern' || w ELSE s || w END AS guidance FROM r"""


@query(GUIDE)
def guidance(spark: SparkSession, d: str) -> DataFrame:
    return patterns.consensus(observations(spark, d), _then()).select("category", "name", "place", "trend", "guidance")


CONFLICTS = P + FREQ + """, k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, name) AS place FROM freq)
  SELECT c.category, c.name AS challenger, c.percent AS challenger_percent, l.name AS leader, l.percent AS leader_percent FROM k c JOIN k l ON l.category = c.category AND l.place = 1
  WHERE c.place > 1 AND c.percent >= 20 AND l.percent < 80 AND NOT (least(c.name, l.name) = '1-URGENT' AND greatest(c.name, l.name) = '2-HIGH')"""


@query(CONFLICTS)
def pattern_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return patterns.conflicts(patterns.frequencies(observations(spark, d)), spark.createDataFrame([("2-HIGH", "1-URGENT")], "a string, b string"))


@query("""WITH e AS (SELECT lang AS category, source AS name, doc_id AS seq, CASE WHEN doc_id % 3 = 0 THEN 'core/' ELSE 'app/' END || source AS file, text AS snippet, doc_id % 3 = 0 AS prior FROM documents),
  g AS (SELECT category, name, prior, arg_min({'f': file, 's': snippet}, seq) AS a, arg_min({'f': file, 's': snippet}, seq) FILTER (WHERE length(snippet) BETWEEN 51 AND 200) AS b, arg_min({'f': file, 's': snippet}, {'l': length(snippet), 'q': seq}) FILTER (WHERE length(snippet) > 200) AS c FROM e GROUP BY ALL),
  k AS (SELECT category, name, prior, CASE WHEN length(a.s) <= 200 THEN a ELSE coalesce(b, c) END AS x FROM g) SELECT category, name, x.f AS file, x.s AS snippet FROM k QUALIFY row_number() OVER (PARTITION BY category, name ORDER BY prior DESC) = 1""")
def canonical_example(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    folder = F.when(F.col("doc_id") % 3 == 0, "core/").otherwise("app/")
    return patterns.canonical_examples(docs.select(F.col("lang").alias("category"), F.col("source").alias("name"), F.col("doc_id").alias("seq"), F.concat(folder, "source").alias("file"), F.col("text").alias("snippet")))


@query(P + """ SELECT file, count(DISTINCT category) AS categories, count(DISTINCT (category, name)) AS score FROM observed GROUP BY file HAVING count(DISTINCT category) >= 2 ORDER BY score DESC, file LIMIT 5""")
def golden_files(spark: SparkSession, d: str) -> DataFrame:
    return patterns.golden_files(observations(spark, d))


IMPORTS = "imports AS (SELECT event_type AS source, user_id AS file, event_id AS line FROM events)"


def _imports(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("file"), F.col("event_id").alias("line"))


@query(f"""WITH {IMPORTS} SELECT source, count(*) AS n, count(DISTINCT file) AS files,
  array_to_string(list_transform(list_sort(list(DISTINCT {{'f': file, 'l': line}}))[1:3], lambda p: p.f || ':' || p.l), ',') AS examples FROM imports WHERE source <> 'error' GROUP BY source""")
def library_usage(spark: SparkSession, d: str) -> DataFrame:
    return patterns.library_use(_imports(spark, d), ("error",))


@query("SELECT l_partkey AS source, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
def top_used(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("source")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(20)


NAMES = ["react", "@angular/core", "vitest", "@types/node", "left-pad", "zod", "eslint", "@nestjs/common"]


@query(f"""WITH p AS (SELECT p_partkey, ({NAMES})[(p_partkey % 8 + 1)::INT] AS name FROM part) SELECT CASE name WHEN 'react' THEN 'framework' WHEN '@angular/core' THEN 'framework'
  WHEN 'vitest' THEN 'testing' WHEN '@types/node' THEN 'build' WHEN 'zod' THEN 'utility' WHEN 'eslint' THEN 'build' ELSE 'other' END AS category, count(*) AS n, count(DISTINCT name) AS names FROM p GROUP BY 1""")
def dependency_category(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % 8 + 1).cast("int"))
    p = table(spark, d, "part").select(name.alias("name"))
    return p.groupBy(paths.dependency_category(F.col("name")).alias("category")).agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


@query("""WITH v AS (SELECT p_brand AS name, CASE WHEN p_size % 2 = 0 THEN '^' ELSE '~' END || p_size || '.' || p_partkey AS version, p_partkey AS package, p_type AS kind FROM part)
  SELECT name, substr(max_by(version, {'a': package, 'b': kind}), 2) AS version FROM v GROUP BY name""")
def dependency_merge(spark: SparkSession, d: str) -> DataFrame:
    mark = F.when(F.col("p_size") % 2 == 0, "^").otherwise("~")
    v = table(spark, d, "part").select(F.col("p_brand").alias("name"), F.concat(mark, F.col("p_size").cast("string"), F.lit("."), F.col("p_partkey").cast("string")).alias("version"), F.col("p_partkey").alias("package"), F.col("p_type").alias("kind"))
    return patterns.merged_dependencies(v)


LIFE = "CASE type WHEN 'decision' THEN 180 WHEN 'convention' THEN NULL ELSE 90 END"
DECAY = f"""WITH {NOTES_SQL}, d AS (SELECT *, date_diff('microsecond', ts, TIMESTAMP '{NOW}') / 86400000000.0 AS days, {LIFE} AS life FROM notes),
  c AS (SELECT *, CASE WHEN ts IS NULL THEN 0 WHEN life IS NULL THEN 1 ELSE round(pow(2, -days / life), 2) END::DOUBLE AS confidence FROM d)"""


def _decayed(spark: SparkSession, d: str) -> DataFrame:
    return notes.decayed(notes_table(spark, d), F.lit(NOW).cast("timestamp"))


@query(DECAY + " SELECT id, type, confidence, confidence < 0.3 AS stale FROM c")
def notes_decay(spark: SparkSession, d: str) -> DataFrame:
    return _decayed(spark, d).select("id", "type", "confidence", "stale")


@query(f"WITH {NOTES_SQL} SELECT id, type FROM notes WHERE type = 'failure' AND (contains(lower(memory || ' ' || category), '7') OR contains(lower(memory || ' ' || category), 'zzz'))")
def notes_filter(spark: SparkSession, d: str) -> DataFrame:
    return notes.matching(notes_table(spark, d).where("type = 'failure'"), ["7", "ZZZ"], "memory", "category").select("id", "type")


@query(f"WITH {NOTES_SQL} SELECT id, category, ts::VARCHAR AS ts FROM notes ORDER BY notes.ts DESC, id LIMIT 20")
def notes_recency(spark: SparkSession, d: str) -> DataFrame:
    rows = notes.recent(notes_table(spark, d), 20)
    return rows.select("id", "category", F.col("ts").cast("string").alias("ts"))


IDENT = "substr(sha256(concat_ws(':', type, category, memory, 'event', CASE WHEN file % 3 = 0 THEN 'file:' || file ELSE 'global' END)), 1, 12)"


@query(f"WITH {NOTES_SQL}, i AS (SELECT {IDENT} AS id, type, category, id AS n FROM notes), old AS (SELECT id, type, category FROM i WHERE n < 100) SELECT id, type, category FROM old UNION ALL (SELECT DISTINCT id, type, category FROM i WHERE id NOT IN (SELECT id FROM old))")
def notes_dedupe(spark: SparkSession, d: str) -> DataFrame:
    n = notes_table(spark, d)
    kind = F.when(F.col("file") % 3 == 0, "file").otherwise("global")
    made = n.select(notes.identity(F.col("type"), F.col("category"), F.col("memory"), F.lit("event"), notes.scope_text(kind, F.col("file").cast("string"), F.lit(None).cast("string"))).alias("id"), "type", "category", F.col("id").alias("n"))
    return notes.added(made.where("n < 100").drop("n"), made.drop("n"))


BOOST = f"""WITH {NOTES_SQL}, s AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'file' WHEN id % 3 = 1 THEN 'symbol' ELSE 'global' END AS scope, category || (id % 7) AS symbol FROM notes),
  b AS (SELECT *, file < 50 AS f, symbol IN ('click1', 'view3', 'error5') AS y FROM s)
  SELECT id, (CASE WHEN scope = 'file' AND f THEN 3 WHEN scope = 'symbol' AND f AND y THEN 4 WHEN scope = 'symbol' AND f THEN 2 WHEN scope = 'symbol' AND y THEN 1 ELSE 0 END)::INTEGER AS boost FROM b"""


def _boosted(spark: SparkSession, d: str, n: DataFrame) -> DataFrame:
    scope = F.when(F.col("id") % 3 == 0, "file").when(F.col("id") % 3 == 1, "symbol").otherwise("global")
    n = n.withColumn("scope", scope).withColumn("symbol", F.concat("category", (F.col("id") % 7).cast("string")))
    return notes.boosted(n, spark.range(50).select(F.col("id").alias("file")), spark.createDataFrame([("Click1",), ("VIEW3",), ("error5",)], "symbol string"))


@query(BOOST)
def notes_scope_boost(spark: SparkSession, d: str) -> DataFrame:
    return _boosted(spark, d, notes_table(spark, d)).select("id", "boost")


@query(DECAY + f", b AS ({BOOST.replace('WITH ' + NOTES_SQL + ',', 'WITH')}) SELECT id, b.boost, confidence FROM c JOIN b USING (id) WHERE (category = 'click' OR b.boost >= 2) AND confidence >= 0.5 ORDER BY b.boost DESC, CASE WHEN category = 'click' THEN 2 ELSE 0 END DESC, confidence DESC, id LIMIT 2")
def strong_notes(spark: SparkSession, d: str) -> DataFrame:
    rows = _boosted(spark, d, _decayed(spark, d)).withColumn("matches", F.when(F.col("category") == "click", 2).otherwise(0))
    return notes.strong(rows).select("id", "boost", "confidence")


LOG = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || chr(9) || 'ab' || o_orderkey || ' ' || (['refactor: move ', 'fix(core): stop ', 'docs: tell ', 'revert! undo ', 'Migrate: to ', 'fix: a'])[(o_orderkey % 6 + 1)::INT] || CASE WHEN o_orderkey % 6 = 5 THEN '' ELSE o_orderpriority END AS line"


@query(f"""WITH l AS (SELECT {LOG}, o_orderkey % 6 AS k, o_orderdate AS ts FROM orders), m AS (SELECT *, regexp_replace(split_part(line, chr(9), 2), '^[a-f0-9]+ ', '') AS memory FROM l WHERE k IN (0, 1, 3, 4)),
  n AS (SELECT *, CASE WHEN k IN (0, 4) THEN 'decision' ELSE 'gotcha' END AS type, CASE k WHEN 0 THEN 'architecture' WHEN 4 THEN 'dependencies' WHEN 1 THEN 'conventions' ELSE 'architecture' END AS category FROM m)
  SELECT substr(sha256('git:' || type || ':' || category || ':' || memory), 1, 12) AS id, type, category, memory, count(*) AS commits FROM n GROUP BY ALL""")
def commit_notes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 6
    start = F.element_at(F.array(*map(F.lit, ["refactor: move ", "fix(core): stop ", "docs: tell ", "revert! undo ", "Migrate: to ", "fix: a"])), (k + 1).cast("int"))
    line = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("\tab"), F.col("o_orderkey").cast("string"), F.lit(" "), start, F.when(k == 5, "").otherwise(F.col("o_orderpriority")))
    return notes.from_commits(table(spark, d, "orders").select(line.alias("line"))).groupBy("id", "type", "category", "memory").agg(F.count("*").alias("commits"))
