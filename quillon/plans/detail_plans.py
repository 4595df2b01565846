"""Catalog: what is added to results and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import scores, text
from quillon.operators import detail
from quillon.plans.catalog import query
from quillon.plans.code_plans import CODE_PATH, CODE_TEXT, code
from quillon.sources.tables import FILES_SQL, files, table

RANKED = "r AS (SELECT lang AS query_id, source AS file, doc_id, text AS snippet, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents)"


def _ranked(spark: SparkSession, d: str, keep: int) -> DataFrame:
    from quillon.operators.search import ranked

    rows = table(spark, d, "documents").select(F.col("lang").alias("query_id"), F.col("source").alias("file"), "doc_id", F.col("text").alias("snippet"), "n_chars")
    return ranked(rows, [F.desc("n_chars"), F.asc("doc_id")], keep)


@query(f"WITH {RANKED} SELECT query_id, arg_min(file, rank) AS file, min(rank)::INTEGER AS rank FROM r WHERE rank < 5 AND file IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src6') GROUP BY query_id")
def best_example(spark: SparkSession, d: str) -> DataFrame:
    return detail.best_example(_ranked(spark, d, 5), spark.createDataFrame([(f"src{k}",) for k in range(1, 7)], "file string"))


@query(f"WITH {RANKED}, t AS (SELECT * FROM r WHERE rank < 8), e AS (SELECT DISTINCT lang AS query_id, 'src1' AS file, 'a' AS example FROM documents) SELECT e.query_id, count(t.snippet) = 1 AND coalesce(bool_or(contains(t.snippet, example)), FALSE) AS grounded FROM e LEFT JOIN t ON t.query_id = e.query_id AND t.file = e.file GROUP BY e.query_id")
def grounded_example(spark: SparkSession, d: str) -> DataFrame:
    examples = table(spark, d, "documents").select(F.col("lang").alias("query_id")).distinct().withColumns({"file": F.lit("src1"), "example": F.lit("a")})
    return detail.grounded(_ranked(spark, d, 8), examples)


VERIFY = f"""WITH {FILES_SQL}, e AS (SELECT a.path AS src, b.path AS dst, CASE WHEN a.doc_id % 9 = 0 THEN 'short' ELSE sha256(a.text) END AS src_fp, CASE WHEN b.doc_id % 7 = 0 THEN sha256(b.text || 'x') ELSE sha256(b.text) END AS dst_fp, b.doc_id AS t
  FROM files a JOIN files b ON b.doc_id = a.doc_id + 1)"""


@query(VERIFY + " SELECT src, dst, CASE WHEN src_fp = 'short' THEN 'malformed' WHEN t % 11 = 0 OR (t - 1) % 11 = 0 THEN 'unknown' WHEN t % 7 = 0 THEN 'stale' ELSE 'verified' END AS state FROM e")
def verified_edges(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    after = f.select((F.col("doc_id") - 1).alias("doc_id"), F.col("path").alias("dst"), F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("t"))
    edges = f.join(after, "doc_id").select(F.col("path").alias("src"), "dst", F.when(F.col("doc_id") % 9 == 0, "short").otherwise(F.sha2("text", 256)).alias("src_fp"), F.sha2("t", 256).alias("dst_fp"))
    current = f.where("doc_id % 11 <> 0").select("path", F.sha2("text", 256).alias("fingerprint"))
    known = f.select("path", text.content_hash(F.col("text")).alias("hash"))
    return detail.verified(edges, current, known).select("src", "dst", "state")


@query("""SELECT p_partkey, list_has_any(list_transform(CASE WHEN p_size % 3 = 0 THEN ['part' || p_size] WHEN p_size % 3 = 1 THEN ['openpart' || p_size] ELSE [] END, lambda x: lower(x)), ['part' || p_partkey, 'openpart' || p_partkey]) AS exact FROM part""")
def exact_declaration(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    names = F.array(F.concat(F.lit("Part"), k, F.lit("+openPart"), k), F.lit(None).cast("string"))
    asked = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" PART"), s)).when(F.col("p_size") % 3 == 1, F.concat(F.lit("how does openPart"), s, F.lit(" work"))).otherwise("plain words only")
    return table(spark, d, "part").select("p_partkey", F.coalesce(detail.exact_declaration(names, asked), F.lit(False)).alias("exact"))


@query(f"""WITH {FILES_SQL} SELECT path, 'module ' || lang || ' in ' || regexp_extract(path, '[^/]+$') || CASE WHEN doc_id % 2 = 0 THEN ' (core)' ELSE '' END || ', ' || len(string_split(text, chr(10))) || ' lines' AS summary,
  left(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT regexp_matches(x, '^(//|#|/?\\*)'))[1:3], ' '), 200) AS signature FROM files""")
def result_summary(spark: SparkSession, d: str) -> DataFrame:
    layer = F.when(F.col("doc_id") % 2 == 0, "core").otherwise("unknown")
    n = F.size(F.split("text", "\n", -1))
    return files(spark, d).select("path", detail.summary(F.lit("module"), F.col("lang"), F.col("path"), layer, n).alias("summary"), detail.signature(F.col("text")).alias("signature"))


@query("SELECT p_name AS name, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS files FROM part GROUP BY p_name")
def symbol_exporters(spark: SparkSession, d: str) -> DataFrame:
    return detail.exporters(table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("file"))).withColumn("files", F.array_join("files", ","))


@query("""WITH p AS (SELECT s_nationkey AS priority, 'f' || s_nationkey AS framework, s_suppkey % 6 AS indicators, 'l' || (s_suppkey % 4) AS layer, s_suppkey AS files FROM supplier), b AS (SELECT max_by(framework, {'p': priority, 'f': framework}) AS framework FROM p WHERE indicators >= 3)
  SELECT layer, max(files) AS files, any_value(b.framework) AS framework FROM p, b GROUP BY layer""")
def metadata_merge(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    p = s.select(F.col("s_nationkey").alias("priority"), F.concat(F.lit("f"), F.col("s_nationkey").cast("string")).alias("framework"), (F.col("s_suppkey") % 6).alias("indicators"), F.concat(F.lit("l"), (F.col("s_suppkey") % 4).cast("string")).alias("layer"), F.col("s_suppkey").alias("files"))
    return detail.merged_metadata(p)


@query("""SELECT o_orderkey, o_orderpriority AS category FROM orders WHERE (o_orderpriority <> '1-URGENT' OR o_orderkey % 4 = 0) AND o_orderpriority <> '5-LOW'""")
def conflict_scope(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("category"))
    asked = F.when(F.col("o_orderkey") % 4 == 0, "write a test for it").otherwise("attest it")
    return detail.in_scope(o, asked, {"1-URGENT": "tests?|testing"}, ("5-LOW",))


@query("""SELECT event_id, 'src/' || event_type || '.ts,lib/a-b/' || user_id || '.py' AS files FROM events""")
def json_paths(spark: SparkSession, d: str) -> DataFrame:
    j = F.to_json(F.struct(F.concat(F.lit("src/"), "event_type", F.lit(".ts")).alias("file"), F.array(F.struct(F.concat(F.lit("lib/a-b/"), F.col("user_id").cast("string"), F.lit(".py")).alias("p")), F.struct(F.lit("no path").alias("p"))).alias("more"), F.concat(F.lit("src/"), "event_type", F.lit(".ts")).alias("again")))
    return table(spark, d, "events").select("event_id", F.array_join(detail.path_strings(j), ",").alias("files"))


@query(f"WITH {FILES_SQL} SELECT path FROM files WHERE (contains(path, '/src/') OR contains(path, '/docs/')) AND NOT contains(path, 'src1/') AND NOT (contains(path, '.spec.') OR contains(path, '__tests__')) AND length(text) BETWEEN 100 AND 900")
def narrowed_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = files(spark, d).withColumn("complexity", F.length("text"))
    return detail.narrowed(rows, ["/SRC/", "/docs/"], ["src1/"], False, (100, 900)).select("path")


@query("""WITH r AS (SELECT lang AS query_id, source AS file, doc_id % 7 AS clues, doc_id % 3 AS declared, doc_id % 5 AS file_clues, doc_id % 11 = 0 AS anchor, doc_id % 4 = 0 AS test, (doc_id % 10) / 10.0 AS score, (doc_id % 13)::DOUBLE AS density, doc_id AS ordinal FROM documents),
  v AS (SELECT *, (file_clues + declared) * 8 + clues * 3 + anchor::INT * 8 - test::INT * 2 - score AS value FROM r), b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY query_id, file ORDER BY value DESC, density DESC, ordinal) = 1)
  SELECT query_id, file, ordinal, (row_number() OVER (PARTITION BY query_id ORDER BY value DESC, density DESC, ordinal) - 1)::INTEGER AS rank FROM b QUALIFY rank < 10""")
def rescue_ranking(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    r = table(spark, d, "documents").select(F.col("lang").alias("query_id"), F.col("source").alias("file"), (i % 7).alias("clues"), (i % 3).alias("declared"), (i % 5).alias("file_clues"), (i % 11 == 0).alias("anchor"), (i % 4 == 0).alias("test"), (i % 10 / 10).alias("score"), (i % 13).cast("double").alias("density"), i.alias("ordinal"))
    return detail.rescue_order(r, 10).select("query_id", "file", "ordinal", "rank")


@query("""WITH r AS (SELECT l_returnflag AS lane, l_linestatus AS measure, l_quantity AS value FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_linestatus = 'O')), m AS (SELECT lane, measure, avg(value) AS value FROM r GROUP BY ALL),
  n AS (SELECT * FROM (SELECT DISTINCT measure FROM r), (SELECT unnest(['N', 'R']) AS rival)) SELECT n.measure, n.rival, CASE WHEN o.value IS NULL OR t.value IS NULL THEN 'pending'
    WHEN CASE WHEN n.measure = 'F' THEN o.value <= t.value * 1.15 ELSE o.value >= t.value * 0.85 END THEN 'passed' ELSE 'failed' END AS status
  FROM n LEFT JOIN m o ON o.lane = 'A' AND o.measure = n.measure LEFT JOIN m t ON t.lane = n.rival AND t.measure = n.measure""")
def gate_status(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").where("not (l_returnflag = 'R' and l_linestatus = 'O')").select(F.col("l_returnflag").alias("lane"), F.col("l_linestatus").alias("measure"), F.col("l_quantity").alias("value"))
    return detail.gate(r, "A", ["N", "R"], 15, ("F",)).select("measure", "rival", "status")


@query("""WITH r AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS lane, 't' || (event_id % 5) AS task, (event_id // 40) % 30 AS k FROM events), u AS (SELECT lane, task, k AS repeat, count(*) AS n FROM r GROUP BY ALL),
  p AS (SELECT * FROM (SELECT unnest(['click', 'view']) AS lane), (SELECT unnest(['t0', 't1', 't2', 't3']) AS task), (SELECT unnest([0, 1, 2]) AS repeat))
  SELECT coalesce(p.lane, u.lane) AS lane, coalesce(p.task, u.task) AS task, coalesce(p.repeat, u.repeat)::INTEGER AS repeat, CASE WHEN p.lane IS NULL THEN 'unplanned' WHEN u.n IS NULL THEN 'missing' ELSE 'repeated' END AS problem
  FROM p FULL JOIN u ON p.lane = u.lane AND p.task = u.task AND p.repeat = u.repeat WHERE p.lane IS NULL OR u.n IS NULL OR u.n > 1""")
def run_coverage(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    r = e.select(F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("other").alias("lane"), F.concat(F.lit("t"), (F.col("event_id") % 5).cast("string")).alias("task"), (F.floor(F.col("event_id") / 40) % 30).cast("int").alias("repeat"))
    return detail.complete_runs(r, ["t0", "t1", "t2", "t3"], ["click", "view"], 3)


@query("""SELECT event_id, CASE WHEN date_diff('second', ts, TIMESTAMP '2024-01-20') < 86400 THEN 'fresh' WHEN date_diff('second', ts, TIMESTAMP '2024-01-20') < 604800 THEN 'aging' ELSE 'stale' END AS age FROM events""")
def index_age(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", scores.index_age(F.col("ts"), F.lit("2024-01-20").cast("timestamp")).alias("age"))


@query(f"""WITH c AS (SELECT {CODE_PATH} AS path, p_partkey, {CODE_TEXT} AS text FROM part) SELECT path, '// Part' || p_partkey || ' > size :: ' || left(array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> '')[1:3], ' '), 200) || chr(10) || text AS scoped FROM c""")
def scoped_chunks(spark: SparkSession, d: str) -> DataFrame:
    owner = F.array(F.concat(F.lit("Part"), F.col("k").cast("string")), F.lit("size"))
    return code(spark, d).select("path", detail.scoped(owner, detail.signature(F.col("text")), F.col("text")).alias("scoped"))
