"""Catalog: how files fall into chunks and symbols, what they import and export, cycles, bounded paths, weighted keywords, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import scores
from quillon.operators import analyzers, chunking, composed, evals, graph, patterns, search
from quillon.plans.catalog import query
from quillon.plans.code_plans import CODE_PATH, CODE_TEXT, code
from quillon.plans.search_plans import terms_sql
from quillon.sources import files as sources
from quillon.sources import tables
from quillon.sources.shared import keeper
from quillon.sources.tables import FILES_SQL, files, spread, table

CHUNKS4 = """l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), s AS (SELECT doc_id, lines, unnest(generate_series(0, len(lines) - 1, 4)) AS start FROM l),
  c AS (SELECT doc_id, start // 4 AS i, start + 1 AS a, least(start + 4, len(lines)) AS b, array_to_string(lines[start + 1:start + 4], chr(10)) AS content FROM s)"""


@query(f"""WITH RECURSIVE {CHUNKS4}, f AS (SELECT doc_id, i, a AS first, b - a + 1 AS n FROM c WHERE i = 0 UNION ALL
  SELECT c.doc_id, c.i, CASE WHEN f.n < 15 AND c.b - c.a + 1 < 15 THEN f.first ELSE c.a END, CASE WHEN f.n < 15 AND c.b - c.a + 1 < 15 THEN f.n ELSE 0 END + c.b - c.a + 1 FROM f JOIN c ON c.doc_id = f.doc_id AND c.i = f.i + 1)
  SELECT doc_id, first::INTEGER AS start_line, max(b)::INTEGER AS end_line, string_agg(content, chr(10) ORDER BY i) AS content FROM f JOIN c USING (doc_id, i) GROUP BY doc_id, first""")
def small_chunk_merge(spark: SparkSession, d: str) -> DataFrame:
    return chunking.merge_small(chunking.line_chunks(table(spark, d, "documents"), 4).drop("chunk"), 15)


@query(f"""WITH RECURSIVE {CHUNKS4}, t AS (SELECT *, CASE WHEN i % 5 <> 4 THEN 's' || i END AS symbol, 'p' || (i // 3) AS parent FROM c),
  f AS (SELECT doc_id, i, a AS first, b - a + 1 AS n, symbol IS NOT NULL AS named, parent FROM t WHERE i = 0 UNION ALL SELECT doc_id, i, CASE WHEN m THEN first ELSE a END, CASE WHEN m THEN n ELSE 0 END + b - a + 1, named, parent
    FROM (SELECT t.doc_id, t.i, t.a, t.b, f.first, f.n, t.symbol IS NOT NULL AS named, t.parent, f.named AND t.symbol IS NOT NULL AND f.n < 9 AND t.b - t.a + 1 < 9 AND f.parent = t.parent AS m FROM f JOIN t ON t.doc_id = f.doc_id AND t.i = f.i + 1))
  SELECT doc_id, first::INTEGER AS start_line, max(b)::INTEGER AS end_line, string_agg(content, chr(10) ORDER BY i) AS content, string_agg(symbol, '+' ORDER BY i) AS symbol, min(f.parent) AS parent FROM f JOIN (SELECT * EXCLUDE parent FROM t) USING (doc_id, i) GROUP BY doc_id, first""")
def symbol_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.line_chunks(table(spark, d, "documents"), 4)
    symbol = F.when(F.col("chunk") % 5 != 4, F.concat(F.lit("s"), F.col("chunk").cast("string")))
    parent = F.concat(F.lit("p"), F.floor(F.col("chunk") / 3).cast("string"))
    return chunking.merge_symbols(rows.select("doc_id", "start_line", "end_line", "content", symbol.alias("symbol"), parent.alias("parent")), 9)


@query(r"""WITH RECURSIVE r AS (SELECT doc_id, 1 AS start, string_split(text, chr(10)) AS lines FROM documents UNION ALL
    SELECT doc_id, CASE side WHEN 0 THEN start ELSE start + cut END, CASE side WHEN 0 THEN lines[1:cut] ELSE lines[cut + 1:] END FROM (SELECT *, coalesce(list_min(list_transform(list_filter(
      generate_series(greatest(1, len(lines) // 2 - least(20, len(lines) // 4)), least(len(lines) - 1, len(lines) // 2 + least(20, len(lines) // 4))), lambda i: regexp_matches(lines[i + 1], '^\s*(//|#|/\*|\*/)|^\s*(\};?)?\s*$')),
      lambda i: abs(i - len(lines) // 2) * 100000 + i)) % 100000 + 1, len(lines) // 2) AS cut FROM r WHERE len(lines) > 12), (SELECT unnest([0, 1]) AS side)),
  p AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS k FROM r WHERE len(lines) <= 12)
  SELECT doc_id, start::INTEGER AS start_line, (start + len(lines) - 1)::INTEGER AS end_line, array_to_string(lines, chr(10)) AS content, 'd' || doc_id || CASE WHEN n > 1 THEN ':' || k ELSE '' END AS symbol FROM p""")
def oversized_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null")
    whole = rows.select("doc_id", F.lit(1).alias("start_line"), F.size(F.split("text", "\n", -1)).alias("end_line"), F.col("text").alias("content"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("symbol"))
    return chunking.split_oversized(whole, 12)


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines, doc_id % 7 + 1 AS s, doc_id % 7 + 1 + doc_id % 3 AS e FROM documents)
  SELECT doc_id, 'c' || s AS name, greatest(s - 5, 1)::INTEGER AS start_line, least(e + 5, len(lines))::INTEGER AS end_line, array_to_string(lines[greatest(s - 5, 1):least(e + 5, len(lines))], chr(10)) AS content FROM l WHERE s <= len(lines)""")
def component_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    start = (F.col("doc_id") % 7 + 1).cast("int")
    parts = docs.where(start <= F.size(F.split("text", "\n", -1))).select("doc_id", F.concat(F.lit("c"), start.cast("string")).alias("name"), start.alias("start"), (start + F.col("doc_id") % 3).cast("int").alias("end"))
    return chunking.component_chunks(docs.select("doc_id", "text"), parts)


SYMBOLS_SQL = "symbols AS (SELECT p_brand || (p_partkey // 40) AS file, p_partkey AS id, p_size AS s, p_size + p_partkey % 13 AS e FROM part)"


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(F.concat("p_brand", F.floor(k / 40).cast("string")).alias("file"), k.alias("id"), F.col("p_size").alias("start"), (F.col("p_size") + k % 13).cast("int").alias("end"))


@query(f"""WITH {SYMBOLS_SQL}, i AS (SELECT c.file, c.id, arg_min(p.id, {{'a': p.e - p.s, 'b': p.s, 'c': p.id}}) AS parent FROM symbols c JOIN symbols p ON p.file = c.file AND p.s <= c.s AND p.e >= c.e AND (p.s < c.s OR p.e > c.e) GROUP BY ALL)
  SELECT s.file, s.id, i.parent FROM symbols s LEFT JOIN i USING (file, id)""")
def containment_tree(spark: SparkSession, d: str) -> DataFrame:
    return chunking.containment(_symbols(spark, d)).select("file", "id", "parent")


@query(f"""WITH {SYMBOLS_SQL}, cuts AS (SELECT file, s AS cut FROM symbols UNION SELECT file, e + 1 FROM symbols UNION SELECT file, unnest([1, 81]) FROM symbols),
  p AS (SELECT file, cut AS a, lead(cut) OVER (PARTITION BY file ORDER BY cut) - 1 AS b FROM cuts QUALIFY b IS NOT NULL),
  o AS (SELECT p.file, p.a, p.b, arg_min(x.id, {{'a': x.e - x.s, 'b': x.s, 'c': x.id}}) AS owner FROM p LEFT JOIN symbols x ON x.file = p.file AND x.s <= p.a AND x.e >= p.b GROUP BY ALL),
  n AS (SELECT x.file, x.id, min(y.s) AS first, max(y.e) AS last FROM symbols x JOIN symbols y ON y.file = x.file AND y.s >= x.s AND y.e <= x.e AND (y.s > x.s OR y.e < x.e) GROUP BY ALL)
  SELECT o.file, a::INTEGER AS start_line, b::INTEGER AS end_line, owner, CASE WHEN owner IS NULL THEN 'filler' WHEN n.id IS NULL THEN 'body' WHEN b < first THEN 'header' WHEN a > last THEN 'footer' ELSE 'body' END AS kind FROM o LEFT JOIN n ON n.file = o.file AND n.id = o.owner""")
def line_partition(spark: SparkSession, d: str) -> DataFrame:
    s = _symbols(spark, d)
    return chunking.partition(s, s.select("file", F.lit(80).alias("n_lines")).distinct())


@query(f"""WITH {CHUNKS4} SELECT doc_id, a::INTEGER AS start_line FROM c JOIN l USING (doc_id) WHERE doc_id % 9 = 1 OR (doc_id % 9 = 0)""")
def chunk_integrity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    rows = chunking.line_chunks(docs, 4)
    moved = rows.withColumns({"end_line": F.col("end_line") + F.when(F.col("doc_id") % 9 == 0, 1).otherwise(0), "content": F.concat("content", F.when(F.col("doc_id") % 9 == 1, "x").otherwise(""))})
    return chunking.broken(moved, docs).select("doc_id", "start_line")


@query("""SELECT doc_id, array_to_string(list_filter([lang, source, CASE WHEN doc_id % 2 = 0 THEN 'signals' END, 'f' || (doc_id % 3), CASE WHEN doc_id % 4 = 0 THEN 'standalone' END, CASE WHEN doc_id % 5 = 0 THEN 'routing' END], lambda x: x IS NOT NULL), ',') AS tags FROM documents""")
def chunk_tags(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    framework = F.concat(F.lit("f"), (i % 3).cast("string"))
    tags = chunking.tags(F.col("lang"), F.array(F.upper("source")), F.array("source"), F.when(i % 2 == 0, "signals"), F.col("lang"), framework, i % 4 == 0, i % 5 == 0)
    return table(spark, d, "documents").select("doc_id", F.array_join(tags, ",").alias("tags"))


@query(f"""WITH {FILES_SQL} SELECT doc_id, 'path: ' || path || ' type: ' || lang || CASE WHEN doc_id % 2 = 0 THEN ' component: C' || doc_id ELSE '' END || ' layer: core' || chr(10) || text AS input FROM files""")
def embedding_input(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("C"), F.col("doc_id").cast("string")))
    return files(spark, d).select("doc_id", chunking.embedding_text(F.col("path"), F.col("lang"), name, F.lit("core"), F.col("text")).alias("input"))


TESTS = "(['import { it } from ''vitest''; jest.fn()', 'jest.mock(a)', 'x = jasmine.any(A)', 'import pytest; cy.visit(u)', 'nothing'])[(p_size % 5 + 1)::INT]"


@query("""SELECT p_partkey AS path, kind, framework FROM part JOIN (SELECT * FROM (VALUES (0, 'unit', 'vitest'), (1, 'unit', 'jest'), (2, 'unit', 'jasmine'), (3, 'unit', 'pytest'), (3, 'e2e', 'cypress')) AS t(r, kind, framework)) ON r = p_size % 5""")
def test_framework_files(spark: SparkSession, d: str) -> DataFrame:
    texts = F.array(*map(F.lit, ["import { it } from 'vitest'; jest.fn()", "jest.mock(a)", "x = jasmine.any(A)", "import pytest; cy.visit(u)", "nothing"]))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.element_at(texts, F.col("p_size") % 5 + 1).alias("text"))
    return analyzers.test_frameworks(rows)


@query("SELECT event_id, round(1 / (1 + exp(-value / 100)), 9) AS p FROM events")
def logit_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(scores.sigmoid(F.col("value") / 100), 9).alias("p"))


# --------------------------------------------------------------------------- imports and exports

LINES = """'import {' || chr(10) || '  alpha' || p_partkey || ' as A, // one' || chr(10) || '  type Beta,' || chr(10) || '} from ''./m' || p_size || ''';' || chr(10) || 'import D' || p_partkey || ', * as all from "pkg' || p_size || '";' || chr(10) || 'import ''side' || p_size || ''';' || chr(10) ||
  'import type { T } from ''./m' || p_size || ''';' || chr(10) || 'export {' || chr(10) || '  one,' || chr(10) || '  two as three' || p_partkey || chr(10) || '};' || chr(10) || 'export default Main' || p_partkey || ';' || chr(10) || 'export abstract class Base' || p_partkey || ' {}' || chr(10) ||
  '// export const no = 1;' || chr(10) || 'export const v' || p_partkey || ' = 1;' || chr(10) || 'export * from ''./r' || p_size || ''';'"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "part"), "p_partkey").selectExpr(f"{CODE_PATH} AS path", f"{LINES} AS text")


@query(f"""WITH c AS (SELECT p_partkey AS k, {CODE_PATH} AS path, p_size FROM part) SELECT path, 1 AS line, './m' || p_size AS source, 'alpha' || k || ',Beta' AS names FROM c UNION ALL SELECT path, 5, 'pkg' || p_size, 'default,*' FROM c
  UNION ALL SELECT path, 6, 'side' || p_size, '' FROM c UNION ALL SELECT path, 7, './m' || p_size, 'T' FROM c""")
def import_lines(spark: SparkSession, d: str) -> DataFrame:
    return analyzers.imports(_lines(spark, d)).withColumn("names", F.array_join("names", ","))


@query(f"""WITH c AS (SELECT p_partkey AS k, {CODE_PATH} AS path FROM part) SELECT path, unnest(['one', 'three' || k, 'Base' || k, 'v' || k, 'Main' || k]) AS name, unnest([FALSE, FALSE, FALSE, FALSE, TRUE]) AS is_default FROM c""")
def export_statements(spark: SparkSession, d: str) -> DataFrame:
    return analyzers.exports(_lines(spark, d))


# --------------------------------------------------------------------------- graph


def _near_sql(least: int) -> str:
    return tables.EDGES_SQL.replace("l_quantity >= 40", f"l_quantity >= {least}")


@query(f"""WITH RECURSIVE {_near_sql(48)}, r AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM r JOIN edges e ON e.src = r.dst)
  SELECT a.src AS node, least(a.src, min(a.dst)) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src""")
def cycle_groups(spark: SparkSession, d: str) -> DataFrame:
    return graph.cycle_groups(tables.near_edges(spark, d, 48), keeper(spark)).select("node", F.col("group").alias("component"))


@query(f"""WITH {_near_sql(45)}, a AS (SELECT src AS start, 1 AS hops, [src, dst] AS path, TRUE AS simple FROM edges),
  b AS (SELECT start, 2 AS hops, list_append(path, dst) AS path, NOT list_contains(path, dst) AS simple FROM a JOIN edges ON src = path[2]), c AS (SELECT start, 3 AS hops, list_append(path, dst) AS path, NOT list_contains(path, dst) AS simple FROM b JOIN edges ON src = path[3] WHERE simple),
  f AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c), n AS (SELECT start, path[-1] AS node, hops, path FROM f WHERE simple QUALIFY row_number() OVER (PARTITION BY start, path[-1] ORDER BY hops, path) = 1),
  k AS (SELECT start, list(node) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hops, path) AS r FROM n) WHERE r < 8 GROUP BY start),
  g AS (SELECT f.*, list_contains(kept, path[-1]) AS enters FROM f JOIN k USING (start) WHERE len(list_filter(path[2:-2], lambda x: NOT list_contains(kept, x))) = 0),
  i AS (SELECT *, row_number() OVER w AS i, sum((simple AND enters)::INT) OVER w AS p FROM g WINDOW w AS (PARTITION BY start ORDER BY hops, path ROWS UNBOUNDED PRECEDING)),
  t AS (SELECT *, max(i > 20 OR (simple AND (p > 12 OR NOT enters))) OVER (PARTITION BY start) AS truncated FROM i)
  SELECT start, hops, array_to_string(path, '>') AS path, truncated FROM t WHERE simple AND enters AND i <= 20 AND p <= 12""")
def paths_capped(spark: SparkSession, d: str) -> DataFrame:
    e = tables.near_edges(spark, d, 45)
    out = graph.capped_paths(e, e.select(F.col("src").alias("node")).distinct(), nodes=8, most=12, inspections=20)
    return out.withColumn("path", F.array_join("path", ">"))


@query("""WITH e AS (SELECT 'a' || (p_partkey // 7) AS src, p_size AS line, 's' || p_size AS specifier, 'b' || (p_partkey % 900) AS dst FROM part), c AS (SELECT DISTINCT 'b' || p_partkey AS path, 'fp' || p_partkey AS f FROM part WHERE p_partkey % 3 = 0 AND p_partkey < 900)
  SELECT src, line, specifier, f AS fingerprint, TRUE AS known, count(*) AS n FROM e JOIN c ON path = dst GROUP BY ALL UNION ALL SELECT DISTINCT src, line, specifier, NULL, FALSE, 1 FROM e WHERE dst NOT IN (SELECT path FROM c)""")
def pending_edges(spark: SparkSession, d: str) -> DataFrame:
    k, part = F.col("p_partkey"), table(spark, d, "part")
    e = part.select(F.concat(F.lit("a"), F.floor(k / 7).cast("string")).alias("src"), F.col("p_size").alias("line"), F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("specifier"), F.concat(F.lit("b"), (k % 900).cast("string")).alias("dst"))
    now = part.where("p_partkey % 3 = 0 and p_partkey < 900").select(F.concat(F.lit("b"), k.cast("string")).alias("path"), F.concat(F.lit("fp"), k.cast("string")).alias("fingerprint"))
    known, lost = graph.pending(e, now)
    known = known.groupBy("src", "line", "specifier", "fingerprint").agg(F.lit(True).alias("known"), F.count("*").alias("n"))
    return known.union(lost.select("src", "line", "specifier", F.lit(None).cast("string"), F.lit(False), F.lit(1).cast("long")))


@query(f"WITH {FILES_SQL} SELECT count(DISTINCT path) AS nodes, 0::BIGINT AS edges, 0.0::DOUBLE AS average FROM files")
def stats_without_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.stats_or_files(tables.edges(spark, d).where("src = dst"), files(spark, d))


# --------------------------------------------------------------------------- patterns, dependencies, lists


@query("""WITH i AS (SELECT DISTINCT event_type AS source, 'b/c/d/u' || user_id || '.ts' AS file, event_id % 40 AS line FROM events), p AS (SELECT *, file || ':' || line AS place FROM i)
  SELECT source, count(*) AS places, count(DISTINCT file) AS files, array_to_string(list_transform(list_sort(list({'f': file, 'l': line}))[1:10], lambda x: x.f || ':' || x.l), ',') AS examples FROM p GROUP BY source""")
def package_use(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("root/a/b/c/d/u"), F.col("user_id").cast("string"), F.lit(".ts"))
    return patterns.package_use(table(spark, d, "events").select(F.col("event_type").alias("source"), path.alias("path"), (F.col("event_id") % 40).alias("line")))


@query("SELECT o_custkey AS name, arg_min(o_orderpriority, o_orderkey) AS version FROM orders GROUP BY 1")
def first_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return patterns.first_dependencies(table(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderpriority").alias("version"), F.col("o_orderkey").alias("place")))


@query("SELECT o_custkey AS customer, array_to_string(list_sort(list(DISTINCT x)), ',') AS seen FROM (SELECT o_custkey, unnest([o_orderstatus, o_orderpriority]) AS x FROM orders) GROUP BY 1")
def united_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), F.array("o_orderstatus", "o_orderpriority").alias("seen"))
    return patterns.united(rows, "customer", "seen").withColumn("seen", F.array_join("seen", ","))


@query(f"""WITH {FILES_SQL}, dates AS (SELECT path, max(ts) AS ts FROM files JOIN events ON user_id = doc_id GROUP BY path) SELECT lang AS category, source AS name, path AS file, epoch_us(ts) AS ts FROM files LEFT JOIN dates USING (path)""")
def dated_patterns(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    dates = f.join(table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts")), "doc_id").groupBy("path").agg(F.max("ts").alias("ts"))
    return patterns.with_dates(f.select(F.col("lang").alias("category"), F.col("source").alias("name"), F.col("path").alias("file")), dates).select("category", "name", "file", F.unix_micros("ts").alias("ts"))


@query(f"""WITH {FILES_SQL}, e AS (SELECT path, row_number() OVER (ORDER BY path) AS n FROM files WHERE doc_id % 3 <> 0) SELECT count(*) AS over, array_to_string(list(path ORDER BY path)[1:20], ',') AS samples FROM e WHERE n > 100""")
def file_cap(spark: SparkSession, d: str) -> DataFrame:
    rows = files(spark, d).select("path", F.when(F.col("doc_id") % 3 == 0, "ignored").alias("skip_reason"))
    return sources.capped(rows, 100)[1].withColumn("samples", F.array_join("samples", ","))


# --------------------------------------------------------------------------- search


@query(f"""WITH {CHUNKS4}, o AS (SELECT doc_id, i, doc_id * 10000 + i AS ordinal FROM c) SELECT ordinal, (SELECT count(*) > 5000 FROM o) AS partial FROM o ORDER BY ordinal LIMIT 5000""")
def searchable_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.line_chunks(table(spark, d, "documents"), 4).select((F.col("doc_id") * 10000 + F.col("chunk")).alias("ordinal"))
    return search.searchable(rows)


@query("""WITH r AS (SELECT lang AS query_id, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rank, string_split(text, ' ') AS words FROM documents) SELECT query_id, doc_id, array_to_string(words[1:3], ' ') AS callers, array_to_string(words[1:5], ' ') AS imports FROM r WHERE rank < 6""")
def compact_results(spark: SparkSession, d: str) -> DataFrame:
    words = F.slice(F.split("text", " ", -1), 1, 5)
    rows = search.ranked(table(spark, d, "documents").select(F.col("lang").alias("query_id"), "doc_id", words.alias("callers"), words.alias("imports")), [F.asc("doc_id")], 6)
    return search.compact(rows, 6, callers=3, imports=5).select("query_id", "doc_id", F.array_join("callers", " ").alias("callers"), F.array_join("imports", " ").alias("imports"))


#: Every fiftieth part as a query: names and terms, a file to open, a function, a declaration, a file's name alone.
ASKED_SQL = "CASE (p_partkey // 50) % 5 WHEN 0 THEN 'Part' || p_partkey || ' useState' WHEN 1 THEN 'open f' || p_partkey || '.ts' WHEN 2 THEN 'make' || p_partkey WHEN 3 THEN 'Part' || p_partkey ELSE 'f' || p_partkey || '.ts' END"
KIND_SQL, LAYER_SQL = "CASE p_size % 3 WHEN 0 THEN 'service' WHEN 1 THEN 'component' ELSE 'module' END", "CASE p_size % 2 WHEN 0 THEN 'core' ELSE 'feature' END"


def _asked_chunks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = spread(table(spark, d, "part"), "p_partkey")
    queries = part.where("p_partkey % 50 = 0").selectExpr("p_partkey AS query_id", ASKED_SQL.replace("//", "div") + " AS query")
    return queries, part.selectExpr("p_partkey AS id", f"{CODE_TEXT} AS content", "'Part' || p_partkey AS name", f"{CODE_PATH} AS path", f"{KIND_SQL} AS kind", f"{LAYER_SQL} AS layer", f"array({KIND_SQL}, {LAYER_SQL}) AS tags")


NOMINATED_SQL = f"""c AS (SELECT p_partkey AS id, {CODE_TEXT} AS content, 'Part' || p_partkey AS name, {CODE_PATH} AS path, {KIND_SQL} AS kind, {LAYER_SQL} AS layer FROM part), q AS (SELECT p_partkey AS query_id, {ASKED_SQL} AS query FROM part WHERE p_partkey % 50 = 0),
  named AS (SELECT query_id, id, 2 AS strength FROM q JOIN c ON regexp_extract(query, 'f[0-9]+[.]ts$') = regexp_extract(path, '[^/]+$'))"""


@query()
def search_full(spark: SparkSession, d: str) -> DataFrame:
    """Every stage of a search for each 50th part's question. Iterated ranks and two passes aren't put into SQL; its parts have their own, and tests hold it against a search by hand."""
    queries, chunks = _asked_chunks(spark, d)
    chunks = chunks.select("*", F.lit(1).alias("start_line"), F.array("name").alias("names"), F.lit(0.0).alias("centrality"), F.lit(None).cast("string").alias("trend"))
    return composed.searched(queries, chunks, keeper(spark)).select("query_id", "id", "rank", F.round("score", 6).alias("score"), "chosen", "status", "confidence")


@query(f"WITH {NOMINATED_SQL} SELECT * FROM named")
def nominated_files(spark: SparkSession, d: str) -> DataFrame:
    return search.nominated(*_asked_chunks(spark, d))


@query(f"""WITH {NOMINATED_SQL}, t AS (SELECT query_id, unnest(list_distinct({terms_sql('query')})) AS term FROM q), n AS (SELECT query_id, count(*) AS needed FROM t GROUP BY 1),
  p AS (SELECT DISTINCT id, term, field, w FROM (SELECT id, unnest({terms_sql('content')}) AS term, 'content' AS field, 0.4::DOUBLE AS w FROM c UNION ALL SELECT id, unnest({terms_sql('name')}), 'name', 0.25 FROM c UNION ALL SELECT id, unnest({terms_sql('path')}), 'path', 0.3 FROM c
    UNION ALL SELECT id, unnest({terms_sql('kind')}), 'kind', 0.15 FROM c UNION ALL SELECT id, unnest({terms_sql('layer')}), 'layer', 0.1 FROM c UNION ALL SELECT id, unnest([kind, layer]), 'tags', 0.15 FROM c)),
  h AS (SELECT query_id, id, count(DISTINCT term) AS matched, sum(w) AS mass FROM t JOIN p USING (term) GROUP BY ALL), b AS (SELECT query_id, id, mass / needed / 1.35 AS score, 0 AS strength FROM h JOIN n USING (query_id) WHERE matched = needed),
  u AS (SELECT query_id, id, max(score) AS score, max(strength) AS strength FROM (SELECT * FROM b UNION ALL SELECT query_id, id, 0, strength FROM named) GROUP BY ALL),
  x AS (SELECT u.*, lower(query) AS low, lower(path) AS path, regexp_extract(lower(path), '[^/]+$') AS base, query = name AS exact FROM u JOIN c USING (id) JOIN q USING (query_id)),
  s AS (SELECT query_id, id, strength, exact, round(least(1, least(1, least(1, least(1, score + CASE WHEN exact THEN 0.3 ELSE 0 END) + CASE WHEN regexp_replace(base, '[.]ts$', '') = regexp_replace(low, '[.]ts$', '') THEN 0.2 ELSE 0 END) + CASE WHEN contains(path, low) THEN 0.1 ELSE 0 END) + CASE strength WHEN 2 THEN 0.45 WHEN 1 THEN 0.25 ELSE 0 END), 9) AS score FROM x)
  SELECT query_id, id, score, strength::INTEGER AS strength, exact, (row_number() OVER (PARTITION BY query_id ORDER BY strength DESC, exact DESC, score DESC, id) - 1)::INTEGER AS rank FROM s QUALIFY rank < 50""")
def keyword_weighted(spark: SparkSession, d: str) -> DataFrame:
    return search.keyword_weighted(*_asked_chunks(spark, d))


# --------------------------------------------------------------------------- evaluation of answers


@query("""WITH t AS (SELECT item_id % 2 = 0 AS safe, item_id % 3 = 0 AS ready, item_id % 5 = 0 AS abstain, nullif(item_id % 4, 0) AS first_hit, CASE WHEN item_id % 4 > 0 THEN item_id % 4 <= 2 END AS target, CASE WHEN item_id % 6 > 2 THEN item_id % 6 = 3 END AS example FROM benchmark)
  SELECT count(*) AS tasks, count(*) FILTER (safe) AS safe, count(*) FILTER (NOT safe) AS unsafe, avg(target::INT) AS target_rate, avg(first_hit) AS first_hit, avg(example::INT) AS example_rate, avg(ready::INT) FILTER (safe) AS safe_ready, avg(abstain::INT) FILTER (NOT safe) AS unsafe_refused, avg(ready::INT) FILTER (NOT safe) AS unsafe_ready FROM t""")
def preflight_rates(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    rows = table(spark, d, "benchmark").select(F.when(i % 2 == 0, "safe").otherwise("unsafe").alias("risk"), (i % 3 == 0).alias("ready"), (i % 5 == 0).alias("abstain"), F.when(i % 4 > 0, i % 4).alias("first_hit"), F.when(i % 4 > 0, i % 4 <= 2).alias("target_in_top3"), F.when(i % 6 > 2, i % 6 == 3).alias("example_hit"))
    return evals.preflight_rates(rows)


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").selectExpr(
        "item_id AS task", "element_at(array('ready', 'abstain', 'partial', 'done'), cast(item_id % 4 + 1 AS int)) AS status",
        "CASE WHEN item_id % 5 = 0 THEN cast(array() AS array<struct<file:string,start:int,end:int>>) ELSE array(named_struct('file', '/repo/src/a' || item_id || '.ts', 'start', 1, 'end', 5), named_struct('file', CASE WHEN item_id % 7 = 0 THEN ' ' ELSE './b.ts' END, 'start', cast(item_id % 3 AS int), 'end', cast(item_id % 2 + 1 AS int))) END AS evidence",
        "array('/repo/src/a' || item_id || '.ts', 'c' || (item_id % 3) || '.py', '') AS referenced",
    )


@query("""WITH e AS (SELECT item_id AS task, 'src/a' || item_id || '.ts' AS file, 1 AS start, 5 AS "end", FALSE AS full_file FROM benchmark WHERE item_id % 5 <> 0 UNION ALL SELECT item_id, CASE WHEN item_id % 7 = 0 THEN ' ' ELSE 'b.ts' END, item_id % 3, item_id % 2 + 1, FALSE FROM benchmark WHERE item_id % 5 <> 0
    UNION ALL SELECT item_id, 'c' || (item_id % 3) || '.py', 1, NULL, TRUE FROM benchmark UNION ALL SELECT item_id, 'src/a' || item_id || '.ts', 1, NULL, TRUE FROM benchmark WHERE item_id % 5 = 0) SELECT task, file, start::INTEGER AS start, "end"::INTEGER AS "end", full_file FROM e""")
def answer_spans(spark: SparkSession, d: str) -> DataFrame:
    return evals.answer_files(_answers(spark, d), "/repo")


@query("""WITH f AS (SELECT item_id AS task, unnest(['src/a' || item_id || '.ts', 'c' || (item_id % 3) || '.py', 'b.ts', 'lib/t' || (item_id % 4) || '.ts']) AS file FROM benchmark UNION SELECT item_id, ' ' FROM benchmark WHERE item_id % 5 <> 0 AND item_id % 7 = 0)
  SELECT task, string_agg(file, ',' ORDER BY file) AS files FROM f GROUP BY task""")
def step_files(spark: SparkSession, d: str) -> DataFrame:
    traces = table(spark, d, "benchmark").selectExpr("item_id AS task", r"array('/Repo/lib\\t' || (item_id % 4) || '.ts', './b.ts', '') AS files")
    spans = evals.answer_files(_answers(spark, d), "/repo")
    return evals.step_files(spans, traces, "/repo").withColumn("files", F.array_join("files", ","))


@query("""SELECT item_id AS task, array_to_string(list_filter([CASE WHEN item_id % 4 = 3 THEN 'status' END, CASE WHEN item_id % 5 <> 0 AND item_id % 7 = 0 THEN 'file' END, CASE WHEN item_id % 5 <> 0 AND (item_id % 3 = 0 OR item_id % 2 + 1 < item_id % 3) THEN 'lines' END,
  CASE WHEN item_id % 4 = 0 AND item_id % 5 = 0 THEN 'false ready' END], lambda x: x IS NOT NULL), ',') AS problems FROM benchmark""")
def answer_problems(spark: SparkSession, d: str) -> DataFrame:
    return evals.answer_problems(_answers(spark, d)).withColumn("problems", F.array_join("problems", ","))
