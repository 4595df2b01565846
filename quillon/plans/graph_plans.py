"""Catalog: the import graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import scores
from quillon.operators import graph, health
from quillon.plans.catalog import query
from quillon.sources.tables import EDGES_SQL, FILES_SQL, SPARSE_SQL, edges, files, sparse_edges, table

E, S = f"WITH {EDGES_SQL}", f"WITH {SPARSE_SQL}"


@query("""SELECT l_orderkey AS src, l_suppkey AS dst, min(l_linenumber) AS line,
  array_to_string(list_sort(list(DISTINCT l_shipdate::DATE::VARCHAR) FILTER (WHERE l_returnflag <> 'R')), ',') AS symbols,
  count(DISTINCT (l_linenumber, CASE WHEN l_returnflag = 'R' THEN '*' ELSE l_shipdate::DATE::VARCHAR END)) AS proofs
  FROM lineitem GROUP BY ALL""")
def edge_merge(spark: SparkSession, d: str) -> DataFrame:
    symbol = F.when(F.col("l_returnflag") == "R", "*").otherwise(F.col("l_shipdate").cast("date").cast("string"))
    proofs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_linenumber").alias("line"), symbol.alias("symbol"))
    out = graph.merged_edges(proofs)
    return out.withColumn("symbols", F.when(F.size("symbols") > 0, F.array_join("symbols", ",")))


@query(E + " SELECT node, sum(o)::BIGINT AS fan_out, sum(i)::BIGINT AS fan_in FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY node")
def graph_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(edges(spark, d))


@query(E + " SELECT count(DISTINCT src) AS nodes, count(*) AS edges, round(count(*) / count(DISTINCT src), 1) AS average FROM edges")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.stats(edges(spark, d))


@query(E + " SELECT dst, array_to_string(list_sort(list(src)), ',') AS importers FROM edges GROUP BY dst")
def reverse_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return graph.importers(edges(spark, d)).withColumn("importers", F.array_join("importers", ","))


@query(E + ", n AS (SELECT dst AS node, count(*) AS fan_in FROM edges GROUP BY dst) SELECT node, fan_in, round(fan_in / greatest(max(fan_in) OVER (), 1), 6) AS centrality FROM n")
def centrality(spark: SparkSession, d: str) -> DataFrame:
    return graph.centrality(edges(spark, d)).withColumn("centrality", F.round("centrality", 6))


@query(E + """, n AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node)
  SELECT node, degree, row_number() OVER (ORDER BY degree DESC, node)::INTEGER AS rank FROM n ORDER BY rank LIMIT 5""")
def hotspots(spark: SparkSession, d: str) -> DataFrame:
    both = graph.degrees(edges(spark, d)).select("node", (F.col("fan_out") + F.col("fan_in")).alias("degree"))
    return graph.top(both.where("degree > 0"), 5, F.desc("degree"), F.asc("node"))


@query(E + " SELECT dst AS node, count(*) AS importers, row_number() OVER (ORDER BY count(*) DESC, dst)::INTEGER AS rank FROM edges GROUP BY dst ORDER BY rank LIMIT 8")
def key_interfaces(spark: SparkSession, d: str) -> DataFrame:
    n = edges(spark, d).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("importers"))
    return graph.top(n, 8, F.desc("importers"), F.asc("node"))


@query(E + """, n AS (SELECT dst, count(*) AS fan_in FROM edges GROUP BY dst), k AS (SELECT dst, fan_in, n_name AS layer,
  row_number() OVER (PARTITION BY n_name ORDER BY fan_in DESC, dst) AS r, count(*) OVER (PARTITION BY n_name) AS files
  FROM n JOIN supplier ON s_suppkey = dst JOIN nation ON n_nationkey = s_nationkey) SELECT layer, dst AS hub, fan_in, files FROM k WHERE r = 1""")
def hubs_by_layer(spark: SparkSession, d: str) -> DataFrame:
    layers = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("node"), F.col("n_name").alias("layer"))
    return graph.layer_hubs(edges(spark, d), layers)


@query(E + """ SELECT n_name AS layer, count(DISTINCT node) AS files FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges)
  JOIN supplier ON s_suppkey = node JOIN nation ON n_nationkey = s_nationkey GROUP BY 1""")
def map_layers(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    known = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return nodes.join(known, F.col("node") == F.col("s_suppkey")).groupBy(F.col("n_name").alias("layer")).agg(F.count("*").alias("files"))


@query(S + " SELECT DISTINCT src AS node FROM sparse WHERE src NOT IN (SELECT dst FROM sparse)")
def entrypoints(spark: SparkSession, d: str) -> DataFrame:
    return graph.entrypoints(sparse_edges(spark, d))


@query("""SELECT p_brand AS file, p_name AS name FROM part WHERE p_size <> 1 AND p_type NOT LIKE 'PROMO%'
  AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45) GROUP BY ALL
  EXCEPT SELECT p_brand, p_name FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity >= 45""")
def unused_exports(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    exports = part.select(F.col("p_brand").alias("file"), F.col("p_name").alias("name"), (F.col("p_size") == 1).alias("barrel"), F.col("p_type").startswith("PROMO").alias("test"))
    used = table(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return graph.unused_exports(exports, part.join(used, "p_partkey", "left_semi").select(F.col("p_brand").alias("file"), F.col("p_name").alias("name"))).select("file", "name").distinct()


@query(E + """, one AS (SELECT dst AS target, src AS file, 1 AS hop FROM edges),
  two AS (SELECT o.target, e.src AS file, 2 AS hop FROM one o JOIN edges e ON e.dst = o.file),
  best AS (SELECT target, file, min(hop) AS hop FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE file <> target GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY hop, file)::INTEGER AS place FROM best) SELECT * FROM k WHERE place <= 20""")
def impact_2hop(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return graph.impact(e, e.select(F.col("dst").alias("node")).distinct())


@query(S + """, a AS (SELECT src AS start, 1 AS hops, [src, dst] AS path FROM sparse),
  b AS (SELECT start, 2 AS hops, list_append(path, dst) AS path FROM a JOIN sparse ON src = path[2] WHERE NOT list_contains(path, dst)),
  c AS (SELECT start, 3 AS hops, list_append(path, dst) AS path FROM b JOIN sparse ON src = path[3] WHERE NOT list_contains(path, dst))
  SELECT start, hops, array_to_string(path, '>') AS path FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)""")
def paths_3hop(spark: SparkSession, d: str) -> DataFrame:
    e = sparse_edges(spark, d)
    return graph.paths(e, e.select(F.col("src").alias("node")).distinct()).withColumn("path", F.array_join("path", ">"))


@query(E + """, two AS (SELECT a.src AS x, a.dst AS y, NULL::BIGINT AS z FROM edges a JOIN edges b ON a.dst = b.src AND a.src = b.dst WHERE a.src < a.dst),
  three AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst)
  SELECT x || '>' || y || coalesce('>' || z, '') AS nodes, CASE WHEN z IS NULL THEN 2 ELSE 3 END AS length, CASE WHEN z IS NULL THEN 'high' ELSE 'medium' END AS severity
  FROM (SELECT * FROM two UNION ALL SELECT * FROM three)""")
def cycles_2_3(spark: SparkSession, d: str) -> DataFrame:
    c = graph.short_cycles(edges(spark, d))
    return c.select(F.array_join("nodes", ">").alias("nodes"), "length", scores.cycle_severity(F.col("length")).alias("severity"))


@query(E + """, r AS (SELECT s_suppkey AS node FROM supplier WHERE s_acctbal > 5000), c AS (SELECT DISTINCT src FROM edges WHERE dst IN (SELECT node FROM r))
  SELECT count(*) AS total, count(*) FILTER (WHERE src IN (SELECT node FROM r)) AS covered FROM c""")
def caller_coverage(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("node"))
    return graph.caller_coverage(edges(spark, d), results)


@query(E + """ SELECT src, count(DISTINCT dst) AS companions FROM edges WHERE src IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)
  AND dst IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY src""")
def anchor_corroboration(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return graph.corroborated(s.where("s_nationkey < 5").select(F.col("s_suppkey").alias("node")), edges(spark, d), s.where("s_acctbal < 0").select(F.col("s_suppkey").alias("node")))


HEALTH_SQL = E + """, d AS (SELECT node, sum(o)::BIGINT AS fan_out, sum(i)::BIGINT AS fan_in FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY node),
  c AS (SELECT node, count(*) AS cycles FROM (SELECT unnest([a.src, a.dst]) AS node FROM edges a JOIN edges b ON a.dst = b.src AND a.src = b.dst WHERE a.src < a.dst) GROUP BY node),
  x AS (SELECT l_suppkey AS node, max(l_linenumber * 4)::BIGINT AS complexity FROM lineitem GROUP BY 1),
  m AS (SELECT node, coalesce(fan_out, 0) AS fan_out, coalesce(fan_in, 0) AS fan_in, coalesce(cycles, 0) AS cycles, coalesce(complexity, 0) AS complexity
    FROM d FULL JOIN c USING (node) FULL JOIN x USING (node)),
  r AS (SELECT m.*, CASE WHEN fan_out + fan_in > 0 THEN row_number() OVER (ORDER BY fan_out + fan_in DESC, node) END AS place FROM m),
  h AS (SELECT *, (CASE WHEN cycles > 0 THEN 3 ELSE 0 END + CASE WHEN fan_in >= 8 THEN 2 WHEN fan_in >= 4 THEN 1 ELSE 0 END
    + CASE WHEN place <= 5 THEN 2 WHEN place <= 10 THEN 1 ELSE 0 END + CASE WHEN complexity >= 18 THEN 2 WHEN complexity >= 10 THEN 1 ELSE 0 END)::INTEGER AS score FROM r),
  health AS (SELECT node, fan_out, fan_in, cycles, complexity, score, CASE WHEN score >= 4 THEN 'high' WHEN score >= 2 THEN 'medium' ELSE 'low' END AS level FROM h)"""


def _health(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    cycles = graph.short_cycles(e).where("length = 2").select(F.explode("nodes").alias("node")).groupBy("node").agg(F.count("*").alias("cycles"))
    complexity = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(F.max(F.col("l_linenumber") * 4).alias("complexity"))
    return health.scored(health.metrics(graph.degrees(e), cycles, complexity))


@query(HEALTH_SQL + " SELECT * FROM health")
def health_files(spark: SparkSession, d: str) -> DataFrame:
    return _health(spark, d).select("node", "fan_out", "fan_in", "cycles", "complexity", "score", "level")


@query(HEALTH_SQL + " SELECT count(*) FILTER (WHERE level = 'high') AS high, count(*) FILTER (WHERE level = 'medium') AS medium, count(*) FILTER (WHERE level = 'low') AS low FROM health")
def health_summary(spark: SparkSession, d: str) -> DataFrame:
    return health.summary(_health(spark, d))


@query(HEALTH_SQL + " SELECT node, level, score FROM health WHERE level <> 'low' ORDER BY CASE level WHEN 'high' THEN 1 ELSE 2 END, score DESC, node LIMIT 10")
def health_worst(spark: SparkSession, d: str) -> DataFrame:
    return health.at_least(_health(spark, d), "medium").orderBy(F.desc("severity"), F.desc("score"), "node").limit(10).select("node", "level", "score")


@query(HEALTH_SQL + """, e AS (SELECT s_suppkey AS node FROM supplier WHERE s_acctbal > 8000)
  SELECT max_by(level, CASE level WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS worst, count(level) AS known, count(*) AS results FROM e LEFT JOIN health USING (node)""")
def result_health(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "supplier").where("s_acctbal > 8000").select(F.col("s_suppkey").alias("node"))
    return health.worst(results, _health(spark, d))


@query("WITH " + FILES_SQL + """, f AS (SELECT split_part(path, '/', 1) AS layer, path FROM files) SELECT layer, count(*) AS files, min(path) AS first FROM f GROUP BY layer""")
def map_segments(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    return f.groupBy(F.element_at(F.split("path", "/"), 1).alias("layer")).agg(F.count("*").alias("files"), F.min("path").alias("first"))
