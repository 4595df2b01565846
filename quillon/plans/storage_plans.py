"""Catalog: sources, generations and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import chunking, manifest
from quillon.plans.catalog import query
from quillon.sources import files as file_sources
from quillon.sources.generations import Store
from quillon.sources.shared import shared_dir
from quillon.sources.tables import FILES_SQL, files, table
from quillon.streaming import watch


def scratch(spark: SparkSession) -> str:
    """A folder that all processes of the session share."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, count(*) AS events FROM s GROUP BY user_id, k""")
def debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = watch.bursts(table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", "2 hours")
    return out.select("user_id", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "events")


@query("WITH " + FILES_SQL + " SELECT path, substr(sha256(text), 1, 16) AS hash FROM files")
def generation_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    store = Store(spark, scratch(spark))
    store.publish({"manifest": manifest.manifest(f.limit(1))}, note="replaced")
    store.publish({"manifest": manifest.manifest(f), "chunks": chunking.line_chunks(f, 50)})
    return store.open("manifest")["manifest"]


@query("""SELECT l_suppkey AS path, epoch_us(min_by(o_orderdate, l_orderkey)) AS ts FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def newest_commits(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select((F.col("o_orderkey") * 1000).alias("n"), F.concat(F.lit(":::"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("value"))
    l = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("n"), F.col("l_suppkey").cast("string").alias("value"))
    out = file_sources.newest_dates(o.union(l))
    return out.select(F.col("path").cast("long").alias("path"), F.unix_micros("ts").alias("ts"))


@query("WITH " + FILES_SQL + """, r AS (SELECT unnest(['', 'src1', 'src1/docs', 'src2', 'src3/models']) AS root) SELECT path, max_by(root, length(root)) AS root FROM files JOIN r ON root = '' OR starts_with(path, root || '/') GROUP BY path""")
def containing_root(spark: SparkSession, d: str) -> DataFrame:
    roots = spark.createDataFrame([(x,) for x in ("", "src1", "src1/docs", "src2", "src3/models")], "root string")
    return file_sources.containing_root(files(spark, d), roots)


@query("""WITH p AS (SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'nx.json' WHEN n_nationkey % 3 = 1 THEN 'package.json' ELSE 'readme.md' END AS mark, r_name || '/' || n_name AS root FROM nation JOIN region ON r_regionkey = n_regionkey)
  SELECT root, CASE WHEN mark = 'nx.json' THEN 'workspace' ELSE 'project' END AS kind, mark AS marks FROM p WHERE mark <> 'readme.md'""")
def project_discovery(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey") % 3
    mark = F.when(k == 0, "nx.json").when(k == 1, "package.json").otherwise("readme.md")
    f = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat_ws("/", "r_name", "n_name", mark).alias("path"))
    return file_sources.projects(f).withColumn("marks", F.array_join("marks", ","))
