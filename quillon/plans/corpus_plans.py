"""Catalog: files, chunks, manifests, guides, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import paths, text
from quillon.operators import chunking, manifest, spans
from quillon.plans.catalog import query
from quillon.sources.tables import FILES_SQL, files, table

W = f"WITH {FILES_SQL}"
EXT = r"""regexp_extract(lower(path), '(\.[^./]*)$', 1)"""


@query(W + rf""", e AS (SELECT *, {EXT} AS ext FROM files)
  SELECT doc_id, path, CASE ext WHEN '.ts' THEN 'typescript' WHEN '.py' THEN 'python' WHEN '.md' THEN 'markdown' WHEN '.html' THEN 'html' ELSE 'plaintext' END AS language,
    ext IN ('.ts', '.py', '.html') AS is_code, ext = '.png' AS is_binary, contains(path, '.spec.') OR contains(path, '__tests__') AS is_test, contains(path, '/docs/') AS is_documentation,
    ext = '.html' AS is_style, contains(path, '/config') AS is_root, contains(path, '/models/') AS is_definition FROM e""")
def scan_classify(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return files(spark, d).select("doc_id", "path", paths.language(p).alias("language"), paths.is_code(p).alias("is_code"), paths.is_binary(p).alias("is_binary"), paths.is_test(p).alias("is_test"), paths.is_documentation(p).alias("is_documentation"), paths.is_style(p).alias("is_style"), paths.is_composition_root(p).alias("is_root"), paths.is_definition_heavy(p, F.lit(None).cast("string")).alias("is_definition"))


@query(W + rf""", e AS (SELECT *, CASE WHEN {EXT} = '.png' THEN 'binary' WHEN {EXT} NOT IN ('.ts', '.py', '.html') THEN 'not code' WHEN octet_length(encode(text)) > 8192 THEN 'too large' ELSE 'eligible' END AS reason FROM files)
  SELECT reason, count(*) AS files, sum(octet_length(encode(text)))::BIGINT AS bytes FROM e GROUP BY reason""")
def scan_preview(spark: SparkSession, d: str) -> DataFrame:
    p, size = F.col("path"), F.octet_length("text")
    reason = F.when(paths.is_binary(p), "binary").when(~paths.is_code(p), "not code").when(size > 8192, "too large").otherwise("eligible")
    return files(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("files"), F.sum(size).cast("long").alias("bytes"))


@query(W + r""" SELECT path, NOT (regexp_matches(path, '(^|/)(tests?|__tests__|specs?|__specs__)(/|$)') OR regexp_matches(path, '\.(test|spec)\.[^/]+$')) AS eligible FROM files""")
def map_eligible(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("path", paths.is_map_eligible(F.col("path")).alias("eligible"))


def _line_chunks(size: int, overlap: int) -> str:
    return f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
  s AS (SELECT doc_id, lines, unnest(generate_series(0, greatest(len(lines) - 1 - {overlap}, 0), {size - overlap})) AS start FROM l)
  SELECT doc_id, (start // {size - overlap})::INTEGER AS chunk, (start + 1)::INTEGER AS start_line, least(start + {size}, len(lines))::INTEGER AS end_line,
    array_to_string(lines[start + 1:start + {size}], chr(10)) AS content FROM s"""


@query(_line_chunks(5, 0))
def line_chunks_5(spark: SparkSession, d: str) -> DataFrame:
    return chunking.line_chunks(table(spark, d, "documents"), 5)


@query(_line_chunks(5, 1))
def line_chunks_overlap(spark: SparkSession, d: str) -> DataFrame:
    return chunking.line_chunks(table(spark, d, "documents"), 5, 1)


@query(f"WITH c AS ({_line_chunks(5, 0)}) SELECT lang, count(DISTINCT doc_id) AS files, count(*) AS chunks, sum(end_line - start_line + 1)::BIGINT AS lines, round(avg(length(content)), 3) AS average FROM c JOIN documents USING (doc_id) GROUP BY lang")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    c = chunking.line_chunks(docs.select(F.struct("doc_id", "lang").alias("doc_id"), "text"), 5).select("doc_id.doc_id", "doc_id.lang", "start_line", "end_line", "content")
    return c.groupBy("lang").agg(F.countDistinct("doc_id").alias("files"), F.count("*").alias("chunks"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("lines"), F.round(F.avg(F.length("content")), 3).alias("average"))


CODE = "replace(replace(replace(replace(text, ' the ', ' if ('), ' and ', ' && '), ' de ', ' case '), ' of ', ' else if (')"


@query(f"""WITH c AS (SELECT doc_id, {CODE} AS code FROM documents) SELECT doc_id, 1 + len(regexp_extract_all(code, '\\bif\\s*\\('))
  + len(regexp_extract_all(code, '\\belse\\s+if\\s*\\(')) + len(regexp_extract_all(code, '\\bfor\\s*\\(')) + len(regexp_extract_all(code, '\\bcase\\s+')) + len(regexp_extract_all(code, '&&'))
  + len(regexp_extract_all(code, '\\|\\|')) AS complexity FROM c""")
def complexity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.complexity(F.expr(CODE)).cast("long").alias("complexity"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS hash, sha256(text) AS fingerprint FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"), text.content_hash(F.col("text"), 64).alias("fingerprint"))


OLD = "SELECT path, substr(sha256(text), 1, 16) AS hash FROM files WHERE doc_id % 10 <> 3"
NEW = "SELECT path, substr(sha256(CASE WHEN doc_id % 10 = 5 THEN text || '!' ELSE text END), 1, 16) AS hash FROM files WHERE doc_id % 10 <> 4"


def _manifests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The corpus before and after an edit: a tenth of the paths is new, a tenth is gone, a tenth has another text."""
    f = files(spark, d)
    edited = F.when(F.col("doc_id") % 10 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return manifest.manifest(f.where("doc_id % 10 <> 3")), manifest.manifest(f.where("doc_id % 10 <> 4").withColumn("text", edited))


@query(W + f""", o AS ({OLD}), n AS ({NEW}) SELECT path, CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'deleted' WHEN o.hash <> n.hash THEN 'changed' ELSE 'unchanged' END AS status
  FROM o FULL JOIN n USING (path)""")
def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    return manifest.diff(*_manifests(spark, d))


STALE = W + f""", o AS ({OLD}), n AS ({NEW}), s AS (SELECT doc_id, CASE WHEN o.hash IS NULL THEN 'corrupt' WHEN n.hash IS NULL OR n.hash <> o.hash THEN 'stale' ELSE 'current' END AS state
  FROM files LEFT JOIN o USING (path) LEFT JOIN n USING (path))"""


@query(STALE + " SELECT * FROM s")
def stale_filter(spark: SparkSession, d: str) -> DataFrame:
    return manifest.freshness(files(spark, d).select("doc_id", "path"), *_manifests(spark, d)).select("doc_id", "state")


@query(STALE + " SELECT count(*) FILTER (WHERE state = 'stale') AS stale, count(*) FILTER (WHERE state = 'current') AS current, 'partial' AS status FROM s")
def source_coverage(spark: SparkSession, d: str) -> DataFrame:
    return manifest.coverage(manifest.freshness(files(spark, d).select("doc_id", "path"), *_manifests(spark, d)))


@query(W + f""", o AS ({OLD}), n AS ({NEW}), d AS (SELECT path, CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'deleted' WHEN o.hash <> n.hash THEN 'changed' ELSE 'unchanged' END AS status
  FROM o FULL JOIN n USING (path)) SELECT path, hash FROM o WHERE path NOT IN (SELECT path FROM d WHERE status IN ('changed', 'deleted'))
  UNION ALL SELECT path, hash FROM n WHERE path IN (SELECT path FROM d WHERE status IN ('changed', 'added'))""")
def incremental_rebuild(spark: SparkSession, d: str) -> DataFrame:
    old, new = _manifests(spark, d)
    return manifest.rebuilt(old, manifest.diff(old, new), new)


def _guide(d: DataFrame) -> DataFrame:
    return d.select("conv_id", "turn", chunking.sections(F.concat(F.lit("Intro.\n## "), F.replace("text", F.lit("\n"), F.lit("\n## ")))).alias("s"))


@query("""WITH p AS (SELECT conv_id, turn, string_split(text, chr(10)) AS heads FROM conversations),
  r AS (SELECT conv_id, turn, 0 AS pos, NULL AS heading, 'Intro.' AS body FROM p UNION ALL
  SELECT conv_id, turn, unnest(generate_series(1, len(heads))) AS pos, trim(unnest(heads)) AS heading, '' AS body FROM p) SELECT conv_id, turn, pos::INTEGER AS pos, heading, body FROM r""")
def section_split(spark: SparkSession, d: str) -> DataFrame:
    return _guide(table(spark, d, "conversations")).select("conv_id", "turn", F.posexplode("s").alias("pos", "x")).select("conv_id", "turn", "pos", "x.heading", "x.body")


@query("""SELECT i.item_id, count(*) AS documents, min(doc_id) AS first FROM benchmark i JOIN documents d ON contains(d.text, i.text) GROUP BY i.item_id""")
def containment(spark: SparkSession, d: str) -> DataFrame:
    # An equi-join on five words, then the exact test. An item's first and last word may be parts of words in the document, those between are whole.
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("item")).withColumn("w", F.split("item", "[ \n]"))
    items = items.withColumn("k", F.array_join(F.slice("w", 2, 5), " ")).withColumn("n", F.size("w"))
    docs = table(spark, d, "documents").select("doc_id", "text").withColumn("w", F.split("text", "[ \n]"))
    at = F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1)))
    # Keys travel without the text, which is joined once to the candidates that remain.
    keys = docs.select("doc_id", F.explode(F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice("w", i, 5), " ")))).alias("k"))
    near = keys.join(items.where("n >= 7").select("item_id", "k"), "k").select("doc_id", "item_id").distinct()
    hit = near.join(docs.select("doc_id", "text"), "doc_id").join(items.select("item_id", "item"), "item_id").where(F.contains("text", F.col("item")))
    odd = items.where("n < 7")
    return hit.select("item_id", "doc_id").union(docs.join(odd, F.contains("text", F.col("item"))).select("item_id", "doc_id")).distinct().groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first"))


@query(r"""SELECT doc_id, n FROM (SELECT doc_id, len(regexp_extract_all(' ' || replace(text, ' ', '  ') || ' ', '[^\p{L}\p{N}_$]the[^\p{L}\p{N}_$]')) AS n FROM documents) WHERE n > 0""")
def symbol_references(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.occurrences(F.col("text"), F.lit("the")).cast("long").alias("n")).where("n > 0")


@query(r"""WITH o AS (SELECT doc_id, contains(text, 'the') AS candidate, len(regexp_extract_all(' ' || replace(text, ' ', '  ') || ' ', '[^\p{L}\p{N}_$]the[^\p{L}\p{N}_$]')) AS n FROM documents)
  SELECT count(*) AS files, count(*) FILTER (WHERE candidate) AS candidates, count(*) FILTER (WHERE n > 0) AS matched, sum(n)::BIGINT AS usages, sum(n) <= 10 AS complete FROM o""")
def reference_coverage(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "documents").select(F.contains("text", F.lit("the")).alias("candidate"), text.occurrences(F.col("text"), F.lit("the")).alias("n"))
    return o.agg(F.count("*").alias("files"), F.count_if("candidate").alias("candidates"), F.count_if(F.col("n") > 0).alias("matched"), F.sum("n").alias("usages"), (F.sum("n") <= 10).alias("complete"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n, len(string_split(text, chr(10))) AS total FROM documents),
  s AS (SELECT doc_id, greatest(n - 2, 1) AS a, least(n + 2, total) AS b FROM l WHERE contains(line, 'tion')),
  f AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 OR row_number() OVER (PARTITION BY doc_id ORDER BY a, b) = 1 THEN 1 ELSE 0 END AS new FROM s),
  i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM f)
  SELECT doc_id, min(a)::INTEGER AS start, max(b)::INTEGER AS "end", count(*) AS parts FROM i GROUP BY doc_id, island""")
def span_merge(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "documents").select("doc_id", F.size(chunking.lines_of(F.col("text"))).alias("n_lines"), F.posexplode(chunking.lines_of(F.col("text"))).alias("pos", "line"))
    hits = l.where(F.contains("line", F.lit("tion"))).select("doc_id", (F.col("pos") + 1).alias("line"), "n_lines")
    return spans.merged(spans.around(hits, 2), "doc_id")


@query(W + """ SELECT path, regexp_extract(path, '^[^/]+') AS owner, array_to_string(string_split(path, '/')[-2:], '/') AS short, 'path:' || substr(sha1(path), 1, 8) AS hidden FROM files""")
def path_forms(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return files(spark, d).select("path", F.element_at(F.split("path", "/"), 1).alias("owner"), paths.tail(p, 2).alias("short"), paths.redacted(p).alias("hidden"))


