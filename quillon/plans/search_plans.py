"""Catalog: queries and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import paths, text
from quillon.operators import chunking, graph, preflight, search
from quillon.plans.catalog import query
from quillon.sources.tables import EDGES_SQL, FILES_SQL, edges, files, table

STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
WEAK = ", ".join(f"'{w}'" for w in text.STOP_WORDS + text.WEAK_WORDS)


def terms_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9_]+'), lambda t: length(t) > 2 AND t NOT IN ({STOPS}))"


#: Test queries: each benchmark item asks for its first two terms.
QUERIES_SQL = f"queries AS (SELECT item_id AS query_id, text AS query, unnest({terms_sql('text')}[1:2]) AS term FROM benchmark)"


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.explode(F.slice(text.query_terms(F.col("text")), 1, 2)).alias("term"))


@query(f"""WITH {QUERIES_SQL}, l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), s AS (SELECT doc_id, lines, unnest(generate_series(0, len(lines) - 1, 5)) AS start FROM l),
  c AS (SELECT doc_id, start // 5 AS chunk, array_to_string(lines[start + 1:start + 5], chr(10)) AS content FROM s), t AS (SELECT doc_id, chunk, unnest({terms_sql('content')}) AS term FROM c),
  p AS (SELECT doc_id, chunk, term, count(*) AS tf FROM t GROUP BY ALL), q AS (SELECT DISTINCT query_id, term FROM queries),
  h AS (SELECT query_id, doc_id, chunk, count(*) AS matched, sum(tf)::BIGINT AS score FROM q JOIN p USING (term) GROUP BY ALL), n AS (SELECT query_id, count(*) AS needed FROM q GROUP BY 1),
  b AS (SELECT h.*, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk) AS f FROM h JOIN n USING (query_id) WHERE matched = needed),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk) - 1 AS rank FROM b WHERE f = 1)
  SELECT r.query_id, r.doc_id, r.chunk::INTEGER AS chunk, r.score, r.rank::INTEGER AS rank, split_part(c.content, chr(10), 1) AS snippet FROM r JOIN c ON c.doc_id = r.doc_id AND c.chunk = r.chunk WHERE rank < 10""")
def keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    chunks = chunking.line_chunks(table(spark, d, "documents"), 5)
    asked = _queries(spark, d)
    hits = search.keyword_matches(asked, search.postings(chunks, ["doc_id", "chunk"], "content", asked), ["doc_id", "chunk"])
    best = search.ranked(search.first_of_file(hits, [F.desc("score"), F.asc("chunk")]), [F.desc("score"), F.asc("doc_id"), F.asc("chunk")], 10)
    first = F.get(F.split("text", "\n", -1), F.col("chunk") * 5)  # of the few chunks that are left, from their documents
    return best.join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("query_id", "doc_id", "chunk", "score", "rank", first.alias("snippet"))


@query(f"SELECT doc_id, array_to_string({terms_sql('text')}, ' ') AS terms FROM documents")
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(text.query_terms(F.col("text")), " ").alias("terms"))


ASKED = "(['how to navigate after login', 'UserService provider', 'configure the theme', 'inject a guard', 'handle http request', 'roles and permissions', 'list all items', 'where is routing setup'])[(item_id % 8 + 1)::INT]"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.expr(ASKED.replace("([", "element_at(array(").replace("])[(", "), cast(").replace(")::INT]", " as int))").replace("item_id % 8 + 1", "item_id % 8 + 1")).alias("query"))


@query(f"""WITH q AS (SELECT item_id AS query_id, {ASKED} AS query FROM benchmark) SELECT query_id, CASE WHEN regexp_matches(query, '[a-z][A-Z]') THEN 'EXACT_NAME'
  WHEN regexp_matches(lower(query), 'config|setup|routing|providers|bootstrap') THEN 'CONFIG' WHEN regexp_matches(lower(query), 'provide|inject|dependency|register|wire|module') THEN 'WIRING'
  WHEN regexp_matches(lower(query), 'navigate|redirect|route|handle|process|execute|trigger|dispatch') THEN 'FLOW' ELSE 'CONCEPTUAL' END AS intent,
  CASE WHEN regexp_matches(query, '[a-z][A-Z]') THEN 0.4 WHEN regexp_matches(lower(query), 'config|setup|routing|providers|bootstrap|provide|inject|dependency|register|wire|module') THEN 0.5
  WHEN regexp_matches(lower(query), 'navigate|redirect|route|handle|process|execute|trigger|dispatch') THEN 0.6 ELSE 0.7 END::DOUBLE AS semantic FROM q""")
def query_intent(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("query_id", text.intent(F.col("query")).alias("i")).select("query_id", "i.intent", "i.semantic")


RULES = " ".join(f"|| CASE WHEN regexp_matches(query, '(?i)\\b({p})\\b') THEN {t!r} ELSE [] END" for p, t in text.EXPANSIONS)


@query(f"""WITH q AS (SELECT item_id AS query_id, {ASKED} AS query FROM benchmark), a AS (SELECT query_id, query, []::VARCHAR[] {RULES} AS raw FROM q),
  o AS (SELECT query_id, query, list_filter(list_transform(raw, lambda t, i: CASE WHEN list_position(raw, t) = i THEN t END), lambda t: t IS NOT NULL AND NOT contains(lower(query), t)) AS added FROM a)
  SELECT query_id, 0 AS variant, query, 1.0::DOUBLE AS weight FROM o
  UNION ALL SELECT query_id, 1, query || ' ' || array_to_string(added[1:6], ' '), 0.35 FROM o WHERE len(added) > 0 UNION ALL SELECT query_id, 2, query || ' ' || array_to_string(added[7:12], ' '), 0.25 FROM o WHERE len(added) > 6""")
def query_variants(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("query_id", F.posexplode(text.variants(F.col("query"))).alias("variant", "v")).select("query_id", "variant", "v.query", "v.weight")


SINGULAR = "CASE WHEN length(w) > 5 AND w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' WHEN length(w) > 4 AND w LIKE '%s' AND NOT regexp_matches(w, '(ss|us)$') THEN left(w, length(w) - 1) ELSE w END"
STEM = "regexp_replace(w, '(ed|ing)$', '')"


@query(f"""WITH u AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[a-zA-Z0-9]+'))) AS w FROM benchmark), s AS (SELECT DISTINCT {SINGULAR} AS w FROM u), t AS (SELECT w, {STEM} AS stem FROM s),
  c AS (SELECT *, stem <> w AND length(stem) >= 4 AS ok, length(stem) > 1 AND right(stem, 1) = substr(stem, length(stem) - 1, 1) AND regexp_matches(stem, '[b-df-hj-np-tv-z]$') AS twice FROM t)
  SELECT w AS word, array_to_string(list_filter([w, CASE WHEN ok THEN stem END, CASE WHEN ok THEN stem || 'e' END, CASE WHEN ok AND twice THEN left(stem, length(stem) - 1) END], lambda x: x IS NOT NULL), ' ') AS aliases FROM c""")
def lexical_aliases(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "benchmark").select(F.explode(text.words(F.lower("text"))).alias("word")).distinct()
    return w.select("word", F.array_join(text.aliases(F.col("word")), " ").alias("aliases"))


@query(r"""SELECT p_partkey, p_name || 'XMLParserTest' || p_size AS name, array_to_string(list_transform(regexp_extract_all(regexp_replace(regexp_replace(p_name || 'XMLParserTest' || p_size, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[a-zA-Z0-9]+'), lambda x: lower(x)), ' ') AS words FROM part""")
def camel_words(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("p_name", F.lit("XMLParserTest"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", name.alias("name"), F.array_join(text.words(name), " ").alias("words"))


@query(f"""WITH {FILES_SQL}, q AS (SELECT DISTINCT 'src' AS a), f AS (SELECT path, lower(regexp_extract(path, '[^/]+$')) AS base FROM files)
  SELECT path, CASE WHEN contains('open en21.ts or src3/docs', base) THEN 2 WHEN contains('open en21.ts or src3/docs', regexp_replace(base, '\\.[^.]*$', '')) THEN 1 ELSE 0 END::INTEGER AS strength,
    len(list_filter({terms_sql('path')}, lambda t: t IN ('open', 'en21', 'src3', 'docs')))::INTEGER AS overlap FROM f""")
def path_token_rank(spark: SparkSession, d: str) -> DataFrame:
    asked = F.lit("open en21.ts or src3/docs")
    overlap = F.size(F.filter(text.query_terms(F.col("path")), lambda t: F.array_contains(text.query_terms(asked), t)))
    return files(spark, d).select("path", paths.path_strength(F.col("path"), asked).alias("strength"), overlap.alias("overlap"))


@query(f"""WITH h AS (SELECT lang AS query_id, source AS file, doc_id, n_chars, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS r FROM documents) SELECT query_id, file, doc_id FROM h WHERE r = 1""")
def file_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("lang").alias("query_id"), F.col("source").alias("file"), "doc_id", "n_chars")
    return search.first_of_file(rows, [F.desc("n_chars"), F.asc("doc_id")], "file").drop("n_chars")


@query("SELECT doc_id FROM documents WHERE lang = 'fr' AND source = 'src3' AND list_has_any(string_split(text, ' '), ['de', 'la'])")
def chunk_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").withColumn("tags", F.split("text", " ", -1))
    return search.filtered(rows, {"lang": "fr", "source": "src3"}, ["de", "la"]).select("doc_id")


WORDS_SQL = "list_transform(regexp_extract_all(regexp_replace(regexp_replace(text, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[a-zA-Z0-9]+'), lambda x: lower(x))"


def _alias_sql(source: str) -> str:
    return f"""SELECT *, unnest(list_filter([w, CASE WHEN ok THEN stem END, CASE WHEN ok THEN stem || 'e' END, CASE WHEN ok AND twice THEN left(stem, length(stem) - 1) END], lambda x: x IS NOT NULL)) AS alias
  FROM (SELECT *, stem <> w AND length(stem) >= 4 AS ok, length(stem) > 1 AND right(stem, 1) = substr(stem, length(stem) - 1, 1) AND regexp_matches(stem, '[b-df-hj-np-tv-z]$') AS twice FROM (SELECT *, {STEM} AS stem FROM {source}))"""


@query(f"""WITH bw AS (SELECT item_id, unnest({WORDS_SQL}) AS w0, unnest(generate_series(1, len({WORDS_SQL}))) AS i FROM benchmark), bs AS (SELECT item_id, i, {SINGULAR.replace('(w)', '(w0)').replace('(w,', '(w0,').replace(' w ', ' w0 ').replace('ELSE w END', 'ELSE w0 END').replace('left(w0', 'left(w0')} AS w FROM bw),
  bf AS (SELECT item_id, w, min(i) AS i FROM bs WHERE length(w) >= 4 AND w NOT IN ({WEAK}) GROUP BY ALL), bq AS (SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY i) AS n FROM bf),
  qa AS ({_alias_sql("(SELECT item_id, n, w FROM bq WHERE n <= 12)")}), dw AS (SELECT doc_id, unnest({WORDS_SQL}) AS w0 FROM documents), ds AS (SELECT doc_id, {SINGULAR.replace('(w)', '(w0)').replace('(w,', '(w0,').replace(' w ', ' w0 ').replace('ELSE w END', 'ELSE w0 END')} AS w FROM dw),
  total AS (SELECT doc_id, count(*) AS words FROM ds GROUP BY 1), tf AS (SELECT doc_id, w, count(*) AS tf FROM ds GROUP BY ALL), da AS ({_alias_sql("tf")}),
  h AS (SELECT item_id AS query_id, doc_id, n, max(tf) AS tf FROM qa JOIN da USING (alias) GROUP BY ALL), g AS (SELECT query_id, doc_id, count(*) AS clues, sum(sqrt(tf)) AS mass FROM h GROUP BY ALL HAVING count(*) >= 2)
  SELECT query_id, doc_id, clues, round(mass / sqrt(words), 6) AS density FROM g JOIN total USING (doc_id)""")
def rescue_two_clue(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search.rescued(q, table(spark, d, "documents"), "doc_id", "text").withColumn("density", F.round("density", 6))


@query(f"""WITH bw AS (SELECT item_id, unnest({WORDS_SQL}) AS w0 FROM benchmark), bs AS (SELECT item_id, {SINGULAR.replace('(w)', '(w0)').replace('(w,', '(w0,').replace(' w ', ' w0 ').replace('ELSE w END', 'ELSE w0 END')} AS w FROM bw)
  SELECT item_id, array_to_string(list_sort(list(DISTINCT alias)), ' ') AS evidence FROM ({_alias_sql("bs")}) GROUP BY item_id""")
def evidence_set(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(text.evidence(F.col("text"))), " ").alias("evidence"))


COS = "list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _asking(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 50 as a query."""
    return table(spark, d, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def _vector_sql(k: int, where: str = "TRUE") -> str:
    return f"""v0 AS (SELECT q.vec_id AS query_id, v.vec_id, greatest(0, {COS}) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0 AND {where}),
  near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM v0 QUALIFY rank < {k})"""


@query(f"WITH {_vector_sql(10)} SELECT query_id, vec_id, round(score, 6) AS score, rank::INTEGER AS rank FROM near")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.nearest(_asking(spark, d), table(spark, d, "embeddings"), 10).withColumn("score", F.round("score", 6))


@query(f"WITH {_vector_sql(10, 'v.label = 3')} SELECT query_id, vec_id, round(score, 6) AS score, rank::INTEGER AS rank FROM near")
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return search.nearest(_asking(spark, d), table(spark, d, "embeddings"), 10, F.col("label") == 3).withColumn("score", F.round("score", 6))


#: Two channels of each query: the nearest vectors, and the documents with most of one of five terms.
HYBRID_SQL = f"""WITH {_vector_sql(50)}, k0 AS (SELECT q.query_id, doc_id, len(string_split(text, q.term)) - 1 AS n FROM documents, (SELECT vec_id AS query_id, ([' the ', ' de ', ' und ', ' of ', ' la '])[(vec_id // 50 % 5 + 1)::INT] AS term FROM embeddings WHERE vec_id % 50 = 0) q),
  kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_id) - 1 AS rank FROM k0 WHERE n > 0 QUALIFY rank < 50),
  lists AS (SELECT query_id, vec_id AS id, rank, 0.7 AS weight FROM near UNION ALL SELECT query_id, doc_id, rank, 0.3 FROM kw), rrf AS (SELECT query_id, id, sum(weight / (60 + rank)) / (1.0 / 60) AS rrf, count(*) AS lists FROM lists GROUP BY ALL)"""


TERMS = [" the ", " de ", " und ", " of ", " la "]


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    asking = _asking(spark, d)
    term = F.element_at(F.array(*map(F.lit, TERMS)), (F.floor(F.col("query_id") / 50) % 5 + 1).cast("int"))
    return _fused(spark, d, asking, asking.select("query_id", term.alias("term")))


def _fused(spark: SparkSession, d: str, asking: DataFrame, asked: DataFrame) -> DataFrame:
    """Both channels of the queries ``asking`` for vectors and ``asked`` for one of the five terms; a term is counted and ranked once."""
    near = search.nearest(asking, table(spark, d, "embeddings"), 50).select("query_id", F.col("vec_id").alias("id"), "rank", F.lit(0.7).alias("weight"))
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    count = F.size(F.split("text", F.col("term"), -1)) - 1
    kw = table(spark, d, "documents").join(F.broadcast(terms)).select(F.col("term").alias("query_id"), "doc_id", count.alias("n")).where("n > 0")  # five rows
    kw = search.ranked(kw, [F.desc("n"), F.asc("doc_id")], 50).select(F.col("query_id").alias("term"), F.col("doc_id").alias("id"), "rank", F.lit(0.3).alias("weight"))
    return search.fused(near.union(asked.join(F.broadcast(kw), "term").select("query_id", "id", "rank", "weight")))


@query(HYBRID_SQL + " SELECT query_id::BIGINT AS query_id, id, round(rrf, 6) AS rrf, lists FROM rrf")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).withColumn("rrf", F.round("rrf", 6))


SCORED_SQL = HYBRID_SQL + f""", {FILES_SQL}, x AS (SELECT r.query_id, r.id, r.rrf, f.path, lower(f.path) AS p, f.lang FROM rrf r JOIN files f ON f.doc_id = r.id),
  m AS (SELECT *, rrf * 1.1 * (CASE WHEN lang = 'en' THEN 1.1 ELSE 1 END) * (CASE WHEN contains(p, '/models/') THEN 0.82 ELSE 1 END) * (CASE WHEN p LIKE '%.html' THEN 0.75 ELSE 1 END)
    * (CASE WHEN contains(p, '/config') THEN 1.12 * 1.2 ELSE 1 END) * (CASE WHEN id % 10 = 1 THEN 1.15 WHEN id % 10 = 2 THEN 0.9 ELSE 1 END) * (CASE WHEN (id % 10) / 10.0 > 0.1 THEN 1 + 0.15 * (id % 10) / 10.0 ELSE 1 END) * (CASE WHEN id % 17 = 0 THEN 1.15 ELSE 1 END) AS score FROM x)"""


def _scored(spark: SparkSession, d: str, fused: DataFrame) -> DataFrame:
    rows = fused.join(files(spark, d).select(F.col("doc_id").alias("id"), "path", "lang"), "id")
    trend = F.when(F.col("id") % 10 == 1, "Rising").when(F.col("id") % 10 == 2, "Declining")
    by = search.multiplier(F.lit("module"), F.when(F.col("lang") == "en", "core").otherwise("unknown"), F.col("path"), F.lit("how to setup the config provider"), F.lit("CONFIG"), F.col("id") % 10 / 10, trend, F.col("id") % 17 == 0)
    return rows.withColumn("score", F.col("rrf") * by)


@query(SCORED_SQL + " SELECT query_id::BIGINT AS query_id, id, round(score, 9) AS score FROM m")
def hybrid_scored(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, _hybrid(spark, d)).select("query_id", "id", F.round("score", 9).alias("score"))


QUALITY_SQL = f"""WITH {_vector_sql(5, "v.vec_id <> q.vec_id")}, t AS (SELECT query_id, max(score) AS top, min(score) AS third, max(score) FILTER (WHERE rank = 1) AS second, avg(score) AS average, avg((vec_id % 3 = 0)::INT) AS tests, count(*) AS n FROM near WHERE rank < 3 GROUP BY 1),
  s AS (SELECT *, top < 0.3 AS low, average < 0.32 AS weak, top - second < 0.03 AS tight, query_id % 2 = 1 AND tests >= 0.67 AS tested FROM t),
  quality AS (SELECT query_id, (low::INT + weak::INT + tight::INT + tested::INT)::INTEGER AS signals, round(greatest(0, least(1, top - CASE WHEN weak THEN 0.08 ELSE 0 END - CASE WHEN tight THEN 0.05 ELSE 0 END - CASE WHEN tested THEN 0.15 ELSE 0 END)), 2) AS confidence, top, third, n FROM s),
  judged AS (SELECT *, CASE WHEN signals >= 2 OR confidence < 0.35 THEN 'low_confidence' ELSE 'ok' END AS status FROM quality)"""


def _quality(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    asked = _asking(spark, d)
    rows = search.nearest(asked, table(spark, d, "embeddings"), 6).where("query_id <> vec_id")
    rows = search.ranked(rows.drop("rank"), [F.desc("score"), F.asc("vec_id")], 5).withColumn("test", F.col("vec_id") % 3 == 0)
    return rows, search.quality(rows, asked.select("query_id", (F.col("query_id") % 2 == 0).alias("testing")))


@query(QUALITY_SQL + " SELECT query_id, signals, confidence, status FROM judged")
def search_quality(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d)[1]


@query(QUALITY_SQL + " SELECT query_id, n >= 3 AND top - third < 0.08 AS ambiguous FROM judged")
def ambiguity_gate(spark: SparkSession, d: str) -> DataFrame:
    return search.ambiguous(_quality(spark, d)[0])


RERANKED_SQL = (
    QUALITY_SQL + """, g AS (SELECT query_id, n >= 3 AND top - third < 0.08 AS a FROM judged)
  SELECT query_id, vec_id, (row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN a THEN vec_id ELSE NULL END DESC NULLS LAST, rank) - 1)::INTEGER AS final_rank FROM near JOIN g USING (query_id)"""
)


@query(RERANKED_SQL)
def rerank_gated(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = _quality(spark, d)
    return search.reranked(rows, search.ambiguous(rows), lambda r: r["vec_id"].cast("double")).select("query_id", "vec_id", "final_rank")


SECOND_SQL = (
    QUALITY_SQL + """, b AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN 'ok' ELSE 'low_confidence' END AS s2, query_id % 10 / 10.0 AS c2 FROM judged)
  SELECT query_id, CASE WHEN status <> 'ok' AND ((s2 = 'ok' AND c2 >= confidence) OR c2 >= confidence + 0.05) THEN 'second' ELSE 'first' END AS chosen FROM judged JOIN b USING (query_id)"""
)


def _second_pass(first: DataFrame) -> DataFrame:
    second = first.select("query_id", F.when(F.col("query_id") % 3 == 0, "ok").otherwise("low_confidence").alias("status"), (F.col("query_id") % 10 / 10).alias("confidence"))
    return search.better_pass(first, second)


@query(SECOND_SQL)
def second_pass_choice(spark: SparkSession, d: str) -> DataFrame:
    return _second_pass(_quality(spark, d)[1])


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'xie') OR contains(lower(text), 'blea') THEN 'Declining' WHEN contains(lower(text), 'tion') THEN 'Rising' ELSE 'Stable' END AS trend FROM documents""")
def content_trend(spark: SparkSession, d: str) -> DataFrame:
    p = spark.createDataFrame([("Xie", "Declining"), ("blea", "Declining"), ("TION", "Rising"), ("a", "Stable")], "name string, trend string")
    return search.content_trend(table(spark, d, "documents"), p, "doc_id", "text")


@query(f"""WITH {FILES_SQL}, e AS (SELECT DISTINCT a.path AS src, regexp_replace(b.path, '^[^/]+/', '') AS dst FROM files a JOIN files b ON b.doc_id = a.doc_id + 1), r AS (SELECT path FROM files WHERE doc_id % 50 = 0)
  SELECT DISTINCT r.path, e.src FROM r, e WHERE suffix(r.path, e.dst) OR suffix(e.dst, r.path)""")
def suffix_importers(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d).select("doc_id", "path")
    after = f.select((F.col("doc_id") - 1).alias("doc_id"), F.regexp_replace("path", "^[^/]+/", "").alias("dst"))
    return search.suffix_importers(f.where("doc_id % 50 = 0").select("path"), f.join(after, "doc_id").select(F.col("path").alias("src"), "dst"))


@query(f"""WITH {FILES_SQL}, s AS (SELECT path, regexp_replace(regexp_extract(path, '[^/]+$'), '(\\.(spec|test))?\\.[^.]*$', '') AS stem FROM files), t AS (SELECT '__tests__/' || lang || doc_id || '.test.ts' AS test, lang || doc_id AS stem FROM files WHERE doc_id % 4 = 0)
  SELECT path, test FROM s JOIN t USING (stem)""")
def test_candidates(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    tests = f.where("doc_id % 4 = 0").select(F.concat(F.lit("__tests__/"), "lang", F.col("doc_id").cast("string"), F.lit(".test.ts")).alias("path"))
    return search.test_candidates(f.select("path"), tests)


@query("""WITH a AS (SELECT lang AS query_id, doc_id AS id FROM documents WHERE doc_id % 3 = 0), b AS (SELECT lang AS query_id, doc_id AS id FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0), u AS (SELECT *, 0 AS source FROM a UNION ALL SELECT *, 1 FROM b)
  SELECT query_id, id, min(source)::INTEGER AS source FROM u GROUP BY ALL""")
def union_first(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"))
    return search.union_first([x.where("id % 3 = 0"), x.where("id % 3 <> 0 or id % 2 = 0")])


LOCK_SQL = """WITH t AS (SELECT item_id AS task, item_id % 5 AS results, item_id % 3 AS patterns, item_id % 4 AS notes, item_id % 6 AS stale_notes, (item_id % 7 = 0)::INT AS failures, item_id % 4 AS conflicts, item_id % 9 AS callers, item_id % 2 AS covered,
    CASE WHEN item_id % 8 = 1 THEN 'low_confidence' ELSE 'ok' END AS quality, (['fresh', 'aging', 'stale', 'fresh', 'fresh'])[(item_id % 5 + 1)::INT] AS age FROM benchmark),
  s AS (SELECT *, CASE WHEN results >= 3 THEN 1.0 WHEN results > 0 THEN 0.5 ELSE 0.0 END AS code, CASE WHEN patterns >= 2 THEN 1.0 WHEN patterns = 1 THEN 0.5 ELSE 0.0 END AS pattern, CASE WHEN notes >= 2 OR failures > 0 THEN 1.0 WHEN notes = 1 THEN 0.5 ELSE 0.0 END AS note FROM t),
  c AS (SELECT *, (code = 1)::INT + (pattern = 1)::INT + (note = 1)::INT AS strong, (code = 0.5)::INT + (pattern = 0.5)::INT + (note = 0.5)::INT AS weak FROM s),
  u AS (SELECT *, CASE WHEN code = 1 AND strong >= 2 THEN 'pass' WHEN code > 0 AND (strong >= 1 OR weak >= 2) THEN 'warn' ELSE 'block' END AS first,
    least(conflicts, 3) + (notes + stale_notes > 0 AND stale_notes / nullif(notes + stale_notes, 0) > 0.5)::INT + (3 - strong - weak >= 2)::INT + (callers > 3 AND covered / greatest(callers, 1) < 0.4)::INT AS stress FROM c),
  a AS (SELECT *, stress >= 3 OR (stress = 2 AND first <> 'pass') AS abstain FROM u),
  f AS (SELECT *, CASE WHEN age = 'stale' THEN 'block' WHEN (abstain OR quality = 'low_confidence') AND first = 'pass' THEN 'warn' ELSE first END AS status FROM a)
  SELECT task, floor(45 * code + 30 * pattern + 25 * note + 0.5)::INTEGER AS score, status, stress::BIGINT AS stress, abstain, status = 'pass' AND NOT abstain AND quality <> 'low_confidence' AS ready FROM f"""


@query(LOCK_SQL)
def evidence_lock(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    ages = F.element_at(F.array(*map(F.lit, ["fresh", "aging", "stale", "fresh", "fresh"])), (i % 5 + 1).cast("int"))
    t = table(spark, d, "benchmark").select(i.alias("task"), (i % 5).alias("results"), (i % 3).alias("patterns"), (i % 4).alias("notes"), (i % 6).alias("stale_notes"), (i % 7 == 0).cast("int").alias("failures"), (i % 4).alias("conflicts"), (i % 9).alias("callers"), (i % 2).alias("covered"), F.when(i % 8 == 1, "low_confidence").otherwise("ok").alias("quality"), ages.alias("age"))
    return preflight.evidence(t).select("task", "score", "status", F.col("stress").cast("long").alias("stress"), "abstain", "ready")


@query(f"""WITH {EDGES_SQL}, i AS (SELECT dst AS target, src AS file FROM edges UNION SELECT a.dst, b.src FROM edges a JOIN edges b ON b.dst = a.src), n AS (SELECT target, count(DISTINCT file) AS affected FROM i WHERE file <> target GROUP BY 1),
  c AS (SELECT x AS target, count(*) AS cycles FROM (SELECT unnest([a.src, a.dst]) AS x FROM edges a JOIN edges b ON a.dst = b.src AND a.src = b.dst WHERE a.src < a.dst) GROUP BY 1)
  SELECT target, least(affected, 20) AS affected, coalesce(cycles, 0) AS cycles, CASE WHEN coalesce(cycles, 0) > 0 OR affected > 10 THEN 'high' WHEN affected > 3 THEN 'medium' ELSE 'low' END AS risk FROM n LEFT JOIN c USING (target)""")
def preflight_risk(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    n = graph.impact(e, e.select(F.col("dst").alias("node")).distinct()).groupBy("target").agg(F.count("*").alias("affected"))
    c = graph.short_cycles(e).where("length = 2").select(F.explode("nodes").alias("target")).groupBy("target").agg(F.count("*").alias("cycles"))
    return preflight.risk(n.join(c, "target", "left").withColumn("cycles", F.coalesce("cycles", F.lit(0))))
