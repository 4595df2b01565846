"""Hybrid retrieval: ranked lists from keywords, paths, clues and vectors, fused by reciprocal ranks and scored.

Everything works on a frame of queries at once, ``query_id`` being part of every key, so that one query or a million
are the same plan. Third-party fuzzy matching is not reproduced: a term matches a token exactly, or at one edit if asked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillon.functions import paths, text
from quillon.operators import detail, neighbours

RRF_K = 60
# Fixed value: queries that are sent to the tasks at once.
BLOCK = 50_000
# Fixed value: tasks to which the rows of a word are dealt.
SHARES = 64


def postings(rows: DataFrame, key: list[str], body: str, only: DataFrame | None = None) -> DataFrame:
    """``key, term, tf``: how often each query term stands in a row's text; with ``only``, a frame of terms, just these, filtered before anything is shuffled."""
    words = rows.select(*key, F.explode(text.query_terms(F.col(body))).alias("term"))
    if only is not None:
        words = words.join(only.select("term").distinct(), "term", "left_semi")
    return words.groupBy(*key, "term").agg(F.count("*").alias("tf"))


def keyword_matches(queries: DataFrame, posts: DataFrame, key: list[str], every: bool = True) -> DataFrame:
    """``query_id, key, matched, score``: rows that hold all (or any) terms of ``queries(query_id, term)``; the score is the sum of their counts."""
    need = queries.select("query_id", "term").distinct()
    hit = need.join(posts, "term").groupBy("query_id", *key).agg(F.count("*").alias("matched"), F.sum("tf").alias("score"))
    if not every:
        return hit
    n = need.groupBy("query_id").agg(F.count("*").alias("needed"))
    return hit.join(n, "query_id").where("matched = needed").drop("needed")


def close_terms(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``queries`` with terms of the vocabulary at one edit or none; candidates share their first two or their last two letters."""
    def keys(t: Column) -> Column:
        return F.array(F.concat(F.lit("<"), F.substring(t, 1, 2)), F.concat(F.lit(">"), F.substring(t, -2, 2)))

    q = queries.select("query_id", F.col("term").alias("asked"), F.explode(keys(F.col("term"))).alias("k"))
    v = vocabulary.select("term", F.explode(keys(F.col("term"))).alias("k"))
    return q.join(v, "k").where(F.levenshtein("asked", "term", 1) >= 0).select("query_id", "asked", "term").distinct()


def ranked(rows: DataFrame, order: list[Column], keep: int | None = None, name: str = "rank") -> DataFrame:
    """Ranks from 0 within each query; with ``keep`` only the first so many."""
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    if keep is not None:
        out = out.where(F.col(name) <= keep)  # in this form each task keeps only so many rows of a query before the shuffle
    return out.withColumn(name, F.col(name) - 1)


def first_of_file(rows: DataFrame, order: list[Column], file: str = "doc_id") -> DataFrame:
    """The best row of each file."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", file).orderBy(*order))).where("__n = 1").drop("__n")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, filters: Column | None = None) -> DataFrame:
    """The k vectors most similar to each query's, by exact cosine; filters apply before.

    Queries are sent to the tasks in blocks of about 50,000, each against all vectors in matrix products (:mod:`quillon.operators.neighbours`);
    a task holds one block of vectors at a time and gives few more than its own k best of a query.
    """
    v = (vectors if filters is None else vectors.where(filters)).select("vec_id", "embedding")
    asked = queries.select("query_id", F.col("embedding").alias("asked"))
    context = vectors.sparkSession.sparkContext
    schema = StructType([StructField("query_id", asked.schema["query_id"].dataType), StructField("vec_id", v.schema["vec_id"].dataType), StructField("score", DoubleType())])
    v = v.repartition(context.defaultParallelism)  # one small file would be one task
    n = -(-asked.count() // BLOCK) or 1
    block = F.pmod(F.xxhash64("query_id"), F.lit(n))

    def against(part: DataFrame) -> DataFrame:
        sent = context.broadcast(neighbours.asked(part.toArrow()))
        return v.mapInArrow(lambda batches: neighbours.nominate(batches, sent.value, k), schema)

    rows = reduce(DataFrame.union, [against(asked if n == 1 else asked.where(block == b)) for b in range(n)])
    return ranked(rows, [F.desc("score"), F.asc("vec_id")], k)


def fused(lists: DataFrame, weights: float = 1.0) -> DataFrame:
    """Reciprocal rank fusion of ``(query_id, id, rank, weight)`` rows, over the largest score possible."""
    return lists.groupBy("query_id", "id").agg((F.sum(F.col("weight") / (RRF_K + F.col("rank"))) / (weights / RRF_K)).alias("rrf"), F.count("*").alias("lists"))


# How much each field of a chunk counts for a keyword; a path counts as itself and as its relative form.
FIELDS = {"content": 0.4, "name": 0.25, "path": 0.15 + 0.15, "kind": 0.15, "layer": 0.1, "tags": 0.15}


def path_tokens(query: Column) -> Column:
    """Last segments of the words of a query that look like paths or file names, in lower case."""
    parts = F.filter(F.split(F.lower(query), r"[\s'\"`(),;]+"), lambda w: w.rlike(r"[\w-]+[./][\w./-]*\w$"))
    return F.array_distinct(F.transform(parts, lambda w: F.element_at(F.split(w, "/"), -1)))


def nominated(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, id, strength`` of chunks whose file a query names: 2 by its base name, 1 without its extension. An equi-join on names."""
    asked = queries.select("query_id", F.explode(path_tokens(F.col("query"))).alias("token")).distinct()
    base = F.lower(paths.base_name(F.col("path")))
    names = F.array(F.struct(base.alias("token"), F.lit(2).alias("strength")), F.struct(F.regexp_replace(base, r"\.[^.]*$", "").alias("token"), F.lit(1).alias("strength")))
    own = chunks.select("id", F.explode(names).alias("n")).select("id", "n.token", "n.strength")
    stems = asked.select("query_id", F.explode(F.array_distinct(F.array("token", F.regexp_replace("token", r"\.[^.]*$", "")))).alias("token"))
    return stems.join(own, "token").groupBy("query_id", "id").agg(F.max("strength").alias("strength"))


def keyword_weighted(queries: DataFrame, chunks: DataFrame, keep: int = 50) -> DataFrame:
    """``query_id, id, score, strength, exact, rank``: chunks ``(id, content, name, path, kind, layer, tags)`` that hold all of a query's terms, and those it names.

    The score is the weighted share of terms in each field; then an exact declaration adds 0.3, the file's name as query 0.2, the query within the path 0.1 and a named
    file 0.45 or 0.25, never beyond 1. Named files come first, then exact declarations, then scores.
    """
    lists = {c: F.coalesce(text.query_terms(F.col(c) if c != "tags" else F.array_join("tags", " ")), F.array().cast("array<string>")) for c in FIELDS}
    wanted = queries.select("query_id", F.array_distinct(text.query_terms(F.col("query"))).alias("terms")).where(F.size("terms") > 0)
    asked = wanted.select("query_id", F.explode("terms").alias("term"), F.size("terms").alias("needed"))
    # Only chunks with a query's rarest term are looked at: a term of most chunks meets no query that has a rarer one.
    posts = chunks.select("id", F.explode(F.array_distinct(F.concat(*lists.values()))).alias("term"))
    spread = posts.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("chunks"))
    rarest = asked.join(spread, "term").groupBy("query_id", "needed").agg(F.count("*").alias("known"), F.min_by("term", F.struct("chunks", "term")).alias("term"))
    rarest = rarest.where("known = needed").select("query_id", "term")
    near = rarest.join(posts.join(rarest.select("term").distinct(), "term", "left_semi"), "term").select("query_id", "id")
    rows = near.join(chunks.select("id", *FIELDS), "id").join(wanted, "query_id").select("query_id", "id", "terms", *[v.alias(f"in_{c}") for c, v in lists.items()])
    rows = rows.where(F.size(F.array_except("terms", F.concat(*[F.col(f"in_{c}") for c in FIELDS]))) == 0)
    mass = sum((F.size(F.array_intersect("terms", F.col(f"in_{c}"))) * w for c, w in FIELDS.items()), F.lit(0.0))
    hit = rows.select("query_id", "id", (mass / F.size("terms") / sum(FIELDS.values())).alias("base"), F.lit(0).alias("strength"))
    both = hit.union(nominated(queries, chunks).select("query_id", "id", F.lit(0.0), "strength")).groupBy("query_id", "id").agg(F.max("base").alias("score"), F.max("strength").alias("strength"))
    rows = both.join(chunks.select("id", "name", "path"), "id").join(queries.select("query_id", "query"), "query_id")
    low, base = F.lower("query"), F.lower(paths.base_name(F.col("path")))
    rows = rows.withColumn("exact", F.coalesce(detail.exact_declaration(F.array("name"), F.col("query")), F.lit(False)))
    same = (base == low) | (F.regexp_replace(base, r"\.ts$", "") == F.regexp_replace(low, r"\.ts$", ""))
    strength = F.when(F.col("strength") == 2, 0.45).when(F.col("strength") == 1, 0.25).otherwise(0.0)
    for boost in (F.when(F.col("exact"), 0.3).otherwise(0.0), F.when(same, 0.2).otherwise(0.0), F.when(F.contains(F.lower("path"), low), 0.1).otherwise(0.0), strength):
        rows = rows.withColumn("score", F.least(F.lit(1.0), F.col("score") + boost))
    rows = rows.withColumn("score", F.round("score", 9))  # sums in another order are no other rank
    return ranked(rows, [F.desc("strength"), F.desc("exact"), F.desc("score"), F.asc("id")], keep).select("query_id", "id", "score", "strength", "exact", "rank")


def searchable(chunks: DataFrame, most: int = 5000, order: str = "ordinal") -> DataFrame:
    """The first ``most`` chunks in the order of a scan, with ``partial``, whether there are more; only those that stay are sorted."""
    over = chunks.select(F.lit(1)).limit(most + 1).agg((F.count("*") > most).alias("partial"))
    return chunks.orderBy(order).limit(most).join(F.broadcast(over))  # one row


def compact(rows: DataFrame, most: int = 6, **lists: int) -> DataFrame:
    """The first ``most`` results of each query, their list columns cut to the lengths given."""
    return rows.where(F.col("rank") < most).withColumns({c: F.slice(c, 1, n) for c, n in lists.items()})


def clue_hits(queries: DataFrame, rows: DataFrame, key: list[str], body: str) -> DataFrame:
    """``query_id, *key, n, tf``: how often the n-th clue of a query stands in a row, in any inflection."""
    q = queries.select("query_id", F.posexplode(text.clues(F.col("query"))).alias("n", "word")).select("query_id", "n", F.explode(text.aliases(F.col("word"))).alias("alias"))
    # The words that a clue matches are made of its aliases; only these are counted.
    wanted = q.select("query_id", "n", F.explode(text.inflections(F.col("alias"))).alias("w")).distinct()
    seen = rows.select(*key, F.explode(text.words(F.col(body))).alias("w")).join(F.broadcast(wanted.select("w").distinct()), "w", "left_semi")  # distinct words of the queries
    # A word of most rows meets its clues in many tasks, not in one.
    tf = seen.groupBy(*key, "w").agg(F.count("*").alias("tf")).withColumn("share", F.pmod(F.xxhash64(*key), F.lit(SHARES)))
    dealt = wanted.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
    return dealt.join(tf, ["w", "share"]).groupBy("query_id", *key, "n").agg(F.max("tf").alias("tf"))


def rescued(queries: DataFrame, rows: DataFrame, key: str, body: str) -> DataFrame:
    """Rows that hold at least two of a query's clues, in any inflection: ``clues`` and ``density``. Rows of one key are one text."""
    total = rows.select(key, F.size(text.words(F.col(body))).alias("n_words")).where("n_words > 0").groupBy(key).agg(F.sum("n_words").alias("n_words"))
    hit = clue_hits(queries, rows, [key], body).groupBy("query_id", key).agg(F.count("*").alias("clues"), F.sum(F.sqrt("tf")).alias("mass"))
    return hit.where("clues >= 2").join(total, key).select("query_id", key, "clues", (F.col("mass") / F.sqrt("n_words")).alias("density"))


def union_first(lists: list[DataFrame], key: str = "id") -> DataFrame:
    """Rows of several lists, a key's first list winning."""
    rows = reduce(DataFrame.unionByName, [x.withColumn("source", F.lit(i)) for i, x in enumerate(lists)])
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", key).orderBy("source"))).where("__n = 1").drop("__n")


def multiplier(kind: Column, layer: Column, path: Column, query: Column, intent: Column, centrality: Column, trend: Column, exact: Column) -> Column:
    """What a fused score is multiplied with, by what is known of the chunk and the query."""
    action = text.has_word(query, "how|where|configure|configured|setup|register|wire|wiring|navigate|redirect|login|authenticate|copy|upload|handle|create|update|delete")
    wiring = text.has_word(query, "route|router|routing|navigate|navigation|redirect|auth|authentication|login|provider|register|config|configuration|interceptor|middleware")
    typed = F.coalesce(kind != "unknown", F.lit(False))
    service = F.coalesce(kind.isin("service", "interceptor", "guard", "resolver", "controller"), F.lit(False))
    root, style = paths.is_composition_root(path), paths.is_style(path)
    asked = text.query_terms(query)
    overlap = F.size(F.filter(text.query_terms(path), lambda t: F.array_contains(asked, t)))
    rules = [
        (typed, 1.1), (F.coalesce(layer != "unknown", F.lit(False)), 1.1), (action & paths.is_definition_heavy(path, kind), 0.82), (action & service, 1.06),
        ((action | wiring | (intent == "FLOW")) & style, 0.75), (wiring & root, 1.12), ((intent == "FLOW") & service, 1.15), ((intent == "CONFIG") & root, 1.2),
        ((intent == "WIRING") & typed, 1.18), ((intent == "WIRING") & root, 1.22), (overlap >= 2, 1.08), (F.coalesce(trend == "Rising", F.lit(False)), 1.15), (F.coalesce(trend == "Declining", F.lit(False)), 0.9), (exact, 1.15),
    ]
    out = reduce(Column.__mul__, [F.when(test, F.lit(by)).otherwise(F.lit(1.0)) for test, by in rules])
    return out * F.when(centrality > 0.1, 1 + 0.15 * centrality).otherwise(F.lit(1.0))


def quality(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Confidence in each query's results ``(query_id, rank from 0, score, test)``; ``queries`` has ``testing``, whether tests are asked for."""
    t = rows.where("rank < 3").groupBy("query_id").agg(F.max(F.when(F.col("rank") == 0, F.col("score"))).alias("top"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("second"), F.avg("score").alias("average"), F.avg(F.col("test").cast("int")).alias("tests"), F.count("*").alias("n"))
    t = queries.join(t, "query_id", "left")
    low, weak = F.col("top") < 0.3, F.col("average") < 0.32
    tight = (F.col("n") > 1) & (F.greatest(F.lit(0.0), F.col("top") - F.coalesce("second", "top")) < 0.03)
    tested = ~F.col("testing") & (F.col("tests") >= 0.67)
    none = F.col("n").isNull()
    signals = F.when(none, 1).otherwise(sum((x.cast("int") for x in (low, weak, tight, tested)), F.lit(0)))
    cut = F.when(weak, 0.08).otherwise(0.0) + F.when(tight, 0.05).otherwise(0.0) + F.when(tested, 0.15).otherwise(0.0)
    sure = F.when(none, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("top") - cut)), 2))
    rows = t.withColumn("signals", signals).withColumn("confidence", sure)
    return rows.select("query_id", "signals", "confidence", F.when(none | (F.col("signals") >= 2) | (F.col("confidence") < 0.35), "low_confidence").otherwise("ok").alias("status"))


def ambiguous(rows: DataFrame, gap: float = 0.08) -> DataFrame:
    """``query_id, ambiguous``: the first and the third of at least three results lie within ``gap``."""
    t = rows.where("rank < 3").groupBy("query_id").agg(F.max("score").alias("top"), F.min("score").alias("third"), F.count("*").alias("n"))
    return t.select("query_id", ((F.col("n") >= 3) & (F.col("top") - F.col("third") < gap)).alias("ambiguous"))


def reranked(rows: DataFrame, gate: DataFrame, scorer=None, k: int = 10) -> DataFrame:
    """``rows`` with ``final_rank``; where the gate is open the first k are ordered by ``scorer``, a function of the rows' columns. Without one nothing moves."""
    rows = rows.join(gate, "query_id", "left")
    asked = F.coalesce("ambiguous", F.lit(False)) & (F.col("rank") < k)
    by = F.when(asked, scorer(rows)) if scorer else F.lit(None).cast("double")
    w = Window.partitionBy("query_id").orderBy((F.col("rank") >= k).cast("int"), F.desc_nulls_last(by), "rank")
    return rows.withColumn("final_rank", F.row_number().over(w) - 1).drop("ambiguous")


def better_pass(first: DataFrame, second: DataFrame, gain: float = 0.05) -> DataFrame:
    """For each query which of two quality rows to keep. A good first is kept; else the second if it is good and no less sure, or surer by ``gain``."""
    s = second.select("query_id", F.col("status").alias("s2"), F.col("confidence").alias("c2"))
    wins = (F.col("status") != "ok") & F.col("s2").isNotNull() & (((F.col("s2") == "ok") & (F.col("c2") >= F.col("confidence"))) | (F.col("c2") >= F.col("confidence") + gain))
    return first.join(s, "query_id", "left").select("query_id", F.when(wins, "second").otherwise("first").alias("chosen"))


def filtered(chunks: DataFrame, equal: dict[str, str], any_tag: list[str] | None = None, tags: str = "tags") -> DataFrame:
    """Chunks whose columns have the given values and that have one of the tags."""
    for c, v in equal.items():
        chunks = chunks.where(F.col(c) == v)
    return chunks.where(F.arrays_overlap(tags, F.array(*map(F.lit, any_tag)))) if any_tag else chunks


def content_trend(chunks: DataFrame, patterns: DataFrame, key: str, body: str) -> DataFrame:
    """Rising, Declining or Stable by the pattern names ``(name, trend)`` in a chunk's text; declining ones decide first.

    The pattern table is bounded by the number of pattern categories and is folded into one row of arrays.
    """
    names = patterns.agg(F.collect_set(F.when(F.col("trend") == "Declining", F.lower("name"))).alias("down"), F.collect_set(F.when(F.col("trend") == "Rising", F.lower("name"))).alias("up"))
    low = F.lower(F.col(body))
    rows = chunks.join(F.broadcast(names))  # one row
    return rows.select(key, F.when(F.exists("down", lambda p: F.contains(low, p)), "Declining").when(F.exists("up", lambda p: F.contains(low, p)), "Rising").otherwise("Stable").alias("trend"))


def suffix_importers(results: DataFrame, edges: DataFrame, depth: int = 4) -> DataFrame:
    """Importers of each result, a path matching another if either ends with the other; by equal tails of whole segments, not by a nested loop."""
    def tails(c: str) -> Column:
        parts = F.split(c, "/")
        return F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda k: F.array_join(F.slice(parts, -k, k), "/"))

    r = results.select("path", F.explode(tails("path")).alias("t"), F.size(F.split("path", "/")).alias("n"))
    e = edges.select("src", "dst", F.explode(tails("dst")).alias("t"), F.size(F.split("dst", "/")).alias("m"))
    hit = r.join(e, "t").where(F.col("path").endswith(F.col("dst")) | F.col("dst").endswith(F.col("path")))
    return hit.select("path", "src").distinct()


def test_candidates(results: DataFrame, files: DataFrame) -> DataFrame:
    """Test files of each result: same base name, then ``.spec.`` or ``.test.``."""
    def stem(c: str) -> Column:
        return F.regexp_replace(paths.base_name(F.col(c)), r"(\.(spec|test))?\.[^.]*$", "")

    t = files.where(paths.base_name(F.col("path")).rlike(r"\.(spec|test)\.")).select(F.col("path").alias("test"), stem("path").alias("stem"))
    return results.select("path", stem("path").alias("stem")).join(t, "stem").where("path <> test").select("path", "test")
