"""The whole of a search as one plan for any number of queries: keywords with rescue, vectors, fusion, scoring, a second pass, reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import paths, text
from quillon.operators import detail, search

#: What chunks need: ``id, path, start_line, content, name, kind, layer, tags, names, centrality, trend``.
STRICT = 0.4
Near = Callable[[DataFrame], DataFrame]
Keep = Callable[[DataFrame, str], DataFrame]


def nominations(queries: DataFrame, chunks: DataFrame, keep: int = 50) -> DataFrame:
    """``query_id, id, distance``: for queries that keywords don't answer, the best chunk of each file that holds two of their clues or more, over all its chunks.

    The distance is one less the share of clues in the file and in the chunk's own declarations, equally weighted. Exact names don't nominate by themselves.
    """
    hits = search.clue_hits(queries, chunks, ["id", "path"], "content")
    files = hits.groupBy("query_id", "path").agg(F.countDistinct("n").alias("file_clues")).where("file_clues >= 2")
    own = hits.groupBy("query_id", "id", "path").agg(F.count("*").alias("clues"), F.sum(F.sqrt("tf")).alias("mass"))
    said = chunks.where(F.size("names") > 0).select("id", F.array_join("names", " ").alias("said"))
    declared = search.clue_hits(queries, said, ["id"], "said").groupBy("query_id", "id").agg(F.count("*").alias("declared"))
    long = chunks.select("id", F.size(text.words(F.col("content"))).alias("n_words"))
    rows = own.join(files, ["query_id", "path"]).join(declared, ["query_id", "id"], "left").join(long, "id")
    rows = rows.select("query_id", "id", F.col("path").alias("file"), "clues", F.coalesce("declared", F.lit(0)).alias("declared"), "file_clues", F.lit(False).alias("anchor"), paths.is_test(F.col("path")).alias("test"), F.lit(0.0).alias("score"), (F.col("mass") / F.sqrt("n_words")).alias("density"), F.col("id").alias("ordinal"))
    asked = queries.select("query_id", F.size(text.clues(F.col("query"))).alias("asked"))
    best = detail.rescue_order(rows, keep).join(asked, "query_id")
    return best.select("query_id", "id", (1 - (F.col("file_clues") + F.col("declared")) / (F.col("asked") * 2)).alias("distance"))


def keyword_list(queries: DataFrame, chunks: DataFrame, keep: int = 50) -> DataFrame:
    """``query_id, id, rank`` by keywords; where the best strict match is absent or farther than 0.4, by clues too. The smaller distance of a chunk counts."""
    strict = search.keyword_weighted(queries, chunks, keep).select("query_id", "id", (1 - F.col("score")).alias("distance"))
    sure = strict.groupBy("query_id").agg(F.min("distance").alias("best")).where(F.col("best") <= STRICT)
    rescue = nominations(queries.join(sure, "query_id", "left_anti"), chunks, keep)
    both = strict.union(rescue).groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    return search.ranked(both, [F.asc("distance"), F.asc("id")], keep).select("query_id", "id", "rank")


def one_pass(forms: DataFrame, queries: DataFrame, chunks: DataFrame, k: int, near: Near | None = None, keep: int = 50) -> DataFrame:
    """``query_id, id, path, score, rank, test``: the k best files for the ``forms(query_id, variant, query, weight)`` of ``queries(query_id, query)``."""
    asked = queries.select("query_id", F.col("query").alias("asked"), text.intent(F.col("query")).alias("i"))
    own = forms.select(F.struct("query_id", "variant").alias("query_id"), "query")
    weighed = forms.select("query_id", "variant", "weight").join(asked, "query_id")

    def weighted(rows: DataFrame, by: str) -> DataFrame:
        rows = rows.select("query_id.query_id", "query_id.variant", "id", "rank").join(weighed, ["query_id", "variant"])
        return rows.select("query_id", "id", "rank", (F.col("weight") * F.col(f"i.{by}")).alias("weight"))

    lists = weighted(keyword_list(own, chunks, keep), "keyword")
    share = F.col("i.keyword")
    if near is not None:
        lists, share = lists.union(weighted(near(own), "semantic")), share + F.col("i.semantic")
    most = weighed.groupBy("query_id").agg(F.sum(F.col("weight") * share).alias("most"))
    rows = search.fused(lists).join(most, "query_id").join(chunks.drop("content", "tags", "name"), "id").join(asked, "query_id")
    exact = F.coalesce(detail.exact_declaration(F.coalesce("names", F.array().cast("array<string>")), F.col("asked")), F.lit(False))
    by = search.multiplier(F.col("kind"), F.col("layer"), F.col("path"), F.col("asked"), F.col("i.intent"), F.coalesce("centrality", F.lit(0.0)), F.col("trend"), exact)
    rows = rows.withColumn("score", F.col("rrf") / F.col("most") * by)
    best = search.first_of_file(rows, [F.desc("score"), F.asc("start_line"), F.asc("id")], "path")
    order: list[Column] = [F.desc("score"), F.desc(paths.path_strength(F.col("path"), F.col("asked"))), F.asc("path")]
    return search.ranked(best, order, k).select("query_id", "id", "path", "score", "rank", paths.is_test(F.col("path")).alias("test"))


def judged(rows: DataFrame, queries: DataFrame) -> DataFrame:
    return search.quality(rows, queries.select("query_id", text.has_word(F.col("query"), "tests?|testing|spec|mock").alias("testing")))


def searched(queries: DataFrame, chunks: DataFrame, keep: Keep, k: int = 5, near: Near | None = None, scorer: Callable[[DataFrame], Column] | None = None, fresh: DataFrame | None = None) -> DataFrame:
    """``query_id, id, path, score, rank, chosen, status, confidence``: the k best files of each query.

    Only chunks of ``fresh`` paths count, if given. A query of low confidence that has expansions is asked again with these alone, weighted 1 and 0.8, and the better pass stays.
    Where the first three lie close together, ``scorer`` orders them. ``keep(df, name)`` writes a pass aside, since it is judged, chosen from and ranked. A query without
    clues, terms and neighbours gives no rows.
    """
    if fresh is not None:
        chunks = chunks.join(fresh.select("path"), "path", "left_semi")
    queries, chunks = queries.select("query_id", "query"), keep(chunks, "chunks")  # read some twenty times
    forms = queries.select("query_id", F.posexplode(text.variants(F.col("query"))).alias("variant", "v")).select("query_id", "variant", "v.query", "v.weight")
    first = keep(one_pass(forms, queries, chunks, k, near), "first")
    q1 = keep(judged(first, queries), "judged")
    weak = forms.where("variant > 0").join(q1.where("status <> 'ok'"), "query_id", "left_semi").withColumn("weight", F.when(F.col("variant") == 1, 1.0).otherwise(0.8))
    again = queries.join(weak, "query_id", "left_semi")
    second = keep(one_pass(weak, again, chunks, k, near), "second")
    q2 = judged(second, again)
    chosen = search.better_pass(q1, q2)
    both = first.withColumn("of", F.lit("first")).union(second.withColumn("of", F.lit("second")))
    rows = both.join(chosen, "query_id").where("of = chosen").drop("of")
    quality = q1.withColumn("of", F.lit("first")).union(q2.withColumn("of", F.lit("second"))).join(chosen, "query_id").where("of = chosen")
    rows = search.reranked(rows, search.ambiguous(rows), scorer, k).drop("rank").withColumnRenamed("final_rank", "rank")
    return rows.join(quality.select("query_id", "status", "confidence"), "query_id").select("query_id", "id", "path", "score", "rank", "chosen", "status", "confidence")
