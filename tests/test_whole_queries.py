"""Queries that ask for the whole job: no fixed number of ids, whatever the size of the table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon.operators import search
from quillon.plans import catalog

catalog.load()
SEARCHES = "vector_topk vector_topk_filtered hybrid_rrf hybrid_scored search_quality ambiguity_gate rerank_gated second_pass_choice".split()


@pytest.mark.parametrize("name", SEARCHES)
def test_each_50th_vector_asks(spark, small, name):
    due = {r.vec_id for r in spark.read.parquet(f"{small}/embeddings.parquet").where("vec_id % 50 = 0").collect()}
    assert len(due) > 5
    assert {r.query_id for r in catalog.QUERIES[f"{name}"](spark, small).select("query_id").collect()} == due


def test_over_a_thousand_queries_are_joined_in_blocks(spark, small):
    v = spark.read.parquet(f"{small}/embeddings.parquet")
    asked = v.select(F.explode(F.array(*[F.col("vec_id") + 1000 * k for k in range(3)])).alias("query_id"), "embedding")
    found = search.nearest(asked, v.limit(20), 3)
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.groupBy("query_id").count().collect()
    assert len(got) == 1500 and {r["count"] for r in got} == {3}


def test_every_event_has_an_age(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    got = catalog.QUERIES["index_age"](spark, small)
    assert got.count() == events.count() and events.join(got.where("age is not null"), "event_id", "left_anti").isEmpty()


def test_all_events_are_runs(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    got = catalog.QUERIES["run_coverage"](spark, small)
    lane = F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("other")
    there = events.select(lane.alias("lane"), F.concat(F.lit("t"), (F.col("event_id") % 5).cast("string")).alias("task"), (F.floor(F.col("event_id") / 40) % 30).cast("int").alias("repeat")).distinct()
    late = there.where("repeat >= 4")
    assert late.count() > 0 and late.join(got.where("problem = 'unplanned'"), ["lane", "task", "repeat"], "left_anti").isEmpty()


def test_examples_are_whole_texts(spark, small):
    texts = {r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = [r.snippet for r in catalog.QUERIES["canonical_example"](spark, small).collect()]
    assert got and all(s in texts for s in got)
    assert max(map(len, got)) > 400


def test_every_part_is_split_every_document_listed_and_every_node_a_target(spark, small):
    ids = lambda name, c, d=small: {r[0] for r in catalog.QUERIES[name](spark, d).select(c).collect()}
    assert ids("camel_words", "p_partkey") == {r[0] for r in spark.read.parquet(f"{small}/part.parquet").select("p_partkey").collect()}
    assert ids("union_first", "id") == {r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect()}
    assert ids("impact_2hop", "target") == ids("preflight_risk", "target")
