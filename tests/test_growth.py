"""What must not grow faster than the input."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import graph, search
from quillon.sources.shared import keeper


def by_reach(edges):
    """Smallest node of each component of two or more, by closing the relation."""
    to = {}
    for a, b in edges:
        if a != b:
            to.setdefault(a, set()).add(b)
    reach = {}
    for a in to:
        seen, left = set(), [a]
        while left:
            for b in to.get(left.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    left.append(b)
        reach[a] = seen
    return {(a, min(b for b in reach[a] if a in reach.get(b, ()))) for a in reach if a in reach[a]}


@pytest.mark.parametrize("local", [0, 20])
def test_cycle_groups_in_rounds(spark, local):
    r = random.Random(3)
    edges = [(r.randrange(16), r.randrange(16)) for _ in range(22)] + [(100, 101), (101, 102), (102, 100), (102, 103), (7, 7), (None, 1)]
    rows = [(x.node, x.group) for x in graph.cycle_groups(spark.createDataFrame(edges, "src long, dst long").coalesce(1), keeper(spark), local).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == by_reach([e for e in edges if None not in e]) and (102, 100) in rows


def test_cycle_groups_in_one_task(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(330)] + [(400, 401), (401, 402), (402, 400), (402, 403), (7, 7), (500, 500), (None, 1), (1, None)]
    rows = [(x.node, x.group) for x in graph.cycle_groups(spark.createDataFrame(edges * 2, "src long, dst long"), keeper(spark)).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == by_reach([e for e in edges if None not in e]) and (402, 400) in rows
    named = graph.cycle_groups(spark.createDataFrame([(f"n{a}é", f"n{b}é") for a, b in edges if None not in (a, b)], "src string, dst string"), keeper(spark))
    assert {(x.node, x.group) for x in named.collect()} == by_reach([(f"n{a}é", f"n{b}é") for a, b in edges if None not in (a, b)])
    assert graph.cycle_groups(spark.createDataFrame([(3, 3)], "src int, dst int"), keeper(spark)).collect() == []


def test_a_long_chain_and_a_long_ring_take_few_jobs(spark):
    edges = spark.range(5000).selectExpr("id AS src", "id + 1 AS dst").union(spark.range(4000).selectExpr("10000 + id AS src", "10000 + (id + 1) % 4000 AS dst"))
    spark.sparkContext.setJobGroup("ring", "ring")
    try:
        got = graph.cycle_groups(edges, keeper(spark)).groupBy("group").count().collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [tuple(r) for r in got] == [(10000, 4000)]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("ring")) < 15

def test_inflections_are_the_words_with_that_alias(spark):
    stems = ["plan", "plann", "stop", "stopp", "make", "mak", "agree", "agre", "need", "bed", "ring", "added", "adde", "pass", "passe", "buzz", "b", "ee", "seed", "x1", "22", "222e", "fooo", "heed"]
    words = spark.createDataFrame([(s + e,) for s in stems for e in ("", "e", "d", "ed", "ing", "inged", "eding")], "w string").distinct()
    known = words.select("w", F.explode(text.aliases(F.col("w"))).alias("alias"))
    names = known.select("alias").union(words.select("w")).distinct()
    made = names.select(F.explode(text.inflections(F.col("alias"))).alias("w"), "alias")
    assert known.select("w", "alias").exceptAll(made).isEmpty()
    assert made.where(~F.array_contains(text.aliases(F.col("w")), F.col("alias"))).isEmpty()


def test_rows_of_one_key_are_one_text(spark):
    """As in its SQL, which counts by document: two rows gave two results with a part of the words each."""
    queries = spark.createDataFrame([(1, "planned sessions"), (2, "sessions expired")], "query_id long, query string")
    rows = spark.createDataFrame([(5, "plan session"), (5, "planning a session, planning more"), (6, "expiring"), (6, "session"), (7, "session"), (8, None), (None, "plan session")], "doc_id long, text string")
    got = {(r.query_id, r.doc_id, r.clues, round(r.density, 6)) for r in search.rescued(queries, rows, "doc_id", "text").collect()}
    assert got == {(1, 5, 2, round((math.sqrt(2) + math.sqrt(2)) / math.sqrt(7), 6)), (2, 6, 2, round(2 / math.sqrt(2), 6))}


def test_a_word_of_every_row_is_dealt_to_many_tasks(spark):
    queries = spark.createDataFrame([(i, "session token") for i in range(3)], "query_id long, query string")
    hits = search.clue_hits(queries, spark.range(5000).selectExpr("id AS doc_id", "'session token session' AS text"), ["doc_id"], "text")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Join \[w#\d+, share#", plan)
    assert {tuple(r) for r in hits.groupBy("query_id", "n", "tf").count().collect()} == {(i, n, 2 - n, 5000) for i in range(3) for n in (0, 1)}
