"""A search's stages together, on chunks of our own with expectations by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon.operators import composed, search
from quillon.sources.shared import keeper

CHUNKS = [
    (1, "lib/alpha.py", "alpha beta gamma", "run"), (2, "lib/alpha.py", "alpha beta only", None), (3, "lib/beta.py", "alpha and beta", None), (4, "lib/gamma.py", "expired sessions renew", "expired"),
    (5, "lib/delta.py", "tokens and sessions", None), (6, "lib/delta.py", "expired", None), (7, "lib/lone.py", "tokens", None), (8, "lib/none.py", None, None),
]


@pytest.fixture
def chunks(spark):
    rows = spark.createDataFrame(CHUNKS, "id long, path string, content string, name string")
    none = F.array().cast("array<string>")
    return rows.select("*", F.lit(1).alias("start_line"), F.lit("unknown").alias("kind"), F.lit("unknown").alias("layer"), none.alias("tags"), F.when(F.col("name").isNull(), none).otherwise(F.array("name")).alias("names"), F.lit(0.0).alias("centrality"), F.lit(None).cast("string").alias("trend"))


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")


@pytest.fixture
def keep(spark):
    return keeper(spark)


def test_clues_over_all_chunks_of_a_file(spark, chunks):
    got = composed.nominations(asked(spark, "expired session tokens"), chunks).collect()
    # delta holds all three clues, in two chunks; gamma two, one of them declared; lone only one.
    assert {r.id: round(r.distance, 6) for r in got} == {5: 0.5, 4: 0.5}


def test_rescue_only_where_keywords_fail(spark, chunks):
    got = composed.keyword_list(asked(spark, "expired session tokens", "alpha.py", "zzzz"), chunks)
    assert sorted((r.query_id, r.id, r.rank) for r in got.collect()) == [(0, 4, 0), (0, 5, 1), (1, 1, 0), (1, 2, 1), (1, 3, 2)]  # chunk 3 holds the word, but is not in the file that is named


def test_scores_and_best_of_a_file(spark, chunks, keep):
    got = composed.searched(asked(spark, "alpha beta", None, "", "zzzz"), chunks, keep, k=2).collect()
    # Three chunks of two files hold both words; ranks by keyword distance, then by id: 1, 2, 3.
    assert [(r.query_id, r.path, r.rank, r.chosen) for r in sorted(got, key=lambda r: r.rank)] == [(0, "lib/alpha.py", 0, "first"), (0, "lib/beta.py", 1, "first")]
    by_rank = {r.rank: r.score for r in got}
    assert by_rank[0] == pytest.approx(1.0) and by_rank[1] < by_rank[0]


def test_stale_files_and_empty_tables(spark, chunks, keep):
    fresh = spark.createDataFrame([("lib/beta.py",)], "path string")
    assert [r.path for r in composed.searched(asked(spark, "alpha beta"), chunks, keep, fresh=fresh).collect()] == ["lib/beta.py"]
    assert composed.searched(asked(spark, "alpha beta"), chunks.limit(0), keep).count() == 0
    assert composed.searched(asked(spark, "alpha beta").limit(0), chunks, keep).count() == 0


def test_scorer_orders_close_results(spark, chunks, keep):
    more = chunks.union(chunks.where("id = 3").withColumns({"id": F.lit(9).cast("long"), "path": F.lit("lib/zeta.py")}))
    plain = [r.path for r in composed.searched(asked(spark, "alpha beta"), more, keep).orderBy("rank").collect()]
    turned = [r.path for r in composed.searched(asked(spark, "alpha beta"), more, keep, scorer=lambda r: r["id"].cast("double")).orderBy("rank").collect()]
    assert sorted(plain) == sorted(turned) and turned == ["lib/zeta.py", "lib/beta.py", "lib/alpha.py"]


def test_neighbours_are_fused(spark, chunks, keep):
    def near(forms):
        return forms.select("query_id", F.lit(8).cast("long").alias("id"), F.lit(0).alias("rank"))

    got = {r.path for r in composed.searched(asked(spark, "alpha beta"), chunks, keep, near=near).collect()}
    assert got == {"lib/alpha.py", "lib/beta.py", "lib/none.py"}


def test_second_pass_takes_the_surer(spark):
    first = spark.createDataFrame([(i, "low_confidence" if i else "ok", 0.4) for i in range(5)], "query_id int, status string, confidence double")
    second = spark.createDataFrame([(0, "ok", 0.9), (1, "ok", 0.4), (2, "ok", 0.3), (3, "low_confidence", 0.45), (4, "low_confidence", 0.44)], "query_id int, status string, confidence double")
    assert {r.query_id: r.chosen for r in search.better_pass(first, second).collect()} == {0: "first", 1: "second", 2: "first", 3: "second", 4: "first"}
