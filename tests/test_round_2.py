"""What the second round's findings would have shown on small tables."""

from __future__ import annotations

import math
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from quillon.functions import scores
from quillon.operators import chunking, detail, neighbours, search
from quillon.plans import catalog

catalog.load()


def test_age_counts_whole_seconds(spark):
    rows = spark.sql("SELECT explode(array('2024-01-19 00:00:00', '2024-01-19 00:00:00.5', '2024-01-19 00:00:01', '2024-01-13 00:00:00.999999')) AS t")
    got = rows.select(scores.index_age(F.to_timestamp("t"), F.lit("2024-01-20").cast("timestamp")).alias("age")).collect()
    assert [r.age for r in got] == ["aging", "aging", "fresh", "stale"]


def test_signature_keeps_digits_at_the_ends_of_lines(spark):
    row = spark.sql("SELECT '  01 a 0 \\n1 b 1\\n2 c 2' AS t")
    assert row.select(detail.signature(F.col("t")).alias("s")).first().s == "01 a 0 1 b 1 2 c 2"


def by_hand(asked, vectors, k):
    def score(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return 0.0
        dot, x, y = (sum(p * q for p, q in zip(u, v)) for u, v in ((a, b), (a, a), (b, b)))
        if not x or not y or not math.isfinite(x * y):
            return math.nan
        return max(0.0, min(dot / math.sqrt(x * y), 1.0))

    out = set()
    for q, a in asked:
        rows = sorted(((score(a, b), i) for i, b in vectors), key=lambda r: (-math.inf if math.isnan(r[0]) else -r[0], r[1]))[:k]
        out |= {(q, i, n, "nan" if math.isnan(s) else round(s, 9)) for n, (s, i) in enumerate(rows)}
    return out


def test_nearest_vectors_with_copies_and_odd_ones(spark):
    r = random.Random(5)
    base = [[float(r.randint(-3, 3)) for _ in range(4)] for _ in range(40)]
    odd = [None, [0.0] * 4, [1.0, None, 0.0, 0.0], [1.0, 2.0], [math.inf, 1.0, 0.0, 0.0], [], [-1.0, -1.0, -1.0, -1.0]]
    vectors = list(enumerate(base + odd + [base[0]] * 60 + base + odd))
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    asked = [(100 + i, v) for i, v in enumerate(base[:6] + odd)]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<float>")
    for rows, k in ((vectors, 3), (vectors, 90), (vectors[:8], 10)):
        found = search.nearest(queries, frame.where(F.col("vec_id") < len(rows)), k)
        got = {(x.query_id, x.vec_id, x["rank"], "nan" if math.isnan(x.score) else round(x.score, 9)) for x in found.collect()}
        assert got == by_hand(asked, rows, k)
    plain = spark.createDataFrame([v for v in vectors if v[1] == base[0]], frame.schema)
    assert [x.vec_id for x in search.nearest(queries.where("query_id = 100"), plain, 3).orderBy("rank").collect()] == [0, 47, 48]
    assert "NestedLoop" not in search.nearest(queries, frame, 3)._jdf.queryExecution().executedPlan().toString()


def test_nearest_vectors_over_several_blocks(monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS", 30)
    r = random.Random(6)
    vectors = [(i, [float(r.randint(-2, 2)) or 0.5 for _ in range(3)]) for i in range(400)]
    r.shuffle(vectors)
    asked = [(q, v) for q, v in vectors if q % 50 == 0] + [(7000, None)]
    batches = [pa.RecordBatch.from_pydict({"vec_id": [i for i, _ in vectors[a : a + 20]], "embedding": [v for _, v in vectors[a : a + 20]]}) for a in range(0, 400, 20)]
    found = neighbours.nominate(iter(batches), neighbours.asked(pa.table({"query_id": [q for q, _ in asked], "asked": [v for _, v in asked]})), 7)
    rows = [x for b in found for x in b.to_pylist()]
    got = set()
    for q, _ in asked:
        best = sorted((x for x in rows if x["query_id"] == q), key=lambda x: (-x["score"], x["vec_id"]))[:7]
        got |= {(q, x["vec_id"], n, round(x["score"], 9)) for n, x in enumerate(best)}
    assert got == by_hand(asked, vectors, 7)


def test_a_term_of_every_chunk_meets_only_chunks_with_the_rarer_one(spark):
    chunks = spark.range(2000).selectExpr("id", "'common word' || id AS content", "'n' AS name", "'a/f' || id || '.ts' AS path", "'k' AS kind", "'l' AS layer", "array('t') AS tags")
    queries = spark.range(400).selectExpr("id AS query_id", "'common word' || id || CASE WHEN id = 7 THEN ' absent' ELSE '' END AS query")
    found = search.keyword_weighted(queries, chunks)
    got = found.collect()
    assert sorted((r.query_id, r.id) for r in got) == [(i, i) for i in range(400) if i != 7] and {round(r.score, 9) for r in got} == {round(0.4 / 1.35, 9)}
    assert int(max(re.findall(r"number of output rows: ([0-9,]+)", plan_with_rows(found)), key=lambda n: int(n.replace(",", ""))).replace(",", "")) < 40_000


def plan_with_rows(df):
    """The executed plan's row counts, as lines."""
    out, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            left.append(node.executedPlan())
            continue
        if hasattr(node, "plan") and node.nodeName().endswith("QueryStage"):
            left.append(node.plan())
            continue
        m = node.metrics().get("numOutputRows")
        if m.isDefined():
            out.append(f"number of output rows: {m.get().value()}")
        left += [node.children().apply(i) for i in range(node.children().size())]
    return "\n".join(out)


def test_folds_start_no_frame_a_file_and_take_any_order(spark):
    rows = spark.createDataFrame([(i, n * 4 + 1, n * 4 + 4, "a\nb\nc\nd") for i in range(3000) for n in (2, 0, 1)] + [(None, 1, 1, "x")], "doc_id long, start_line int, end_line int, content string")
    found = chunking.merge_small(rows, 8)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.doc_id, r.start_line, r.end_line, r.content.count("\n") + 1) for r in found.collect()}
    assert got == {(i, a, b, n) for i in range(3000) for a, b, n in ((1, 8, 8), (9, 12, 4))} | {(None, 1, 1, 1)}


def test_compact_results_keep_few_rows_before_the_shuffle(spark, small):
    plan = catalog.QUERIES["compact_results"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_texts_made_of_one_small_file_are_spread(spark, small):
    for name in ("react_facts", "react_components", "framework_facts", "decorated_classes", "keyword_weighted"):
        assert "REPARTITION_BY_NUM" in catalog.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString(), name
