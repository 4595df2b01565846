"""Operators on small fixtures of our own, with expectations by hand."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import paths, scores, text
from quillon.operators import analyzers, chunking, evals, graph, health, manifest, notes, patterns, preflight, review, search, spans
from quillon.sources import files as sources
from quillon.sources.generations import Store
from quillon.streaming import watch


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x if values else spark.range(1).select(column.alias("x")).first().x


# ------------------------------------------------------------------ scalars


def test_query_terms_and_words(spark):
    assert one(spark, text.query_terms(F.lit("How to find the UserService in src/app_main?"))) == ["find", "userservice", "src", "app_main"]
    assert one(spark, text.words(F.lit("XMLParser parseItems class2Queries bus classes"))) == ["xml", "parser", "parse", "item", "class2", "query", "bus", "classe"]
    assert one(spark, text.aliases(F.lit("stopped"))) == ["stopped", "stopp", "stoppe", "stop"]
    assert one(spark, text.aliases(F.lit("red"))) == ["red"]
    assert one(spark, text.clues(F.lit("Where does the authService handle expired tokens and user_name sessions"))) == ["handle", "expired", "token", "session"]


def test_intent_and_variants(spark):
    got = [one(spark, text.intent(F.lit(q))).intent for q in ("UserService", "routing setup", "inject the thing", "handle clicks", "colours of birds")]
    assert got == ["EXACT_NAME", "CONFIG", "WIRING", "FLOW", "CONCEPTUAL"]
    v = one(spark, text.variants(F.lit("login route")))
    assert [x.weight for x in v] == [1.0, 0.35, 0.25]
    assert v[1].query == "login route auth token session guard oauth router" and v[2].query == "login route navigation redirect path"
    assert len(one(spark, text.variants(F.lit("birds")))) == 1


def test_boundaries_are_of_all_scripts(spark):
    body = F.lit("the été thé $the the$ _the the1 (the) the\U0001f600")
    assert one(spark, text.occurrences(body, F.lit("the"))) == 3
    assert one(spark, text.complexity(F.lit("if (a) {} else if (b) {} x ? 1 : 2; a && b || c; étéif (x)"))) == 1 + 3 + 1 + 0 + 1 + 1


def test_paths(spark):
    def p(f, value):
        return one(spark, f(F.lit(value)))

    assert [p(paths.language, x) for x in ("a/b.TSX", "x.py", "noext", ".gitignore", "a.b/c")] == ["typescriptreact", "python", "plaintext", "plaintext", "plaintext"]
    assert p(paths.is_test, "a/x.spec.ts") and p(paths.is_documentation, "README.md") and p(paths.is_composition_root, "src/main.ts") and not p(paths.is_code, "a.md")
    assert one(spark, paths.is_code(F.lit("a.foo"), ("foo",)))
    assert [p(paths.is_map_eligible, x) for x in ("src/a.ts", "test/a.ts", "a.test.ts", "./", "dist/x.js", "app-3f9a2c1b.js", "a.snap")] == [True, False, False, False, False, False, False]
    assert [p(paths.dependency_category, x) for x in ("react", "@angular/core", "@types/x", "zzz")] == ["framework", "framework", "build", "other"]
    assert [p(paths.route, x) for x in ("web/app/(shop)/cart/page.tsx", "app/page.tsx", "app/@modal/a/route.ts", "app/a/x.tsx")] == ["/cart", "/", "/a", None]
    assert p(lambda c: paths.tail(c, 2), "a/b/c") == "b/c" and p(lambda c: paths.tail(c, 9), "a/b") == "a/b"


def test_scores(spark):
    now = F.lit(dt.datetime(2024, 7, 1))
    ago = lambda d: F.lit(dt.datetime(2024, 7, 1) - dt.timedelta(days=d))
    assert [one(spark, scores.trend(ago(d), now)) for d in (0, 60, 61, 179, 180)] == ["Rising", "Rising", "Stable", "Stable", "Declining"]
    assert one(spark, scores.trend(F.lit(None).cast("timestamp"), now)) is None
    assert one(spark, scores.confidence(F.lit("decision"), ago(180), now)) == 0.5 and one(spark, scores.confidence(F.lit("convention"), ago(999), now)) == 1.0
    assert one(spark, scores.confidence(F.lit("gotcha"), F.lit(None).cast("timestamp"), now)) == 0.0
    assert [one(spark, scores.index_age(ago(d), now)) for d in (0.5, 3, 8)] == ["fresh", "aging", "stale"]
    assert one(spark, scores.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0)))) == pytest.approx(0.96)
    assert one(spark, scores.sigmoid(F.lit(0.0))) == 0.5


# ------------------------------------------------------------------ chunks


def test_chunks_cover_every_line_once(spark):
    rows = [(k, "\n".join(f"l{i}" for i in range(n))) for k, n in enumerate((1, 4, 5, 6, 11, 50))] + [(90, ""), (91, None), (92, "x\n\n")]
    files = spark.createDataFrame(rows, "doc_id long, text string")
    chunks = chunking.line_chunks(files, 5)
    back = chunks.orderBy("doc_id", "chunk").collect()
    for k, t in rows:
        if t is not None:
            assert "\n".join(c.content for c in back if c.doc_id == k) == t
    assert chunking.broken(chunks, files).count() == 0
    assert chunking.broken(chunks.withColumn("start_line", F.col("start_line") + 1), files).count() == chunks.count()
    over = [(c.start_line, c.end_line) for c in chunking.line_chunks(files, 5, 2).where("doc_id = 4").orderBy("chunk").collect()]
    assert over == [(1, 5), (4, 8), (7, 11)]
    with pytest.raises(ValueError):
        chunking.line_chunks(files, 5, 5)


def test_intervals(spark):
    s = spark.createDataFrame([("f", "A", 1, 20), ("f", "B", 2, 9), ("f", "C", 3, 4), ("f", "D", 10, 20), ("f", "E", 10, 20), ("g", "F", 1, 2)], "file string, id string, start int, end int")
    parents = {r.id: r.parent for r in chunking.containment(s).collect()}
    assert parents == {"A": None, "B": "A", "C": "B", "D": "A", "E": "A", "F": None}
    parts = chunking.segments(s.where("file = 'f' and id <> 'E'"), spark.createDataFrame([("f", 22)], "file string, n_lines int")).orderBy("start_line").collect()
    assert [(p.start_line, p.end_line, p.owner) for p in parts] == [(1, 1, "A"), (2, 2, "B"), (3, 4, "C"), (5, 9, "B"), (10, 20, "D"), (21, 22, None)]


def test_merges_and_splits(spark):
    chunks = spark.createDataFrame([(1, 1, 3, "a\nb\nc", "x"), (1, 4, 6, "d\ne\nf", "x"), (1, 7, 9, "g\nh\ni", "y"), (1, 11, 12, "k\nl", "y"), (2, 1, 20, "\n".join("z" * 20), "x")], "doc_id long, start_line int, end_line int, content string, kind string")
    got = {(r.doc_id, r.start_line, r.end_line) for r in chunking.merge_small(chunks, 5, same=("kind",)).collect()}
    assert got == {(1, 1, 6), (1, 7, 9), (1, 11, 12), (2, 1, 20)}
    big = spark.createDataFrame([(1, 1, 9, "a\nb\nc\n\ne\nf\ng\nh\ni")], "doc_id long, start_line int, end_line int, content string")
    parts = chunking.split_oversized(big, 5).orderBy("start_line").collect()
    assert parts[0].start_line == 1 and all(a.end_line + 1 == b.start_line for a, b in zip(parts, parts[1:])) and parts[-1].end_line == 9
    assert "\n".join(p.content for p in parts) == big.first().content and all(p.end_line - p.start_line < 6 for p in parts)


def test_only_small_chunks_merge(spark):
    # Ten lines and fifty stay two: each side must be small.
    text = lambda n: "\n".join("x" * n)
    schema = "doc_id long, start_line int, end_line int, content string, kind string, tags array<string>, owner string"
    rows = [(1, 1, 10, text(10), "x", ["a"], None), (1, 11, 60, text(50), "x", ["a"], None), (2, 1, 3, text(3), "x", ["a", "b"], None), (2, 4, 6, text(3), "x", ["b", "c"], None), (2, 7, 9, text(3), "x", None, "Cls"), (2, 10, 12, text(3), "y", None, None)]
    got = chunking.merge_small(spark.createDataFrame(rows, schema), 15, united=("tags",), owners=("owner",)).orderBy("doc_id", "start_line").collect()
    assert [(r.doc_id, r.start_line, r.end_line) for r in got] == [(1, 1, 10), (1, 11, 60), (2, 1, 6), (2, 7, 9), (2, 10, 12)]
    assert got[2].tags == ["a", "b", "c"] and got[2].content == text(6)


def test_cuts_come_after_braces_and_comments(spark):
    lines = ["x"] * 201
    lines[100] = "}"
    big = spark.createDataFrame([(1, 1, 201, "\n".join(lines), "f")], "doc_id long, start_line int, end_line int, content string, symbol string")
    got = chunking.split_oversized(big).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line, r.symbol) for r in got] == [(1, 101, "f:1"), (102, 201, "f:2")]
    lines[95], lines[100] = "  // note", "x"
    assert chunking.split_oversized(big.withColumn("content", F.lit("\n".join(lines)))).orderBy("start_line").first().end_line == 96


def test_presentation(spark):
    assert one(spark, chunking.tags(F.lit("service"), F.array(F.lit("Injectable")), F.lit(None).cast("array<string>"), F.lit(None).cast("string"), F.lit("core"), F.lit("service"), F.lit(True), F.lit(False))) == ["service", "injectable", "core", "standalone"]
    assert one(spark, chunking.preview(F.lit("a\nb foo\nfoo bar\nc\nd"), F.array(F.lit("foo"), F.lit("bar")))) == "b foo\nfoo bar\nc"
    s = one(spark, chunking.sections(F.lit("intro\n## One\nbody\nmore\n## Two")))
    assert [(x.heading, x.body) for x in s] == [(None, "intro"), ("One", "body\nmore"), ("Two", "")]
    assert one(spark, chunking.embedding_text(F.lit("a.ts"), F.lit("class"), F.lit(None).cast("string"), F.lit("core"), F.lit("x"))) == "path: a.ts type: class layer: core\nx"


def test_manifests(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, hash string")
    assert {r.path: r.status for r in manifest.diff(old, new).collect()} == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "added"}
    state = manifest.freshness(spark.createDataFrame([(p,) for p in "abcz"], "path string"), old, new)
    assert {r.path: r.state for r in state.collect()} == {"a": "current", "b": "stale", "c": "stale", "z": "corrupt"}
    assert sorted(map(tuple, manifest.rebuilt(old, manifest.diff(old, new), new).collect())) == [("a", "1"), ("b", "2"), ("d", "1")]
    assert manifest.checked_snapshot(old, old).isEmpty()


def test_spans(spark):
    s = spark.createDataFrame([("f", 1, 3), ("f", 4, 5), ("f", 7, 9), ("f", 2, 2), ("g", 1, 1)], "k string, start int, end int")
    assert sorted((r.k, r.start, r.end) for r in spans.merged(s, "k").collect()) == [("f", 1, 5), ("f", 7, 9), ("g", 1, 1)]


# ------------------------------------------------------------------ graph


def test_paths_are_simple_and_complete(spark):
    rnd = random.Random(1)
    e = {(rnd.randrange(9), rnd.randrange(9)) for _ in range(22)}
    want = set()

    def walk(path, left):
        for a, b in e:
            if a == path[-1] and b not in path and left:
                want.add((*path, b))
                walk((*path, b), left - 1)

    walk((0,), 3)
    frame = spark.createDataFrame(list(e), "src long, dst long")
    start = spark.createDataFrame([(0,)], "node long")
    assert {tuple(r.path) for r in graph.paths(frame, start).collect()} == want
    back = {tuple(r.path) for r in graph.paths(frame.selectExpr("dst AS src", "src AS dst"), start, direction="in").collect()}
    assert back == want and graph.paths(frame, start, most=4).count() == min(4, len(want))
    with pytest.raises(ValueError):
        graph.paths(frame, start, 4)


def test_cycles_and_merges(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 1), (3, 3), (1, 2)], "src long, dst long")
    assert sorted(tuple(r.nodes) for r in graph.short_cycles(e).collect()) == [(1, 2), (1, 2, 3)]
    proofs = spark.createDataFrame([("a", "b", 4, "x"), ("a", "b", 2, "*"), ("a", "b", 4, "x"), ("a", "b", 9, "default")], "src string, dst string, line int, symbol string")
    assert tuple(graph.merged_edges(proofs).first()) == ("a", "b", 2, ["x"], 3)


def test_health(spark):
    d = spark.createDataFrame([("a", 1, 9), ("b", 0, 4), ("c", 0, 0)], "node string, fan_out long, fan_in long")
    rows = health.scored(health.metrics(d, spark.createDataFrame([("a", 2)], "node string, cycles long"), spark.createDataFrame([("c", 18), ("z", 10)], "node string, complexity int")))
    got = {r.node: (r.score, r.level, len(r.reasons)) for r in rows.collect()}
    assert got == {"a": (7, "high", 3), "b": (3, "medium", 2), "c": (2, "medium", 1), "z": (1, "low", 1)}
    assert tuple(health.summary(rows).first()) == (1, 2, 1)


# ------------------------------------------------------------------ knowledge


def test_robust_dates_at_the_bounds(spark):
    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    rows = [("c", f"n{n}", day(k)) for n in (1, 4, 5, 10, 11, 20) for k in range(n)] + [("c", "tied", day(1))] * 12 + [("c", "none", None)]
    got = {r.name: r.date for r in patterns.robust_dates(spark.createDataFrame(rows, "category string, name string, ts timestamp")).collect()}
    want = {f"n{n}": day(n - 1 - (0 if n < 5 else n // 10)) for n in (1, 4, 5, 10, 11, 20)} | {"tied": day(1)}
    assert got == want


def test_canonical_examples_equal_the_reader(spark):
    rnd = random.Random(4)
    rows = [("c", f"n{g}", k, rnd.choice(["app/", "app/", "core/", "x/shared/"]) + str(k), "x" * rnd.choice([10, 50, 51, 120, 200, 201, 250, 300, 400])) for g in range(60) for k in range(rnd.randrange(1, 9))]
    want = {}
    for _, name, _, file, snippet in rows:
        held = want.get(name)
        inside = "core/" in file or "shared/" in file
        if held:
            was = "core/" in held[0] or "shared/" in held[0]
            better = (inside and not was) or (inside == was and len(held[1]) > 200 and 50 < len(snippet) < len(held[1]))
        if not held or better:
            want[name] = (file, snippet)
    got = patterns.canonical_examples(spark.createDataFrame(rows, "category string, name string, seq int, file string, snippet string"))
    assert {r.name: (r.file, r.snippet) for r in got.collect()} == want


def test_notes(spark):
    log = spark.createDataFrame([("2024-01-02T00:00:00Z\tabc1 fix: the parser", ), ("2024-01-02\tabc1 fix: a",), ("nonsense",), ("never\tabc refactor(x): things move",), ("2024-01-02\tdef2 Migrate! to new things",)], "line string")
    got = {r.memory: (r.type, r.category, len(r.id)) for r in notes.from_commits(log).collect()}
    assert got == {"fix: the parser": ("gotcha", "conventions", 12), "Migrate! to new things": ("decision", "dependencies", 12)}
    store = spark.createDataFrame([("a", "x")], "id string, m string")
    assert sorted(r.id for r in notes.added(store, spark.createDataFrame([("a", "y"), ("b", "y"), ("b", "z")], "id string, m string")).collect()) == ["a", "b"]


def test_evidence(spark):
    fields = "task string, results int, patterns int, notes int, stale_notes int, failures int, conflicts int, callers int, covered int, quality string, age string"
    rows = [("good", 3, 2, 2, 0, 0, 0, 0, 0, "ok", "fresh"), ("stale", 3, 2, 2, 0, 0, 0, 0, 0, "ok", "stale"), ("poor", 3, 2, 2, 0, 0, 0, 0, 0, "low_confidence", "fresh"), ("torn", 3, 2, 2, 9, 0, 3, 9, 1, "ok", "fresh"), ("none", 0, 0, 0, 0, 0, 0, 0, 0, "ok", "fresh"), ("thin", 1, 1, 0, 0, 0, 0, 0, 0, "ok", "aging")]
    got = {r.task: (r.score, r.status, r.ready) for r in preflight.evidence(spark.createDataFrame(rows, fields)).collect()}
    assert got == {"good": (100, "pass", True), "stale": (100, "block", False), "poor": (100, "warn", False), "torn": (100, "warn", False), "none": (0, "block", False), "thin": (38, "warn", False)}


# ------------------------------------------------------------------ search


def test_fusion(spark):
    lists = spark.createDataFrame([(1, "a", 0, 0.7), (1, "a", 0, 0.3), (1, "b", 1, 0.7)], "query_id int, id string, rank int, weight double")
    got = {r.id: r.rrf for r in search.fused(lists).collect()}
    assert got["a"] == pytest.approx(1.0) and got["b"] == pytest.approx(0.7 * 60 / 61)


def test_keywords_need_every_term(spark):
    q = spark.createDataFrame([(1, "alpha"), (1, "beta"), (2, "gamma")], "query_id int, term string")
    rows = spark.createDataFrame([("x", "alpha beta alpha"), ("y", "alpha"), ("z", "Gamma the")], "k string, body string")
    posts = search.postings(rows, ["k"], "body")
    assert sorted((r.query_id, r.k, r.score) for r in search.keyword_matches(q, posts, ["k"]).collect()) == [(1, "x", 3), (2, "z", 1)]
    assert search.keyword_matches(q, posts, ["k"], every=False).count() == 3
    close = search.close_terms(spark.createDataFrame([(1, "alpa")], "query_id int, term string"), posts.select("term").distinct())
    assert [r.term for r in close.collect()] == ["alpha"]


def test_quality_and_rerank(spark):
    rows = spark.createDataFrame([(1, k, s, False, f"d{k}") for k, s in enumerate((0.9, 0.89, 0.88))] + [(2, 0, 0.2, True, "t")], "query_id int, rank int, score double, test boolean, id string")
    q = spark.createDataFrame([(1, False), (2, False), (3, False)], "query_id int, testing boolean")
    got = {r.query_id: (r.signals, r.confidence, r.status) for r in search.quality(rows, q).collect()}
    assert got == {1: (1, 0.85, "ok"), 2: (3, 0.0, "low_confidence"), 3: (1, 0.0, "low_confidence")}
    gate = search.ambiguous(rows)
    assert {r.query_id: r.ambiguous for r in gate.collect()} == {1: True, 2: False}
    moved = search.reranked(rows, gate, lambda r: r["rank"].cast("double")).where("query_id = 1").orderBy("final_rank").collect()
    assert [r.id for r in moved] == ["d2", "d1", "d0"]
    still = search.reranked(rows, gate).where("query_id = 1").orderBy("final_rank").collect()
    assert [r.id for r in still] == ["d0", "d1", "d2"]


# ------------------------------------------------------------------ source text


PYTHON = 'import os\n\nclass A:\n    def m(self):\n        def inner():\n            pass\n\nasync def f():\n    pass\n'
SCRIPT = """import React, { useState as s, memo } from 'react';
import * as all from "./lib";
import './side';
export { x } from '../y';
export default class Thing {
  run(a) { if (a) { return inject(Service); } }
}
@Controller('api')
class C {
  @Get('list') list() {}
  @Post() add() {}
}
"""


def test_symbols(spark):
    files = spark.createDataFrame([("a.py", PYTHON), ("bad.py", "def ("), ("n.py", None)], "path string, text string")
    got = {(r.kind, r.name, r.start, r.end, r.parent) for r in analyzers.python_symbols(files).collect()}
    assert got == {("class", "A", 3, 6, None), ("method", "m", 4, 6, "A"), ("function", "inner", 5, 6, "m"), ("function", "f", 8, 9, None)}
    names = {(r.kind, r.name) for r in analyzers.lexical_symbols(spark.createDataFrame([("t.ts", SCRIPT)], "path string, text string")).collect()}
    assert {("class", "Thing"), ("method", "run"), ("class", "C")} <= names and ("method", "if") not in names


def test_imports_and_routes(spark):
    files = spark.createDataFrame([("src/t.ts", SCRIPT), ("src/lib/index.ts", ""), ("y.ts", ""), ("src/side.js", "")], "path string, text string")
    got = {r.source: r.names for r in analyzers.imports(files).collect()}
    assert got == {"react": ["default", "useState", "memo"], "./lib": ["*"], "./side": []}
    found = analyzers.imports(files).select("path", "source").union(analyzers.reexports(files)).union(spark.createDataFrame([("src/t.ts", "@/lib"), ("src/t.ts", "../../z"), ("src/t.ts", "./gone")], "path string, source string"))
    alias = spark.createDataFrame([("@/", "src/")], "prefix string, replacement string")
    out = {r.source: (r.target, r.outcome) for r in analyzers.resolved(found, files, alias).collect()}
    assert out == {"react": (None, "external"), "./lib": ("src/lib/index.ts", "resolved"), "./side": ("src/side.js", "resolved"), "../y": ("y.ts", "resolved"), "@/lib": ("src/lib/index.ts", "resolved"), "../../z": (None, "outside-root"), "./gone": (None, "not-found")}
    assert {(r.verb, r.route) for r in analyzers.controller_routes(files).collect()} == {("GET", "/api/list"), ("POST", "/api")}
    facts = {(r.framework, r.name) for r in analyzers.framework_facts(files).collect()}
    assert ("angular", "inject() function") in facts and ("nest", "controller") in facts


def test_test_frameworks(spark):
    files = spark.createDataFrame([("a", "import { vi } from 'vitest'; jest.fn()"), ("b", "cy.visit('/')"), ("c", "none")], "path string, text string")
    assert {(r.path, r.kind, r.framework) for r in analyzers.test_frameworks(files).collect()} == {("a", "unit", "vitest"), ("b", "e2e", "cypress")}


def test_review(spark):
    patch = "+++ b/x\n+class FooBar { loadItems() }\n-const loadItems = 1\n context\n+return x"
    p = spark.createDataFrame([("a.ts", patch), ("b.png", "Binary files a and b differ")], "path string, patch string")
    assert {r.identifier: r.score for r in review.changed_identifiers(p).collect()} == {"FooBar": 6, "loadItems": 5 + 4}
    assert sorted(map(tuple, review.patch_stats(p).collect())) == [("a.ts", 2, 1, False), ("b.png", 0, 0, True)]
    assert one(spark, review.path_words(F.lit("src/user-profile/map/card.view.ts"))) == ["card.view", "profile", "user", "src"]  # "map" is a word that names nothing


def test_evaluation(spark):
    rows = spark.createDataFrame([(1, "a/x", 0), (1, "b/x", 1), (2, "c/x", 0), (2, "d/x", 1)], "query_id int, path string, rank int")
    expected = spark.createDataFrame([(1, "b/"), (2, "zz")], "query_id int, pattern string")
    r = evals.retrieval(rows, expected, spark.createDataFrame([(1, "a/")], "query_id int, pattern string"), 0.5).first()
    assert (r.queries, r.top1, r.top3, r.contaminated, r.passed) == (2, 0.0, 0.5, 0.5, True)


# ------------------------------------------------------------------ storage


def test_ignore_lines_take_back(spark, tmp_path):
    for name in ("a.log.ts", "keep.log.ts", "b.ts"):
        (tmp_path / name).write_text("x")
    (tmp_path / ".gitignore").write_text("*.log.ts\n!keep.log.ts\n")
    found = {r.path: (r.skip_reason, r.text) for r in sources.scan(spark, str(tmp_path)).collect()}
    assert found["a.log.ts"] == ("ignored", None) and found["keep.log.ts"] == (None, "x") and found["b.ts"] == (None, "x")


def test_generations_are_replaced_in_one_step_and_pinned(spark, tmp_path):
    store = Store(spark, tmp_path.as_uri())
    frame = spark.range(3)
    first = store.publish({"t": frame})
    build, pin = store.pin()
    assert build == first
    for _ in range(4):
        store.publish({"t": frame})
    assert first in store.generations() and store.pins() == (first,)
    store.unpin(pin)
    last = store.publish({"t": frame})
    assert first not in store.generations() and store.meta()["build"] == last and len(store.generations()) == 3


def test_notes_are_added_once(spark, tmp_path):
    where = (tmp_path / "notes.json").as_uri()
    new = spark.createDataFrame([("1", "gotcha", "a", "m", None, None, None)], "id string, type string, category string, memory string, reason string, date string, scope struct<kind:string,file:string,symbol:string>")
    assert [sources.append_notes(spark, where, new) for _ in range(2)] == [1, 0] and sources.read_notes(spark, where).count() == 1


def test_batches_keep_the_last_version_and_take_paths_away(spark, tmp_path):
    state = {"df": spark.createDataFrame([("a", "1", 0), ("b", "1", 0)], "path string, hash string, version int")}

    def publish(df, number):
        state["df"] = spark.createDataFrame(df.collect(), df.schema)

    folder = str(tmp_path / "in")
    spark.createDataFrame([("a", "3", 3), ("a", "9", 2), ("b", None, 4), ("c", "1", 1)], "path string, hash string, version int").coalesce(1).write.parquet(folder)
    watch.refreshing(watch.changes(spark, folder, "path string, hash string, version int"), str(tmp_path / "cp"), lambda: state["df"], publish, "version").awaitTermination()
    assert {(r.path, r.hash) for r in state["df"].collect()} == {("a", "3"), ("c", "1")}


def test_scan(spark, tmp_path):
    for name, body in {"src/a.ts": "x", "src/b.png": "x", "node_modules/c.ts": "x", "tmp/d.ts": "x", "e.md": "x", "src/big.py": "x" * (1 << 20) + "y"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    found = sources.scan(spark, str(tmp_path), ["# note", "/tmp/", "*.log"])
    assert {r.path: r.skip_reason for r in found.collect()} == {"src/a.ts": None, "src/b.png": "binary", "node_modules/c.ts": "ignored", "tmp/d.ts": "ignored", "e.md": "not code", "src/big.py": "too large"}
    kept, over = sources.capped(found, 0)
    assert kept.count() == 0 and tuple(over.first()) == (1, ["src/a.ts"])
    assert {r.reason for r in sources.preview(found).collect()} == {"eligible", "binary", "ignored", "not code", "too large"}


def test_commit_log_blocks(spark):
    lines = [":::2024-03-01 00:00:00", "a", "", "b", ":::2024-02-01 00:00:00", "a", "c"]
    log = spark.createDataFrame(list(enumerate(lines)), "n long, value string")
    for block in (1, 2, 100):
        got = {r.path: r.ts.month for r in sources.newest_dates(log, block=block).collect()}
        assert got == {"a": 3, "b": 3, "c": 2}


def test_packages_and_projects(spark):
    files = spark.createDataFrame([("package.json", '{"dependencies":{"a":"^1"},"devDependencies":{"b":"~2"}}'), ("pkg/package.json", '{"dependencies":{"a":"3"}}'), ("bad/package.json", "{"), ("nx.json", "{}")], "path string, text string")
    deps = sources.packages(files)
    assert {r.name: r.version for r in patterns.merged_dependencies(deps).collect()} == {"a": "3", "b": "2"}
    roots = sources.projects(files)
    assert {r.root: r.kind for r in roots.collect()} == {"": "workspace", "pkg": "project", "bad": "project"}
    deep = spark.createDataFrame([("pkg/src/x.ts",), ("other/y.ts",)], "path string")
    assert {r.path: r.root for r in sources.containing_root(deep, roots).collect()} == {"pkg/src/x.ts": "pkg", "other/y.ts": ""}


def test_generations(spark, tmp_path):
    store = Store(spark, tmp_path.as_uri())
    assert store.state() == "empty" and store.generations() == []
    with pytest.raises(ValueError):
        store.open()
    for k in range(5):
        store.publish({"t": spark.range(k)})
    assert store.open("t")["t"].count() == 4 and len(store.generations()) == 3 and store.state() == "committed"
    with pytest.raises(ValueError):
        store.open("other")
    store._write("current.json", '{"build": "gone", "format": 1}')
    assert store.state() == "incomplete"
    store._write("current.json", '{"build": "gone", "format": 99}')
    assert store.state() == "foreign"


def test_note_store(spark, tmp_path):
    path = (tmp_path / "notes").as_uri()
    new = spark.sql("select 'a' id, 'gotcha' type, 'c' category, 'm' memory, 'r' reason, '2024-01-01' date, named_struct('kind','global','file',cast(null as string),'symbol',cast(null as string)) scope")
    assert sources.append_notes(spark, path, new) == 1 and sources.append_notes(spark, path, new) == 0
    assert sources.read_notes(spark, path).count() == 1


def test_refresh_by_stream(spark, tmp_path):
    folder, state = str(tmp_path / "in"), {"df": spark.createDataFrame([("a", "1"), ("b", "1")], "path string, hash string"), "n": 0}
    spark.createDataFrame([("b", "2"), ("c", "1")], "path string, hash string").coalesce(1).write.parquet(folder)

    def publish(df, number):
        state["df"] = spark.createDataFrame(df.collect(), df.schema)
        state["n"] += 1

    for _ in range(2):
        q = watch.refreshing(watch.changes(spark, folder, "path string, hash string"), str(tmp_path / "cp"), lambda: state["df"], publish)
        q.awaitTermination(60)
    assert sorted(map(tuple, state["df"].collect())) == [("a", "1"), ("b", "2"), ("c", "1")] and state["n"] == 1


def test_without_the_corpus_operators(spark):
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert not any(q.startswith('op') for q in e.queries()) and 'keyword_topk' in e.queries()"
    root = Path(__file__).resolve().parents[1]
    hide = "import importlib.abc, sys\nclass H(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path=None, target=None):\n        if name in ('quillon.llm', 'corpus_pipeline'):\n            raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, H())\n"
    done = subprocess.run([sys.executable, "-c", hide + code], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
