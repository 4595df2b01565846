"""Tool-call linking, the pipeline's stages and the registered queries."""

from __future__ import annotations

import json
import random

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from quillon.llm import chat, queries

SMALL = "/root/testdata/sf0.001"
CALLS = "conv_id long, place long, call_id string, name string, arguments string, needs array<string>"
SCHEMAS = [("find", "query", "string", True), ("find", "limit", "integer", False), ("find", "deep", "object", False), ("rate", "score", "number", True)]


def linked(spark, calls, results):
    schemas = spark.createDataFrame(SCHEMAS, "tool string, field string, type string, required boolean")
    frame = spark.createDataFrame(calls, CALLS).selectExpr("*", "'x' AS tool", "1 AS uses", "2 AS node")
    out = chat.linked(frame, spark.createDataFrame(results, "call_id string, place long, content string"), schemas)
    return {(r.call_id, r.place): r for r in out.collect()}


def test_calls_are_checked_and_linked(spark):
    calls = [
        (1, 0, "a", "find", '{"query": "x", "limit": 3}', []),
        (1, 1, "b", "find", '{"limit": "3", "more": 1}', ["a"]),
        (1, 2, "c", "rate", '{ "score" : 2 }', ["b", "a"]),
        (1, 3, "d", "rate", '{"score": 2.5}', ["zz"]),
        (1, 4, "e", "none", "{}", ["d", "c"]),
        (1, 5, "f", "rate", None, ["f2"]), (1, 6, "f2", "rate", "[1]", ["f"]), (1, 7, "g", "rate", '{"score":1}', ["f2"]),
        (1, 8, None, "rate", '{"score":1}', []), (2, 0, "h", "rate", '{"score":1}', None), (2, 1, "h", "rate", '{"score":1,"score":2}', ["a"]),
        (3, 0, "i", "find", '{"query":"\\u00e9\\n","deep":{"b":[1, {"z":1,"a":null}],"a":1e2}}', []),
    ]
    results = [("a", 5, "late"), ("a", 2, "first"), ("nobody", 1, "lost"), (None, 1, "null"), ("c", 1, None)]
    got = linked(spark, calls, results)
    assert len(got) == len(calls)
    assert {k[0]: r.level for k, r in got.items() if k[0] in [*"abcde"]} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": 3}
    assert [got[k].level for k in (("f", 5), ("f2", 6), ("g", 7))] == [None] * 3
    assert got["a", 0].valid and got["a", 0].n_results == 2 and json.loads(got["a", 0].message)["result"] == "first"
    assert got["b", 1].errors == ["missing query", "unknown field more", "wrong type limit"]
    assert got["c", 2].valid and got["c", 2].n_results == 1 and got["c", 2].message == '{"arguments":{"score":2},"errors":[],"id":"c","level":2,"name":"rate","type":"call"}'
    assert got["d", 3].errors == ["unknown dependency"] and got["e", 4].errors == ["unknown tool"]
    assert "arguments are no object" in got["f", 5].errors and "cyclic dependency" in got["f2", 6].errors
    assert got[None, 8].errors == ["no identifier"] and "identifier used twice" in got["h", 0].errors and "arguments are no object" in got["h", 1].errors
    assert got["i", 0].valid and json.loads(got["i", 0].message)["arguments"]["deep"] == {"a": 100.0, "b": [1, {"a": None, "z": 1}]}
    for r in got.values():
        assert list(json.loads(r.message)) == sorted(json.loads(r.message)) and " " not in r.message.split('"errors"')[0].replace("\\n", "")


def test_levels_equal_brute_force(spark):
    rnd = random.Random(3)
    for trial in range(2):
        edges = {(i, rnd.randrange(i)) for i in range(1, 60) for _ in range(rnd.choice([0, 1, 1, 2, 3]))} | {(i, i - 1) for i in range(100, 140)}
        if trial:
            edges |= {(200, 201), (201, 202), (202, 200), (203, 202), (204, 203), (204, 1), (205, 204), (300, 300), (301, 300), (302, 301), (302, 7)}
        needs: dict[int, set[int]] = {}
        for a, b in edges:
            needs.setdefault(a, set()).add(b)

        def level(x, seen=()):
            if x in seen:
                return None
            below = [level(y, (*seen, x)) for y in needs.get(x, ())]
            return None if None in below else 1 + max(below, default=-1)

        rows = spark.createDataFrame([(str(a), str(b)) for a, b in edges] + [(None, "1"), ("1", None)], "id string, dep string")
        assert {r.node: r.level for r in chat.levels(rows).collect()} == {str(x): level(x) for x in needs}
    assert chat.levels(rows.limit(0)).count() == 0


def test_conversations_with_nulls(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a"), (1, 2, "user", "q\nr"), (1, 2, "user", "q"), (None, 3, "user", "z"), (1, None, "assistant", "z"), (1, 5, None, None), (1, 6, "tool", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS level", "2 AS call_id")
    out = chat.op9_chat_tools(frame).collect()
    assert len(out) == len(rows) and all(json.loads(r.message)["type"] == r.kind for r in out)
    assert chat.op9_chat_tools(frame.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda rows: sorted([tuple(r) for r in rows], key=str)
    assert key(got.select(*columns).collect()) == key(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_ten_queries_and_the_pipeline_are_registered():
    found = __spark_entry__.queries()
    assert {int(n[2:].split("_")[0]) for n in found if n.startswith("op")} == set(range(1, 11)) and "pipeline" in found


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    frame, seen = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, SMALL)
        if k < 4:
            assert out.columns == docs.columns
        rows = {r.doc_id: r for r in out.collect()}
        before = {r.doc_id: r for r in frame.collect()}
        assert rows.keys() <= before.keys()
        seen.append((before, rows))
        frame = spark.createDataFrame(list(rows.values()), docs.schema) if k < 4 else out
    (_, good), (a, lines_), (b, one), (c, clean), (e, coded) = seen
    # 1: labelled good documents stay, most labelled bad ones go.
    assert all(i in good for i, q in labels.items() if q == 1)
    assert sum(i in good for i, q in labels.items() if q == 0) <= 2
    # 2: nothing but whole lines goes, and each is left somewhere.
    assert lines_.keys() == a.keys()
    gone = {line for i in a for line in set((a[i].text or "").split("\n")) - set((lines_[i].text or "").split("\n"))}
    assert all(any(line in (r.text or "").split("\n") for r in lines_.values()) for line in gone)
    # 3: one of each group of near-duplicates.
    from quillon.llm import simhash

    parts = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(list(b.values()), docs.schema)).collect()}
    assert sorted(one) == sorted(set(parts.values()))
    # 4: no window of the benchmark is left in what had one; the rest is as it was.
    from quillon.llm import decontaminate

    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    hit = {r.doc_id for r in decontaminate.op10_decontamination(spark.createDataFrame(list(c.values()), docs.schema), bench).where("contaminated").collect()}
    assert all((clean[i].text == c[i].text) == (i not in hit) for i in clean) and clean.keys() == c.keys()
    # 5: ids of every document.
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    assert coded.keys() == e.keys()
    assert all(list(coded[i].ids) == library.encode(e[i].text, add_special_tokens=False).ids for i in e)


def test_stages_take_odd_tables(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "a b c", "en", "s1", 5), (2, "", "en", None, 0), (3, "x " * 50_000, "en", "s2", 100_000), (4, "same line\nof text", "en", "s3", 17), (4, "same line\nof text", "en", "s3", 17), (5, "same line\nof text", None, "s4", 17)]
    spark.createDataFrame([(4, 1, 0), (5, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: "n_chars" for c in ("score", "n_lines", "n_removed", "tag", "site", "fp", "node", "component", "component_id", "rep", "kept", "spans", "items", "hits", "ids", "decoded", "n_tokens", "place", "pos", "line")}
    wide = docs.selectExpr("*", *[f"{v} AS {k}" for k, v in clash.items()])
    for frame in (docs, wide, docs.limit(0)):
        n = frame.count()
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, frame, str(tmp_path))
            got = out.count()
            if k < 4:
                assert out.columns == frame.columns
            assert got == (5 if k == 2 and n else n), k
            if k == 3 and n:
                assert [r.text for r in out.where("doc_id is null").collect()] == [""]
