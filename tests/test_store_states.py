"""States of a store, tables of another build, recovery."""

from __future__ import annotations

import json
import shutil
from pathlib import Path

import pytest

from quillon.api import Project
from quillon.sources.generations import Store


def test_states_and_recovery(spark, tmp_path):
    root = tmp_path / "store"
    store = Store(spark, root.as_uri())
    assert store.state() == "empty" and store.recover() is None
    first = store.publish({"t": spark.range(3)})
    second = store.publish({"t": spark.range(4)})
    pointer = root / "current.json"
    for body, state in [("{", "foreign"), ("[1]", "foreign"), ('{"build": "x", "format": 99}', "foreign"), (json.dumps({"build": second, "format": 0}), "legacy"), ('{"build": "gone", "format": 1}', "incomplete")]:
        pointer.write_text(body)
        (root / ".current.json.crc").unlink(missing_ok=True)
        assert store.state() == state
    assert store.recover() == second and store.open("t")["t"].count() == 4
    pointer.unlink()
    assert store.state() == "recoverable"
    shutil.rmtree(root / f"gen={second}" / "t")
    assert store.recover() == first and store.open("t")["t"].count() == 3
    pointer.unlink()
    for build in (first, second):
        (root / f"gen={build}" / "meta.json").unlink()
    assert store.state() == "unfinished" and store.recover() is None


def test_tables_of_another_build_are_refused(spark, tmp_path):
    store = Store(spark, (tmp_path / "store").as_uri())
    first = store.publish({"t": spark.range(3), "u": spark.range(1)})
    second = store.publish({"t": spark.range(4), "u": spark.range(1)})
    shutil.rmtree(tmp_path / "store" / f"gen={second}" / "t")
    shutil.copytree(tmp_path / "store" / f"gen={first}" / "t", tmp_path / "store" / f"gen={second}" / "t")
    assert store.problems(second) == {"t": "of another build"}
    assert store.open("u")["u"].count() == 1
    with pytest.raises(ValueError, match="another build"):
        store.open()


def test_healing(spark, tmp_path):
    tree, store = tmp_path / "tree", tmp_path / "store"
    tree.mkdir()
    (tree / "a.py").write_text("def a(): pass\n")
    project = Project(spark, str(tree), store.as_uri())
    assert project.heal() == "rebuilt" and project.heal() == "nothing"
    build = project.index.meta()["build"]
    shutil.rmtree(Path(store) / f"gen={build}" / "chunks")
    assert project.heal() == "rebuilt" and project.index.meta()["build"] != build
    (store / "current.json").unlink()
    assert project.heal() == "recovered"
    (store / "current.json").write_text("{}")
    (store / ".current.json.crc").unlink(missing_ok=True)
    assert project.heal() == "refused"


def test_relative_paths_and_blocks_of_tokens(spark):
    from pyspark.sql import functions as F

    from quillon.operators import evals

    paths = ["/Repo/src\\a.ts", "./b.ts", "././c.ts", "//d.ts", None, "/repository/e.ts"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(evals.relative(F.col("p"), "/repo/").alias("x")).collect()
    assert [r.x for r in got] == ["src/a.ts", "b.ts", "./c.ts", "d.ts", None, "repository/e.ts"]
    files = spark.createDataFrame([("a/one.ts", "one two\nTWO one three"), ("b.ts", None)], "path string, text string")
    tokens = spark.createDataFrame([(t,) for t in ("one", "two", "three", "zzz")], "token string")
    held = [sorted(r.token for r in evals._holding(files, F.lower("text"), tokens, block).collect()) for block in (1, 2, 1000)]
    assert held == [["one", "three", "two"]] * 3
    q = spark.createDataFrame([(1, "one"), (1, "Two"), (1, ""), (2, "b.ts"), (3, None)], "query_id int, token string")
    assert sorted(map(tuple, evals.lexical_baseline(files, q).collect())) == [(1, "a/one.ts", 12, 1), (2, "b.ts", 8, None)]


def test_edges_that_are_not_accepted_are_not_walked(spark):
    from quillon.operators import graph

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "x"), ("x", "c")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    for walk in (graph.paths, graph.capped_paths):
        got = walk(edges, start, accept=lambda s, d: (s != "x") & (d != "x")).collect()
        assert sorted(tuple(r.path) for r in got) == [("a", "b"), ("a", "b", "c")]
