"""The library's surface on a small tree of our own."""

from __future__ import annotations

import json
import subprocess

import pytest

from quillon.__main__ import main
from quillon.api import Project
from quillon.operators.vectors import HashedWords, check_dimensions
from quillon.sources import guards

TREE = {
    "package.json": '{"dependencies": {"react": "^18.0.0"}, "devDependencies": {"vitest": "~1.0"}}',
    "src/core/store.ts": "import { load } from '../api/load';\nexport class Store {\n  read(a) { if (a) { return load(a); } }\n}\n",
    "src/api/load.ts": "import { Store } from '../core/store';\nimport axios from 'axios';\nexport function load(key) { return axios.get(key); }\n",
    "src/ui/page.ts": "import { Store } from '../core/store';\nimport { useState } from 'react';\nexport function page() { return useState(new Store()); }\n",
    "src/ui/page.test.ts": "import { page } from './page';\nimport { expect } from 'vitest';\n",
    "src/main.ts": "import { page } from './ui/page';\nimport { gone } from './gone';\npage();\n",
    "tools/clean.py": "import os\n\nclass Cleaner:\n    def run(self):\n        return os.getcwd()\n",
    "CONTRIBUTING.md": "Read this.\n## Style\nUse Store for state.\n## Tests\nWrite them.\n",
}


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, body in TREE.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    found = Project(spark, str(root), tmp_path_factory.mktemp("store").as_uri(), provider=HashedWords(32))
    found.build()
    return found


def test_questions(project):
    status = project.status()
    assert status["state"] == "committed" and status["files"] == 6 and status["chunks"] == 6
    check_dimensions(project.index.open("chunks")["chunks"], 32)
    with pytest.raises(ValueError):
        check_dimensions(project.index.open("chunks")["chunks"], 33)
    hits = project.search("where is Store read", "useState page", k=3).orderBy("query_id", "rank").collect()
    assert [r.path for r in hits if r.query_id == 0][0] == "src/core/store.ts" and len([r for r in hits if r.query_id == 1]) == 3
    assert all(r.path.endswith(".py") for r in project.search("cleaner run", filters={"language": "python"}).collect())
    assert {r.path: r.uses for r in project.references("Store").collect()} == {"src/api/load.ts": 1, "src/core/store.ts": 1, "src/ui/page.ts": 2}
    assert [(r.nodes, r.severity) for r in project.cycles().collect()] == [(["src/api/load.ts", "src/core/store.ts"], "high")] and project.cycles("tools").isEmpty()
    assert project.health().first().node in ("src/core/store.ts", "src/api/load.ts")
    assert {tuple(r.path) for r in project.relationships("src/main.ts", hops=2).collect()} == {("src/main.ts", "src/ui/page.ts"), ("src/main.ts", "src/ui/page.ts", "src/core/store.ts")}
    assert {r.file: r.hop for r in project.impact("src/core/store.ts").collect()}["src/main.ts"] == 2
    assert project.preflight("src/core/store.ts").first().risk == "high" and project.preflight("tools/clean.py").first().risk == "low"
    assert {r.name for r in project.patterns("hooks").collect()} == {"useState"}
    assert {("language", "python", "1"), ("dependency: framework", "react", "18.0.0"), ("dependency: testing", "vitest", "1.0")} <= set(map(tuple, project.metadata().collect()))
    assert [r.heading for r in project.style_guide("store").collect()] == ["Style"]
    assert "src/main.ts" in project.map_markdown()
    assert {r.query_id for r in project.search_quality("Store", "nothing at all zzz").collect()} == {0, 1}


def test_notes(project):
    assert project.remember("decision", "state", "use Store", "one place") and not project.remember("decision", "state", "use Store", "one place")
    assert project.remember("gotcha", "api", "load throws", "network", "file", "src/api/load.ts")
    assert project.memory().count() == 2 and [r.memory for r in project.memory("network").collect()] == ["load throws"] and project.memory(kind="failure").isEmpty()


def test_refresh_takes_only_what_changed(project):
    from pathlib import Path

    assert project.refresh() is None
    (Path(project.root) / "src/ui/page.ts").write_text("export const page = 1;\n")
    (Path(project.root) / "tools/clean.py").unlink()
    stale = project.relationships("src/main.ts", hops=2).collect()
    assert stale == []
    assert project.refresh() and project.status()["files"] == 5
    assert "src/ui/page.ts" in {r.path for r in project.index.open("chunks")["chunks"].collect()}
    assert project.relationships("src/main.ts").count() == 1


def test_another_provider_builds_anew(project):
    other = Project(project.spark, project.root, project.store, provider=HashedWords(16))
    assert other.refresh() and not other.refresh()
    check_dimensions(other.index.open("chunks")["chunks"], 16)


def test_guards(spark, tmp_path):
    guards.check_request({"a": [1, {"b": 2}]})
    deep = []
    for _ in range(70):
        deep = [deep]
    for bad in (deep, list(range(10_001))):
        with pytest.raises(ValueError):
            guards.check_request(bad)
    (tmp_path / "in").mkdir()
    (tmp_path / "link").symlink_to("/etc")
    assert guards.confined(str(tmp_path), "in/x.ts") == "in/x.ts"
    assert [guards.confined(str(tmp_path), p) for p in ("../x", "/etc/passwd", "link/passwd", ".")] == [None] * 4
    config = tmp_path / "c.json"
    assert guards.load_config(str(config)) == {}
    config.write_text('{"chunk_lines": 20}')
    assert guards.load_config(str(config)) == {"chunk_lines": 20}
    for bad in ("[]", '{"x": 1}', '{"chunk_lines": "a"}', '{"chunk_lines": true}'):
        config.write_text(bad)
        with pytest.raises(ValueError):
            guards.load_config(str(config))
    with guards.one_writer(spark, tmp_path.as_uri()):
        with pytest.raises(TimeoutError):
            with guards.one_writer(spark, tmp_path.as_uri(), wait=0.3):
                pass
        with guards.one_writer(spark, tmp_path.as_uri(), wait=5, dead_after=-1):
            pass
    with guards.one_writer(spark, tmp_path.as_uri(), wait=0.1):
        pass


def test_review_and_command_line(spark, tmp_path, capsys):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.ts").write_text("export function loadItems() {}\n")
    git("add", "-A")
    git("commit", "-qm", "one")
    (tmp_path / "b.ts").write_text("import { loadItems } from './a';\nloadItems();\n")
    git("add", "-A")
    git("commit", "-qm", "two")
    for args in (["index"], ["status"], ["search", "loadItems"], ["refs", "loadItems"], ["map"], ["review", "HEAD~1"], ["cycles"]):
        main(["--root", str(tmp_path), "--master", "local[4]", *args])
    out = capsys.readouterr().out
    assert '"state": "committed"' in out and '"path": "a.ts"' in out and "# Map" in out and json.loads([x for x in out.splitlines() if '"asked_by"' in x][0])["asked_by"] == ["b.ts"]
