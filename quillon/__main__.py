"""Command line: ``python -m quillon --root DIR COMMAND …``."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from quillon.api import Project
from quillon.session import build_session, ship_package

COMMANDS = {
    "index": (), "refresh": (), "status": (), "preview": (), "map": (), "metadata": (), "search": ("query",), "refs": ("symbol",), "cycles": (), "health": (), "patterns": (),
    "relationships": ("file",), "impact": ("file",), "preflight": ("file",), "style-guide": (), "memory": (), "remember": ("kind", "category", "memory", "reason"), "review": ("base",),
}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quillon", description="Ask an indexed tree of source files.")
    parser.add_argument("--root", default=".")
    parser.add_argument("--store", help="where the index is; .quillon under the root if not given")
    parser.add_argument("--master", default="local[*]")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, positional in COMMANDS.items():
        p = sub.add_parser(name)
        for a in positional:
            p.add_argument(a)
    given = vars(parser.parse_args(args))
    root = str(Path(given.pop("root")).resolve())
    spark = build_session("quillon", given.pop("master"), **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    project = Project(spark, root, given.pop("store") or Path(root, ".quillon").as_uri(), ignore=["/.quillon/"])
    command = given.pop("command")
    call = {"index": project.build, "refs": project.references, "map": project.map_markdown, "style-guide": project.style_guide}.get(command) or getattr(project, command)
    out = call(*given.values())
    if hasattr(out, "toJSON"):
        for row in out.toLocalIterator():
            print(json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False))
    else:
        print(out if isinstance(out, str) else json.dumps(out))


if __name__ == "__main__":
    main()
